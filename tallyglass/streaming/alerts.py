"""Alerts that keep their own state between runs.

A stream over a growing folder measures every alert on what each trigger brings. State and events
are written by batch: one folder for each batch id, replaced as a whole. The state a batch starts
from is that of the batch before it, not the latest one, so a batch that is run again after a failure
computes the same rows from the same start and replaces them: nothing is added twice.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tallyglass.operators import alerts

STATE = "alert_id string, last_value double, previous_value double, last_status string"
EVENTS = ("alert_id string, at timestamp_ntz, value double, previous double, status string, "
          "message string")


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All batches of a folder, with their batch id; none where nothing was written yet."""
    try:
        return spark.read.schema(f"{schema}, batch bigint").parquet(folder)
    except AnalysisException:
        return spark.createDataFrame([], f"{schema}, batch bigint")


def state_before(spark: SparkSession, store: str, batch: int) -> DataFrame:
    """The state that a batch starts from: that of the batch of the next smaller id."""
    earlier = _read(spark, f"{store}/state", STATE).where(F.col("batch") < batch)
    last = earlier.agg(F.max("batch")).scalar()
    return earlier.where(F.col("batch") == last).drop("batch")


def apply_batch(batch_df: DataFrame, batch: int, table: str, alerts_df: DataFrame, store: str,
                at: str | None = None) -> None:
    """Evaluate all alerts on one batch, and replace its events and its state.

    `at` names the column whose largest value dates the events. Events are written first: a batch
    whose state stands is done.
    """
    spark = batch_df.sparkSession
    before = state_before(spark, store, batch)
    values = alerts.alert_values(alerts_df, {table: batch_df})
    moment = F.lit(None).cast("timestamp_ntz") if at is None else batch_df.agg(
        F.max(F.col(at)).cast("timestamp_ntz")).scalar()
    # One row for each alert; kept so that events and state come from the same evaluation.
    evaluated = alerts.evaluate_alerts(values, alerts_df, before).persist()
    try:
        evaluated.select("alert_id", moment.alias("at"), "value", "previous", "status", "message"
                         ).write.mode("overwrite").parquet(f"{store}/events/batch={batch}")
        alerts.roll_state(before, evaluated).write.mode("overwrite").parquet(
            f"{store}/state/batch={batch}")
    finally:
        evaluated.unpersist()


def watch(spark: SparkSession, folder: str, schema: StructType | str, table: str,
          alerts_df: DataFrame, store: str, at: str | None = None,
          most_files: int | None = None) -> StreamingQuery:
    """Start a stream that takes all files new in the folder, batch by batch, and ends.

    The store, a folder that all executors share, holds checkpoint, state and events. Run it again
    when more files have come; it goes on where it stopped.
    """
    source = spark.readStream.schema(schema)
    if most_files is not None:
        source = source.option("maxFilesPerTrigger", most_files)

    def one(batch_df: DataFrame, batch: int) -> None:
        apply_batch(batch_df, batch, table, alerts_df, store, at)

    return source.parquet(folder).writeStream.foreachBatch(one).option(
        "checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).start()


def events(spark: SparkSession, store: str) -> DataFrame:
    """The history of all evaluations: EVENTS and the batch."""
    return _read(spark, f"{store}/events", EVENTS)


def state(spark: SparkSession, store: str) -> DataFrame:
    """The state after the last batch."""
    every = _read(spark, f"{store}/state", STATE)
    return every.where(F.col("batch") == every.agg(F.max("batch")).scalar()).drop("batch")
