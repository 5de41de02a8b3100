"""Session settings the library relies on, and a loader for a folder of parquet tables."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
# Counted texts of like shape take up to twenty times their shuffled size in memory.
ADVISED = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators need to an existing session, and those that the
    application has not set itself."""
    started_with = spark.sparkContext.getConf()
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    for key, value in ADVISED.items():
        if not started_with.contains(key):
            spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as `spark.checkpoint.dir` names it.

    Executors of a cluster share no temporary folder, so there it must be set; in local mode one is
    made where none is.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="tallyglass-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(current)
    return current


def load_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Read `<folder>/<name>.parquet` for every name."""
    return {name: spark.read.parquet(os.path.join(folder, f"{name}.parquet")) for name in names}
