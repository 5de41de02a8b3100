"""Alert conditions on monitored values, with their state kept as data; and product metrics."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from tallyglass.functions import fixed
from tallyglass.functions.ordering import previous_value
from tallyglass.sources.catalog import union_all


def alert_values(
    alerts_df: DataFrame, tables: dict[str, DataFrame], definitions_df: DataFrame | None = None
) -> DataFrame:
    """(alert_id, value, error): the monitored scalar of every alert, in one pass per table.

    An alert names a table, expression and filter, or a measure definition. One that cannot be
    evaluated has a message in `error` and no value; the others are not affected. Rows are tagged
    with the filters they meet and summed per tag, so all filters of a table share its scan. The
    list of alerts is configuration and is read by the driver.
    """
    wanted = alerts_df.select("alert_id", "table_name", "expression", "filter", "definition")
    if definitions_df is not None:
        named = definitions_df.where("kind = 'measure'").select(
            F.col("name").alias("definition"), F.col("table_name").alias("_t"),
            F.col("expression").alias("_e"), F.col("filter").alias("_f"),
        )
        wanted = wanted.join(named, "definition", "left").select(
            "alert_id", F.coalesce("_t", "table_name").alias("table_name"),
            F.coalesce("_e", "expression").alias("expression"),
            F.coalesce("_f", "filter").alias("filter"),
        )
    usable: dict[str, list] = {}
    failed = []
    for row in wanted.orderBy("alert_id").collect():
        problem = _problem(row, tables)
        if problem is None:
            usable.setdefault(row.table_name, []).append(row)
        else:
            failed.append((row.alert_id, None, problem))
    parts = [_values_of(tables[name], rows) for name, rows in usable.items()]
    if failed or not parts:
        parts.append(alerts_df.sparkSession.createDataFrame(
            failed, "alert_id string, value double, error string"))
    return union_all(parts)


def _problem(row, tables: dict[str, DataFrame]) -> str | None:
    """Why an alert cannot be evaluated, as far as its names and types tell."""
    if not row.table_name or not row.expression:
        return "an alert needs a table and an expression"
    if row.table_name not in tables:
        return f"unknown table {row.table_name}"
    try:
        _ = _chosen(tables[row.table_name], row.filter).agg(
            F.expr(row.expression).cast("double")).schema
    except AnalysisException as error:
        return error.getMessage().split("\n")[0]
    return None


def _chosen(df: DataFrame, condition: str | None) -> DataFrame:
    return df.where(condition) if condition else df


def _values_of(df: DataFrame, rows: list) -> DataFrame:
    """The values of all alerts of one table."""
    conditions = list(dict.fromkeys(r.filter or None for r in rows))
    expressions = list(dict.fromkeys(r.expression for r in rows))
    sums = [F.expr(e).cast("double").alias(f"v{i}") for i, e in enumerate(expressions)]
    if len(conditions) == 1:
        summed = _chosen(df, conditions[0]).agg(*sums).withColumn("_tag", F.lit(0))
    else:
        tags = F.filter(F.array(*[
            F.when(F.lit(True) if c is None else F.expr(c), F.lit(i))
            for i, c in enumerate(conditions)]), lambda t: t.isNotNull())
        found = df.withColumn("_tag", F.explode(tags)).groupBy("_tag").agg(*sums)
        # A filter that no row meets still has a value: that of no rows.
        none = df.where("false").agg(*sums).withColumn(
            "_tag", F.explode(F.array(*[F.lit(i) for i in range(len(conditions))])))
        whole = F.struct(*[f"v{i}" for i in range(len(sums))])
        summed = found.withColumn("_met", F.lit(1)).unionByName(
            none.withColumn("_met", F.lit(0))).groupBy("_tag").agg(
            F.max_by(whole, "_met").alias("_all")).select("_tag", "_all.*")
    cells = F.array(*[
        F.struct(F.lit(conditions.index(r.filter or None)).alias("_of"),
                 F.lit(r.alert_id).alias("alert_id"),
                 F.col(f"v{expressions.index(r.expression)}").alias("value"))
        for r in rows
    ])
    return summed.select("_tag", F.inline(cells)).where("_of = _tag").select(
        "alert_id", "value", F.lit(None).cast("string").alias("error"))


def condition_status(comparison: Column, threshold: Column, value: Column, before: Column
                     ) -> Column:
    """`triggered`, `ok`, or `error` for a missing value."""
    change = (value - before) / F.nullif(F.abs(before), F.lit(0.0)) * 100
    fired = (
        ((comparison == "gt") & (value > threshold))
        | ((comparison == "lt") & (value < threshold))
        | ((comparison == "pct_drop") & F.coalesce(-change > threshold, F.lit(False)))
        | ((comparison == "pct_change") & F.coalesce(F.abs(change) > threshold, F.lit(False)))
    )
    return F.when(value.isNull(), "error").when(fired, "triggered").otherwise("ok")


def evaluate_alerts(values_df: DataFrame, alerts_df: DataFrame, state_df: DataFrame) -> DataFrame:
    """(alert_id, value, previous, status, message) against the last known values."""
    state = state_df.select("alert_id", F.col("last_value").alias("previous"))
    value, before = F.col("value"), F.col("previous")
    change = (value - before) / F.nullif(F.abs(before), F.lit(0.0)) * 100
    relative = F.col("comparison").isin("pct_drop", "pct_change")
    message = (
        F.when(F.col("error").isNotNull(), F.col("error")).when(value.isNull(), "no value")
        .when(relative & before.isNull(), F.format_string("first value %.2f", value))
        .when(relative & (before == 0), "previous value is zero")
        .when(relative, F.format_string("%.1f%% (%.2f to %.2f)", change, before, value))
        .otherwise(F.format_string("value %.2f against %.2f", value,
                                   F.col("threshold").cast("double")))
    )
    rules = alerts_df.select("alert_id", "comparison", "threshold")
    if "error" not in values_df.columns:
        values_df = values_df.withColumn("error", F.lit(None).cast("string"))
    return values_df.join(rules, "alert_id").join(state, "alert_id", "left").select(
        "alert_id", "value", "previous",
        condition_status(F.col("comparison"), F.col("threshold"), value, before)
        .alias("status"),
        message.alias("message"),
    )


def roll_state(state_df: DataFrame, evaluated_df: DataFrame) -> DataFrame:
    """Last value becomes previous; a missing value leaves both as they were."""
    fresh = evaluated_df.select("alert_id", F.col("value").alias("_new"),
                                F.col("status").alias("_status"))
    moved = F.col("_new").isNotNull()
    return state_df.join(fresh, "alert_id", "full").select(
        "alert_id", F.coalesce("_new", "last_value").alias("last_value"),
        F.when(moved, F.col("last_value")).otherwise(F.col("previous_value"))
        .alias("previous_value"),
        F.coalesce("_status", "last_status").alias("last_status"),
    )


def alert_events(events_df: DataFrame, evaluated_df: DataFrame, at: str | Column) -> DataFrame:
    """The event history with one more row per evaluated alert."""
    moment = F.lit(at).cast("timestamp") if isinstance(at, str) else at
    return events_df.unionByName(evaluated_df.select(
        "alert_id", moment.alias("at"), "value", "status", "message"))


def evaluate_history(
    measurements_df: DataFrame, alerts_df: DataFrame, unit: str | None = None
) -> DataFrame:
    """Replay a history of (alert_id, at, value): the status every measurement would have had."""
    stepped = previous_value(measurements_df, "at", "value", "previous", ("alert_id",), unit)
    return stepped.join(alerts_df.select("alert_id", "comparison", "threshold"), "alert_id"
                        ).select(
        "alert_id", "at", "value", "previous",
        condition_status(F.col("comparison"), F.col("threshold"), F.col("value"),
                         F.col("previous")).alias("status"),
    )


# --- product metrics -------------------------------------------------------------------------

def product_metrics(
    audit_df: DataFrame, as_of: str, days: int = 30, by: str | None = None
) -> DataFrame:
    """Quality of the work over a window of 1 to 365 days, whole or by a column."""
    if not 1 <= days <= 365:
        raise ValueError("days must be between 1 and 365")
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {days} days")
    status = F.col("status")

    def n(*states):
        return F.count_if(status.isin(*states))

    def rate(part, whole):
        return F.round(part / F.nullif(whole, F.lit(0)), 4)

    def mean_ok(column):
        return F.round(F.avg(F.when(status == "ok", F.col(column))), 2)

    groups = [by] if by else []
    recent = audit_df.where(F.col("created_at") >= since)
    if "day" in audit_df.columns:  # the log's folders: only those of the window are read
        recent = recent.where(F.col("day") >= since.cast("date"))
    return recent.groupBy(*groups).agg(
        F.lit(days).alias("window_days"), F.count("*").alias("total"),
        n("ok").alias("n_ok"), n("clarification").alias("n_clarification"),
        n("unanswerable").alias("n_unanswerable"), n("blocked").alias("n_blocked"),
        n("error").alias("n_error"),
        mean_ok("duration_ms").alias("avg_duration_ms"),
        mean_ok("confidence").alias("avg_confidence"),
        mean_ok("estimated_cost").alias("avg_cost"),
        rate(n("ok"), F.count("*")).alias("resolution_rate"),
        rate(n("clarification"), F.count("*")).alias("clarification_rate"),
        rate(n("ok"), n("ok", "blocked", "error")).alias("validation_rate"),
    )


def usage(
    events_df: DataFrame, k: int = 20, allowed: tuple[str, ...] = fixed.USAGE_EVENTS
) -> tuple[DataFrame, DataFrame]:
    """(by event, top `event:label` keys); events outside the allowed list are refused."""
    known = events_df.where(F.col("event").isin(*allowed))
    labelled = F.coalesce("label", F.lit("")) != ""
    key = F.when(labelled, F.concat_ws(":", "event", "label")).otherwise(F.col("event"))
    # The second count is taken from the first, so the log is read and shuffled once each way.
    keys = known.groupBy("event", key.alias("key")).agg(F.count("*").alias("n"))
    by_event = keys.groupBy("event").agg(F.sum("n").alias("n"))
    return by_event, keys.select("key", "n").orderBy(F.desc("n"), "key").limit(k)
