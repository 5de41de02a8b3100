"""Reading a series over time, and a plain result, for what stands out.

A series is one row per calendar period, so its length is bounded by the calendar and not by the
data. Results read by `ruptures` may be as fine as one row per instant: the previous value comes
from `previous_value`, which never sorts a whole series in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyglass.functions.buckets import month_key
from tallyglass.functions.ordering import previous_value

SERIES = ("period", "value")


def monthly_series(
    df: DataFrame, date_col: str, measure: str | Column | None = None
) -> DataFrame:
    """(period `yyyy-MM`, value): the sum of a measure, or the rows, per month."""
    value = F.count("*") if measure is None else F.sum(measure)
    moment = F.col(date_col)
    if df.schema[date_col].dataType.typeName() == "string":
        moment = moment.try_cast("timestamp")
    return df.where(moment.isNotNull()).groupBy(
        month_key(moment).alias("period")
    ).agg(value.cast("double").alias("value"))


def _ends(series_df: DataFrame) -> DataFrame:
    period, value = SERIES
    return series_df.agg(
        F.count("*").alias("n"),
        F.min(period).alias("first_period"), F.min_by(value, period).alias("first_value"),
        F.max(period).alias("last_period"), F.max_by(value, period).alias("last_value"),
        F.min_by(F.struct(period, value), F.struct(value, period)).alias("low"),
    )


def _change() -> Column:
    base = F.col("first_value")
    change = (F.col("last_value") - base) / F.nullif(F.abs(base), F.lit(0.0)) * 100
    return F.coalesce(change, F.lit(0.0))


def trend(series_df: DataFrame) -> DataFrame:
    """One row when the series moved by 5 % or more over at least three periods."""
    return _ends(series_df).withColumn("pct", _change()).where(
        "n >= 3 and abs(pct) >= 5"
    ).select(
        F.when(F.col("pct") < 0, "trend").otherwise("opportunity").alias("category"),
        F.when(F.col("pct") <= -25, "high").when(F.col("pct") < 0, "medium").otherwise("low")
        .alias("severity"),
        F.when(F.col("pct") < 0, "important").otherwise("opportunity").alias("level"),
        "first_period", "first_value", "last_period", "last_value", "pct",
    )


def period_drops(series_df: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Periods that lost 30 % or more against the one before."""
    with_previous = previous_value(series_df, "period", "value", "previous")
    change = (F.col("value") - F.col("previous")) / F.nullif(F.col("previous"), F.lit(0.0))
    return with_previous.withColumn("change", change).where(
        F.col("change") <= -threshold
    ).select("period", "previous", "value", (F.abs("change") * 100).alias("drop_pct"))


def outliers(series_df: DataFrame, k: float = 2, min_n: int = 6) -> DataFrame:
    """Periods more than `k` population deviations from the mean, given enough periods."""
    facts = series_df.agg(F.struct(
        F.count("value").alias("n"), F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("sd"),
    )).scalar()
    return series_df.withColumn("_f", facts).where(
        (F.col("_f.n") >= min_n) & (F.col("_f.sd") > 0)
        & (F.abs(F.col("value") - F.col("_f.mean")) > k * F.col("_f.sd"))
    ).select("period", "value", F.col("_f.mean").alias("mean"), F.col("_f.sd").alias("sd"))


def trend_step(series_df: DataFrame) -> DataFrame:
    """First step of an investigation: direction at 2 %, ends and low point."""
    pct = _change()
    return _ends(series_df).where("n >= 2").select(
        F.when(pct < -2, "down").when(pct > 2, "up").otherwise("stable").alias("direction"),
        "first_period", "first_value", "last_period", "last_value",
        F.col("low.period").alias("low_period"), F.col("low.value").alias("low_value"),
        pct.alias("pct"),
    )


# --- reading any result ----------------------------------------------------------------------

def read_series(df: DataFrame, time: str, value: str) -> DataFrame:
    """Rise, fall or stable at 5 %, with the extreme periods (the earliest among equals)."""
    known = df.where(F.col(value).isNotNull()).select(
        F.col(time).alias("period"), F.col(value).cast("double").alias("value")
    )
    read = known.agg(
        F.count("*").alias("n"),
        F.min_by("value", "period").alias("first_value"),
        F.max_by("value", "period").alias("last_value"),
        F.max("value").alias("max_value"), F.min("value").alias("min_value"),
        F.min_by("period", F.struct(-F.col("value"), F.col("period"))).alias("max_period"),
        F.min_by("period", F.struct("value", "period")).alias("min_period"),
    )
    pct = (F.col("last_value") - F.col("first_value")) / F.nullif(
        F.abs("first_value"), F.lit(0.0)) * 100
    return read.where("n >= 3").select(
        F.when(pct > 5, "rise").when(pct < -5, "fall").when(pct.isNotNull(), "stable")
        .alias("direction"),
        "first_value", "last_value", pct.alias("pct"), "max_value",
        "max_period", "min_value", "min_period",
    )


def ruptures(
    df: DataFrame, time: str, value: str, threshold: float = 0.3,
    keys: tuple[str, ...] = (), unit: str | None = None,
) -> DataFrame:
    """Changes of more than 30 % against the value before, up or down."""
    known = df.where(F.col(value).isNotNull()).select(*keys, time, value)
    stepped = previous_value(known, time, value, "previous", keys, unit)
    change = (F.col(value) - F.col("previous")) / F.nullif(F.abs("previous"), F.lit(0.0))
    return stepped.withColumn("change", change).where(F.abs("change") > threshold).select(
        *keys, F.col(time).alias("period"), "previous", F.col(value).alias("value"),
        (F.col("change") * 100).alias("pct"),
    )


def concentration(df: DataFrame, category: str, value: str) -> DataFrame:
    """The leading category, its share, and the spread between largest and smallest."""
    figure = F.col(value).cast("double")
    read = df.where(figure.isNotNull()).agg(
        F.count("*").alias("n"), F.sum(figure).alias("total"),
        F.max(figure).alias("top_value"), F.min(figure).alias("least"),
        # Largest value, then the smallest label: two maxima in one ordered pair.
        F.min_by(category, F.struct(-figure, F.col(category))).alias("top_label"),
    )
    share = F.coalesce(F.col("top_value") / F.nullif(F.col("total"), F.lit(0.0)) * 100,
                       F.lit(0.0))
    spread = F.col("top_value") / F.nullif(F.col("least"), F.lit(0.0))
    return read.where("n >= 3").select(
        "top_label", "top_value", "total", share.alias("share"),
        ((share > 50) & (F.col("n") > 2)).alias("concentrated"), spread.alias("spread"),
        F.coalesce(spread > 10, F.lit(False)).alias("wide"),
    )


def result_outliers(
    df: DataFrame, value: str, order: str, top: int = 3, k: float = 2, min_n: int = 8
) -> DataFrame:
    """The first rows more than two sample deviations from the mean, given eight rows."""
    facts = df.agg(F.struct(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
    )).scalar()
    far = df.withColumn("_f", facts).where(
        (F.col("_f.n") >= min_n) & (F.col("_f.sd") > 0)
        & (F.abs(F.col(value) - F.col("_f.mean")) > k * F.col("_f.sd"))
    )
    return far.orderBy(order).limit(top).select(
        F.col(order).alias("label"), F.col(value).alias("value"), F.col("_f.mean").alias("mean")
    )
