"""Auditable quality scores: five weighted dimensions per column, then tables, relations, base.

All of it is arithmetic on profiles and relation measures, so it costs as much as the catalog is
wide, whatever the number of data rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyglass.functions import fixed
from tallyglass.functions.text import percent

DIMENSIONS = tuple(fixed.QUALITY_WEIGHTS)


def resolve_weights(overrides: dict[str, float] | None = None) -> dict[str, float]:
    """Default weights with a company's own; unknown names are ignored."""
    own = {k: float(v) for k, v in (overrides or {}).items() if k in fixed.QUALITY_WEIGHTS}
    return {**fixed.QUALITY_WEIGHTS, **own}


def _is_temporal() -> Column:
    return F.coalesce(F.col("detected_type").startswith("datetime"), F.lit(False)) | F.lower(
        "declared_type").rlike("date|time")


def _completeness() -> tuple[Column, Column]:
    total = F.col("null_count") + F.col("non_null_count")
    score = F.coalesce(F.col("non_null_count") / F.nullif(total, F.lit(0)), F.lit(1.0))
    scope = F.when(F.col("sampled"), " of a sample").otherwise("")
    return score, F.when(total == 0, "No rows to judge").otherwise(F.concat(
        F.lit("Complete "), percent(score),
        F.format_string(" (%d NULL in %d", "null_count", total), scope, F.lit(")"),
    ))


def _validity() -> tuple[Column, Column]:
    usable = F.col("format_checked").isNotNull() & F.col("invalid_count").isNotNull() & (
        F.col("non_null_count") > 0)
    score = F.when(usable, 1 - F.col("invalid_count") / F.col("non_null_count"))
    return score, F.concat(
        F.lit("Valid "), percent(score),
        F.format_string(" (%d not a proper %s in %d)", "invalid_count", "format_checked",
                        "non_null_count"),
    )


def _uniqueness() -> tuple[Column, Column]:
    known = F.col("non_null_count")
    near = (
        ~_is_temporal() & (F.col("distinct_ratio") >= fixed.NEAR_UNIQUE_RATIO)
        & (known > fixed.NEAR_UNIQUE_ROWS)
    )
    identifies = F.col("pii_type").isin("email", "iban", "siret")
    expected = F.col("is_pk") | F.coalesce(identifies, F.lit(False)) | F.coalesce(
        near, F.lit(False))
    score = F.when(expected & (known > 0), F.least(F.lit(1.0), F.col("distinct_count") / known))
    reason = F.when(F.col("is_pk"), "primary key").when(
        F.col("pii_type").isNotNull(), "identifier").otherwise("nearly unique")
    return score, F.concat(
        F.lit("Unique "), percent(score),
        F.format_string(" (%d duplicates in %d, %s)",
                        F.greatest(F.lit(0), known - F.col("distinct_count")), known, reason),
    )


def _consistency() -> tuple[Column, Column]:
    worst = F.col("worst")
    return worst["ratio"], F.concat(
        F.lit("Consistent "), percent(worst["ratio"]),
        F.format_string(" (%d orphans in %d to %s)", worst["orphans"], worst["total"],
                        worst["to_table"]),
    )


def _freshness(as_of: str) -> tuple[Column, Column]:
    latest = F.when(_is_temporal(), F.expr("try_cast(left(max_value, 10) as date)"))
    age = F.datediff(F.lit(as_of).cast("date"), latest)
    span = fixed.STALE_DAYS - fixed.FRESH_DAYS
    fading = 1 - (age - fixed.FRESH_DAYS) / F.lit(float(span))
    score = F.when(latest.isNotNull(), F.when(age <= fixed.FRESH_DAYS, 1.0)
                   .when(age >= fixed.STALE_DAYS, 0.0).otherwise(fading))
    return score, F.concat(
        F.lit("Fresh "), percent(score), F.lit(" (latest "), latest.cast("string"),
        F.format_string(", %d days old)", age),
    )


def quality_columns(
    profile_df: DataFrame, measured_df: DataFrame, keys_df: DataFrame, as_of: str,
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """(table_name, column_name, score, dimensions[], detail) for every profiled column.

    Weights are renormalised over the dimensions that apply. `as_of` replaces the clock, so a
    score can be reproduced.
    """
    weights = resolve_weights(weights)
    worst = measured_df.groupBy(
        F.col("from_table").alias("table_name"), F.col("from_column").alias("column_name")
    ).agg(F.min_by(
        F.struct("ratio", "orphans", "total", "to_table"), F.struct("ratio", "to_table")
    ).alias("worst"))
    keys = keys_df.select("table_name", "column_name", F.lit(True).alias("_key"))
    columns = profile_df.join(worst, ["table_name", "column_name"], "left").join(
        keys, ["table_name", "column_name"], "left"
    ).withColumn("is_pk", F.coalesce("_key", F.lit(False)))

    parts = dict(zip(DIMENSIONS, (
        _completeness(), _validity(), _uniqueness(), _consistency(), _freshness(as_of)
    )))
    dimensions = F.array(*[
        F.struct(
            F.lit(name).alias("name"), score.isNotNull().alias("applicable"),
            score.alias("score"), F.lit(weights[name]).alias("weight"),
            F.coalesce(F.when(score.isNotNull(), detail), F.lit("Not applicable"))
            .alias("detail"),
        )
        for name, (score, detail) in parts.items()
    ])
    scored = columns.select("table_name", "column_name", dimensions.alias("dimensions"))
    applied = F.filter("dimensions", lambda d: d.applicable)

    def total(value):
        return F.aggregate(applied, F.lit(0.0), lambda acc, d: acc + value(d))

    weight = total(lambda d: d.weight)
    score = F.coalesce(
        total(lambda d: d.weight * d.score) / F.nullif(weight, F.lit(0.0)), F.lit(1.0)
    )
    return scored.select("table_name", "column_name", score.alias("score"), "dimensions").select(
        "table_name", "column_name", "score", "dimensions",
        F.concat(F.lit("Score "), percent(F.col("score")), F.lit(" from "), F.concat_ws(
            ", ", F.transform(F.filter("dimensions", lambda d: d.applicable),
                              lambda d: d["name"]))).alias("detail"),
    )


def quality_dimensions(quality_columns_df: DataFrame) -> DataFrame:
    """The same scores, one row per column and dimension."""
    return quality_columns_df.select(
        "table_name", "column_name", F.explode("dimensions").alias("d")
    ).select(
        "table_name", "column_name", F.col("d.name").alias("dimension"), "d.applicable",
        "d.score", "d.weight", "d.detail",
    )


def column_usage(audit_df: DataFrame) -> DataFrame:
    """(table_name, column_name, n_uses): one use per pair and audit row, names made short.

    Pairs are counted per distinct combination of lists first, so a question asked a billion
    times is exploded once.
    """
    def short(name):
        return F.element_at(F.split(name, r"\."), -1)

    asked = audit_df.groupBy("tables_used", "columns_used").agg(F.count("*").alias("n"))
    return asked.select("n", "columns_used", F.explode("tables_used").alias("t")).select(
        "n", short(F.col("t")).alias("table_name"), F.explode("columns_used").alias("c")
    ).groupBy("table_name", short(F.col("c")).alias("column_name")).agg(
        F.sum("n").alias("n_uses")
    )


def quality_tables(quality_columns_df: DataFrame, usage_df: DataFrame) -> DataFrame:
    """Mean column score per table, each column weighted by 1 + its uses."""
    weight = 1 + F.coalesce(F.col("n_uses"), F.lit(0))
    return quality_columns_df.join(usage_df, ["table_name", "column_name"], "left").groupBy(
        "table_name"
    ).agg(
        (F.sum(weight * F.col("score")) / F.sum(weight)).alias("score"),
        F.count("*").alias("n_columns"),
    )


def quality_relations(measured_df: DataFrame) -> DataFrame:
    return measured_df.select(
        "from_table", "from_column", "to_table", "to_column", F.col("ratio").alias("score"),
        F.format_string("%d orphans in %d", "orphans", "total").alias("detail"),
    )


def quality_base(
    quality_tables_df: DataFrame, quality_columns_df: DataFrame | None = None,
    quality_relations_df: DataFrame | None = None,
) -> DataFrame:
    """Mean of the table scores, with how much was scored."""
    base = quality_tables_df.agg(
        F.coalesce(F.avg("score"), F.lit(1.0)).alias("score"),
        F.count("*").alias("tables_scored"),
        F.coalesce(F.sum("n_columns"), F.lit(0)).alias("columns_scored"),
    )
    scored = F.lit(0).cast("bigint") if quality_relations_df is None else (
        quality_relations_df.agg(F.count("*")).scalar()
    )
    return base.withColumn("relations_scored", scored)
