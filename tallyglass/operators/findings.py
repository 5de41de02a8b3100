"""Proactive findings, fingerprints of what they rest on, and whether they went stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyglass.functions.text import percent
from tallyglass.operators import series

CATEGORIES = ("anomaly", "trend", "opportunity", "suspicious_column", "incoherent_relation")
LEVELS = ("critical", "important", "opportunity", "info")
SEVERITIES = ("high", "medium", "low")
FINDING = ["category", "severity", "level", "table_name", "column_name", "period", "figure",
           "detail"]


def _finding(df, category, severity, level, table, column, period, figure, detail) -> DataFrame:
    return df.select(
        category.alias("category"), severity.alias("severity"), level.alias("level"),
        table.alias("table_name"), column.alias("column_name"), period.alias("period"),
        figure.cast("double").alias("figure"), detail.alias("detail"),
    )


def relation_findings(measured_df: DataFrame) -> DataFrame:
    """Relations with orphans; critical from 5 % on."""
    pct = (1 - F.col("ratio")) * 100
    grave = pct >= 5
    return _finding(
        measured_df.where("ratio < 0.999"), F.lit("incoherent_relation"),
        F.when(grave, "high").otherwise("medium"),
        F.when(grave, "critical").otherwise("important"),
        F.col("from_table"), F.col("from_column"), F.lit(None).cast("string"), pct,
        F.format_string("%.1f%% orphans towards %s", pct, "to_table"),
    )


def column_findings(profile_df: DataFrame) -> DataFrame:
    """Columns with invalid values, else with at least 30 % NULL; critical from 60 % on."""
    invalid = F.coalesce(F.col("invalid_count") > 0, F.lit(False))
    empty = F.coalesce(F.col("null_rate") >= 0.3, F.lit(False))
    grave = ~invalid & (F.col("null_rate") >= 0.6)
    return _finding(
        profile_df.where(invalid | empty), F.lit("suspicious_column"),
        F.when(grave, "high").otherwise("medium"),
        F.when(grave, "critical").otherwise("important"),
        F.col("table_name"), F.col("column_name"), F.lit(None).cast("string"),
        F.when(invalid, F.col("invalid_count").cast("double")).otherwise(
            F.col("null_rate") * 100),
        F.when(invalid, F.format_string("%d values are not a proper %s", "invalid_count",
                                        "format_checked"))
        .otherwise(F.concat(percent(F.col("null_rate"), 0), F.lit(" NULL"))),
    )


def series_findings(series_df: DataFrame, table: str) -> DataFrame:
    """Trend, drops and outliers of the key measure of a table."""
    name, none = F.lit(table), F.lit(None).cast("string")
    moved = series.trend(series_df)
    found = _finding(
        moved, F.col("category"), F.col("severity"), F.col("level"), name, none,
        F.col("last_period"), F.col("pct"),
        F.format_string("from %.0f (%s) to %.0f (%s)", "first_value", "first_period",
                        "last_value", "last_period"),
    )
    fell = series.period_drops(series_df)
    found = found.unionByName(_finding(
        fell, F.lit("anomaly"), F.lit("high"), F.lit("critical"), name, none, F.col("period"),
        F.col("drop_pct"), F.format_string("drop from %.0f to %.0f", "previous", "value"),
    ))
    odd = series.outliers(series_df)
    return found.unionByName(_finding(
        odd, F.lit("anomaly"), F.lit("medium"), F.lit("important"), name, none, F.col("period"),
        F.col("value"), F.format_string("%.0f against a mean of %.0f", "value", "mean"),
    ))


def rank_findings(findings_df: DataFrame, max_items: int | None = None) -> DataFrame:
    """Findings, critical first, then by severity; the first `max_items` where asked for."""
    def place(column, values):
        return F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column))

    ordered = findings_df.select(*FINDING).orderBy(
        place("level", LEVELS), place("severity", SEVERITIES), F.desc("category"), "table_name",
        F.asc_nulls_last("column_name"), F.asc_nulls_last("period"),
    )
    return ordered if max_items is None else ordered.limit(max_items)


def finding_counts(findings_df: DataFrame) -> DataFrame:
    """(counted, name, n): findings per category and per level, zeros included."""
    names = F.array(*[
        F.struct(F.lit(by).alias("counted"), F.lit(v).alias("name"))
        for by, values in (("category", CATEGORIES), ("level", LEVELS)) for v in values
    ])
    spark = findings_df.sparkSession
    every = spark.range(1).select(F.inline(names))
    seen = findings_df.select(F.inline(F.array(
        F.struct(F.lit("category").alias("counted"), F.col("category").alias("name")),
        F.struct(F.lit("level").alias("counted"), F.col("level").alias("name")),
    ))).groupBy("counted", "name").agg(F.count("*").alias("n"))
    return every.join(seen, ["counted", "name"], "left").select(
        "counted", "name", F.coalesce("n", F.lit(0)).alias("n")
    )


DIGITS = 12


def _order_free(lines: Column) -> Column:
    """A digest of a set of texts from sums of their hashes, so that sets merge in any order."""
    part = F.conv(F.substring(F.sha2(lines, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return F.concat_ws(":", F.count("*"), F.coalesce(F.sum(part), F.lit(0)))


def _lines(relations_df: DataFrame, profile_df: DataFrame, quality_df: DataFrame) -> DataFrame:
    """(component, table_name, column_name, line): what fingerprints rest on, a line for each fact."""
    def shown(column, digits=6):
        return F.coalesce(F.format_string(f"%.{digits}f", F.col(column)), F.lit("-"))

    def text(column):
        return F.coalesce(F.col(column).cast("string"), F.lit("-"))

    def part(df, component, table, column, line):
        return df.select(F.lit(component).alias("component"), F.col(table).alias("table_name"),
                         F.col(column).alias("column_name"), line.alias("line"))

    return part(
        relations_df, "schema", "from_table", "from_column", F.concat_ws(
            ":", "from_table", "from_column", "to_table", "status", shown("ratio"))
    ).unionByName(part(
        profile_df, "profiles", "table_name", "column_name", F.concat_ws(
            ":", "table_name", "column_name", shown("null_rate"), text("invalid_count"),
            text("detected_type"), text("pii_type")))
    ).unionByName(part(
        quality_df, "quality", "table_name", "column_name", F.concat_ws(
            ":", "table_name", text("column_name"), shown("score", 4))))


def fingerprint_tree(
    relations_df: DataFrame, profile_df: DataFrame, quality_df: DataFrame
) -> DataFrame:
    """(component, table_name, column_name, level, digest): a hash for each column, table and component.

    Level 2 are columns, 1 tables (column NULL), 0 components (table NULL too). A node's digest is
    the sum of its lines' hashes, so parts of a catalog can be hashed apart and in any order, and no
    node gathers its lines.
    """
    lines = _lines(relations_df, profile_df, quality_df)
    return lines.groupingSets(
        [("component",), ("component", "table_name"), ("component", "table_name", "column_name")],
        "component", "table_name", "column_name",
    ).agg(
        F.grouping_id().alias("_g"), _order_free(F.col("line")).alias("_sum")
    ).select(
        "component", "table_name", "column_name",
        F.expr("case _g when 3 then 0 when 1 then 1 else 2 end").alias("level"),
        F.substring(F.sha2("_sum", 256), 1, DIGITS).alias("digest"),
    )


def changes(before_df: DataFrame, now_df: DataFrame) -> DataFrame:
    """(component, table_name, column_name, change): what differs between two fingerprint trees.

    Trees are compared level by level: only below components that differ are tables compared, and
    only below those their columns. `change` is added, removed or changed; a table's own facts have
    no column.
    """
    keys = ["component", "table_name", "column_name"]

    def at(df, level, digest):
        return df.where(F.col("level") == level).select(*keys, F.col("digest").alias(digest))

    def same(names):
        cond = F.col(f"x.{names[0]}").eqNullSafe(F.col(f"y.{names[0]}"))
        for name in names[1:]:
            cond = cond & F.col(f"x.{name}").eqNullSafe(F.col(f"y.{name}"))
        return cond

    def compared(level, among=None):
        names = keys[:level + 1]
        sides = [at(before_df, level, "old"), at(now_df, level, "new")]
        if among is not None:
            sides = [side.alias("x").join(among.alias("y"), same(names[:-1]), "left_semi")
                     for side in sides]
        both = sides[0].alias("x").join(sides[1].alias("y"), same(names), "full")
        return both.where(~F.col("old").eqNullSafe(F.col("new"))).select(
            *[F.coalesce(f"x.{c}", f"y.{c}").alias(c) for c in keys],
            F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed")
            .otherwise("changed").alias("change"))

    return compared(2, compared(1, compared(0)))


def fingerprint(
    relations_df: DataFrame, profile_df: DataFrame, quality_df: DataFrame, signature: str = ""
) -> DataFrame:
    """One row of 12-digit hashes: schema, profiles, quality, and all of them together.

    They are the roots of the fingerprint tree; the signature of the catalog is part of the schema.
    """
    def short(text):
        return F.substring(F.sha2(text, 256), 1, DIGITS)

    lines = _lines(relations_df, profile_df, quality_df)
    roots = lines.groupBy("component").agg(_order_free(F.col("line")).alias("_sum"))
    one = roots.agg(*[
        F.coalesce(F.max(F.when(F.col("component") == part, F.col("_sum"))), F.lit("0:0")).alias(part)
        for part in ("schema", "profiles", "quality")
    ]).select(
        short(F.concat(F.lit(signature + "|"), "schema")).alias("schema"),
        short(F.col("profiles")).alias("profiles"), short(F.col("quality")).alias("quality"),
    )
    return one.withColumn("combined", short(F.concat_ws("+", "schema", "profiles", "quality")))


def stale_reason(prev_df: DataFrame, cur_df: DataFrame) -> DataFrame:
    """(reusable, reasons): which components changed since the last run.

    With no earlier run nothing is stale and nothing can be reused.
    """
    parts = ("schema", "profiles", "quality")
    before = prev_df.select(*[F.col(p).alias(f"old_{p}") for p in parts],
                            F.lit(True).alias("_seen"), F.lit(1).alias("_one"))
    both = cur_df.withColumn("_one", F.lit(1)).join(before, "_one", "left")
    seen = F.coalesce("_seen", F.lit(False))
    changed = F.filter(
        F.array(*[F.when(~F.col(p).eqNullSafe(F.col(f"old_{p}")), F.lit(p)) for p in parts]),
        lambda p: p.isNotNull(),
    )
    return both.select(
        (seen & (F.size(changed) == 0)).alias("reusable"),
        F.when(seen, changed).otherwise(F.array().cast("array<string>")).alias("reasons"),
    )
