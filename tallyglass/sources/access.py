"""Reading less than everything on purpose: samples, bounded results, governed views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def sampled(df: DataFrame, fraction: float, *key: str) -> DataFrame:
    """The rows whose key's hash lies under `fraction`; everything from one on.

    A sample is asked for, never a matter of size. The same key is in or out in every table, at
    every scale and on every pass.
    """
    if fraction >= 1:
        return df
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in key])
    return df.where(F.substring(F.md5(text), 1, 8) < f"{max(0, round(fraction * 2 ** 32)):08x}")


def bounded(df: DataFrame, row_limit: int) -> DataFrame:
    """At most `row_limit` rows, with `truncated` true only if there were more.

    One row more than asked for is taken, once; both answers come from those rows.
    """
    everything = Window.partitionBy()
    return df.limit(row_limit + 1).withColumn(
        "truncated", F.count("*").over(everything) > row_limit
    ).withColumn("_i", F.row_number().over(everything.orderBy(F.lit(1)))).where(
        F.col("_i") <= row_limit).drop("_i")


def hidden(exceptions_df: DataFrame, space: str) -> DataFrame:
    """Lower-cased (table, column) pairs a team must not see; a NULL column hides the table."""
    return exceptions_df.where(F.col("space") == space).select(
        F.lower("table_name").alias("hidden_table"), F.lower("column_name").alias("hidden_column")
    ).distinct()


def govern(
    tables: dict[str, DataFrame], exceptions_df: DataFrame, space: str
) -> dict[str, DataFrame]:
    """Tables as a team may see them. Exceptions are catalog-sized and read by the driver."""
    gone = {(r.hidden_table, r.hidden_column) for r in hidden(exceptions_df, space).collect()}
    return {
        name: df.drop(*[c for c in df.columns if (name.lower(), c.lower()) in gone])
        for name, df in tables.items() if (name.lower(), None) not in gone
    }


def governance_view(columns_df: DataFrame, exceptions_df: DataFrame, space: str) -> DataFrame:
    """Every column of the catalog with the state of its table and its own."""
    exceptions = hidden(exceptions_df, space)
    whole = exceptions.where("hidden_column is null").select(
        F.col("hidden_table").alias("_t"), F.lit(False).alias("_table_on")
    )
    single = exceptions.where("hidden_column is not null").select(
        F.col("hidden_table").alias("_ct"), F.col("hidden_column").alias("_c"),
        F.lit(False).alias("_column_on"),
    )
    table, column = F.lower("table_name"), F.lower("column_name")
    return (
        columns_df
        .join(whole, table == F.col("_t"), "left")
        .join(single, (table == F.col("_ct")) & (column == F.col("_c")), "left")
        .select(
            "table_name", "column_name", "data_type",
            F.coalesce("_table_on", F.lit(True)).alias("table_enabled"),
            F.coalesce("_column_on", F.lit(True)).alias("column_enabled"),
        )
    )


def visible_columns(columns_df: DataFrame, exceptions_df: DataFrame, space: str) -> DataFrame:
    """The catalog without anything switched off for the team."""
    return governance_view(columns_df, exceptions_df, space).where(
        "table_enabled and column_enabled"
    ).select("table_name", "column_name", "data_type")
