"""What the columns of a result are, and how one of them is distributed."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from tallyglass.functions import fixed
from tallyglass.functions.text import rlike_sql, stripped_sql
from tallyglass.operators.profile import cells, counted


def column_roles(df: DataFrame) -> DataFrame:
    """(column_name, role): temporal, numeric, categorical or other, judged on every row.

    Distinct values are counted from one grouped pass, not one `Expand` branch per column.
    """
    source = cells({"": df})
    tests = {"dated": fixed.ROLE_DATE, "numbered": fixed.ROLE_NUMBER}

    def tested(value: str) -> dict[str, str]:
        return {name: rlike_sql(stripped_sql(value), pattern) for name, pattern in tests.items()}

    # Long texts travel as a digest; their shape is read before that.
    values = counted(source, tested("cell")).where("value is not null or about is not null")
    values = values.selectExpr("c", "n", *[
        f"coalesce(about.{name}, {sql}) as {name}" for name, sql in tested("value").items()])
    facts = values.groupBy("c").agg(
        F.sum("n").alias("filled"), F.count("*").alias("distinct"),
        F.bool_and("dated").alias("dated"), F.bool_and("numbered").alias("numbered"),
    )
    listed = df.sparkSession.createDataFrame(
        [(i, name, kind, bool(re.search(fixed.ROLE_ID_NAME, name)),
          bool(re.search(fixed.ROLE_TIME_NAME, name)))
         for i, (_, name, kind) in enumerate(source.names, 1)],
        "c int, column_name string, kind string, is_id boolean, is_time boolean",
    )
    facts = listed.join(facts, "c", "left").fillna(0, ["filled", "distinct"])
    number = F.col("kind").isin("integer", "number") | ((F.col("kind") == "text")
                                                        & F.col("numbered"))
    few = F.col("distinct") <= F.greatest(F.lit(30), F.floor(F.col("filled") / 2))
    role = (
        F.when(F.col("filled") == 0, "other")
        .when((F.col("kind") == "temporal") | ((F.col("kind") == "text") & F.col("dated")),
              "temporal")
        .when(number & F.col("is_id"), "categorical")
        .when(number & F.col("is_time") & (F.col("distinct") > 2), "temporal")
        .when(number, "numeric")
        .when(few, "categorical").otherwise("other")
    )
    return facts.select("column_name", role.alias("role"))


def histogram(df: DataFrame, column: str, bins: int = 12) -> DataFrame:
    """(bin, low, high, n): equal bins from smallest to largest value, the last one closed."""
    value = F.col(column).cast("double")
    edges = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    width = F.coalesce(F.nullif((F.col("e.hi") - F.col("e.lo")) / bins, F.lit(0.0)), F.lit(1.0))
    placed = df.where(value.isNotNull()).select(value.alias("v"), edges.alias("e"))
    counted = placed.groupBy(
        F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("e.lo")) / width)).cast("int")
        .alias("bin")
    ).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"),
                                               edges.alias("e"))
    return every.where("e.lo is not null").join(counted, "bin", "left").select(
        "bin", (F.col("e.lo") + F.col("bin") * width).alias("low"),
        (F.col("e.lo") + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )
