"""The shapes a measure question can take: preview, counts, aggregates, top rows, named measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyglass.functions.buckets import time_bucket

AGGREGATES = {"sum": F.sum, "avg": F.avg}


def preview(
    df: DataFrame, n: int = 100, max_cols: int = 12, order_by: str | None = None
) -> DataFrame:
    """The first columns of `n` rows; give `order_by` for a repeatable choice of rows."""
    shown = df.select(*df.columns[:max_cols])
    return (shown.orderBy(order_by) if order_by else shown).limit(n)


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def _group(by: str | tuple[str, str]) -> tuple[Column, str, bool]:
    """`"status"` groups by a column, `("order_date", "month")` by a time bucket."""
    if isinstance(by, str):
        return F.col(by), by, False
    column, unit = by
    return time_bucket(column, unit), unit, True


def _grouped(df: DataFrame, by, measures: list[Column], rank: str) -> DataFrame:
    key, name, is_time = _group(by)
    result = df.groupBy(key.alias(name)).agg(*measures)
    return result.orderBy(name) if is_time else result.orderBy(F.desc_nulls_last(rank), name)


def count_by(df: DataFrame, by: str | tuple[str, str]) -> DataFrame:
    """Rows per value or time bucket: time ascending, otherwise largest first."""
    return _grouped(df, by, [F.count("*").alias("total")], "total")


def aggregate(df: DataFrame, measure: str, fn: str) -> DataFrame:
    return df.agg(AGGREGATES[fn](measure).alias(f"{fn}_{measure}"))


def aggregate_by(df: DataFrame, measure: str, fn: str, by: str | tuple[str, str]) -> DataFrame:
    """Sum or average per value or time bucket; the grouping column is never the measure."""
    if measure in (by, by[0]):
        raise ValueError("a grouping key cannot be measured")
    name = f"{fn}_{measure}"
    return _grouped(df, by, [AGGREGATES[fn](measure).alias(name)], name)


def top_n(df: DataFrame, order_col: str, n: int = 10, tie: str | None = None) -> DataFrame:
    """The `n` largest rows by a column, NULLs last; `tie` makes equal rows repeatable."""
    order = [F.desc_nulls_last(order_col)] + ([F.asc(tie)] if tie else [])
    return df.orderBy(*order).limit(n)


# --- named measures and segments -------------------------------------------------------------

DEFINITION_SCHEMA = "name string, kind string, table_name string, expression string, filter string"


def upsert_definitions(existing_df: DataFrame, new_df: DataFrame) -> DataFrame:
    """Replace definitions by name; a measure needs an expression and a segment a filter."""
    valid = new_df.where(
        "(kind = 'measure' and coalesce(expression, '') <> '') "
        "or (kind = 'segment' and coalesce(filter, '') <> '')"
    )
    kept = existing_df.join(valid, "name", "left_anti")
    return kept.unionByName(valid)


def _definition(defs_df: DataFrame, name: str, kind: str):
    found = defs_df.where((F.col("name") == name) & (F.col("kind") == kind)).head()
    if found is None:
        raise KeyError(f"no {kind} named {name!r}")
    return found


def register(tables: dict[str, DataFrame]) -> None:
    """Make tables known by name, so that a predicate may use a sub-query on them."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def measure(
    defs_df: DataFrame, name: str, tables: dict[str, DataFrame],
    by: str | tuple[str, str] | None = None, segments: tuple[str, ...] = (),
) -> DataFrame:
    """A named measure, whole or by a bucket, restricted to segments of the same table."""
    register(tables)
    found = _definition(defs_df, name, "measure")
    df = tables[found.table_name]
    if found.filter:
        df = df.where(found.filter)
    for segment_name in segments:
        part = _definition(defs_df, segment_name, "segment")
        if part.table_name == found.table_name:
            df = df.where(part.filter)
    value = F.expr(found.expression).alias(name)
    return df.agg(value) if by is None else _grouped(df, by, [value], name)


def segment(
    defs_df: DataFrame, name: str, tables: dict[str, DataFrame], mode: str = "count",
    n: int = 100, order_by: str | None = None,
) -> DataFrame:
    """A named population: its size, or a preview of it. Sub-query filters become semi joins."""
    register(tables)
    found = _definition(defs_df, name, "segment")
    population = tables[found.table_name].where(found.filter)
    return count_rows(population) if mode == "count" else preview(population, n, order_by=order_by)
