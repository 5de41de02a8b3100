"""Previous value without sorting a whole table, or a whole key, in one task.

A plain ordered window puts every row of its key into one task. Here the rows are first cut into
ranges of the order column, at its percentiles, so that all ranges have about as many rows, however
these crowd in time. Windows work inside the ranges, and the last value of each range is
carried over by one small row per range and key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


MOST_ROWS = 1_000_000
MOST_RANGES = 4096


def _position(order: str, kind: str) -> Column:
    """The order column as a number that follows it."""
    column = F.col(order)
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(column.cast("timestamp"))
    return column.cast("double") if kind in ("double", "float", "decimal") else column.cast("long")


def cut_points(df: DataFrame, position: Column, rows: int = MOST_ROWS,
               most: int = MOST_RANGES) -> list:
    """Percentiles of a column at which it falls into ranges of about `rows` rows, ascending.

    One counting pass and one pass with a sketch; at most `most` numbers reach the driver.
    """
    known = df.select(position.alias("_p")).where("_p is not null")
    ranges = min(-(-known.count() // rows), most)
    if ranges < 2:
        return []
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = known.agg(F.percentile_approx("_p", shares, 4 * most).alias("cuts")).first().cuts
    return sorted(set(cuts))


def range_of(position: Column, cuts: list) -> Column:
    """The number of cut points at or below a value, found in two steps; NULL is in range 0."""
    if not cuts:
        return F.lit(0)
    width = max(int(len(cuts) ** .5), 1)
    groups = [cuts[i:i + width] for i in range(0, len(cuts), width)]

    def below(points) -> Column:
        return F.size(F.filter(points, lambda cut: cut <= position))

    def literals(points) -> Column:
        return F.array(*[F.lit(x) for x in points])

    coarse = F.greatest(below(literals([g[0] for g in groups])) - 1, F.lit(0))
    fine = below(F.element_at(F.array(*[literals(g) for g in groups]), coarse + 1))
    return F.coalesce(F.when(position.isNotNull(), coarse * width + fine), F.lit(0)).cast("int")


def previous_value(
    df: DataFrame, order: str, value: str, out: str, keys: tuple[str, ...] = (),
    unit: str | None = None, rows: int = MOST_ROWS,
) -> DataFrame:
    """Add `out`: the last non-NULL `value` before this row, by `order` within `keys`.

    `order` must be unique within a key. Ranges of timestamps and numbers are found when this is
    called, from the percentiles of all rows, so a range holds about `rows` rows of all keys together;
    where `unit` names a calendar unit, timestamps are cut by that instead. Dates and text periods
    (`yyyy-MM`, `yyyy-MM-dd`) are cut by year, which holds 366 of them at most.
    """
    kind = df.schema[order].dataType.typeName()
    if kind == "string":
        bucket = F.substring(order, 1, 4)
    elif kind == "date":
        bucket = F.date_format(order, "yyyy")
    elif unit is not None:
        bucket = F.date_format(F.date_trunc(unit, F.col(order)), "yyyy-MM-dd HH:mm")
    else:
        position = _position(order, kind)
        bucket = range_of(position, cut_points(df, position, rows))
    parts = df.withColumn("_bucket", bucket)
    within = (
        Window.partitionBy(*keys, "_bucket").orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    across = (
        Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    last_known = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))
    named = {c: f"_of_{c}" for c in (*keys, "_bucket")}
    edges = parts.groupBy(*keys, "_bucket").agg(last_known.alias("_edge")).select(
        *[F.col(c).alias(new) for c, new in named.items()],
        F.last("_edge", ignorenulls=True).over(across).alias("_carried"),
    )
    same = [F.col(c).eqNullSafe(F.col(new)) for c, new in named.items()]
    return (
        parts.join(edges, reduce(Column.__and__, same), "left")
        .withColumn(
            out, F.coalesce(F.last(value, ignorenulls=True).over(within), F.col("_carried"))
        )
        .select(*df.columns, out)
    )
