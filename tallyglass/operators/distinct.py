"""Exact distinct counts; those of whole numbers by bitmaps, without a shuffle of values.

A bitmap of 4 kB holds the numbers of a range of 32,768. A task makes one for each range that it
meets, and bitmaps of a range are united. That is far smaller than the values where these lie close
together in a task (keys, codes), and far larger where they do not (hashes, random numbers). So
the bitmaps that the tasks would make are counted first, by a sketch, and only columns for which they
are smaller than their values take this way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyglass.functions import kinds
from tallyglass.functions.text import quoted
from tallyglass.sources.catalog import union_all

BITMAP_BYTES, VALUE_BYTES = 4096, 8
ALWAYS_BYTES = 1 << 20  # bitmaps up to this size are never too large


def whole_numbers(tables: dict[str, DataFrame]) -> tuple[list[tuple[str, str]], DataFrame | None]:
    """The names of all whole-number columns, and (c, v): their values, c numbering the names from 1."""
    names, parts = [], []
    for table, df in tables.items():
        structs = []
        for field in df.schema.fields:
            if kinds.kind_of(field.dataType) == "integer":
                names.append((table, field.name))
                name = "`" + field.name.replace("`", "``") + "`"
                structs.append(f"named_struct('c', {len(names)}, 'v', cast({name} as bigint))")
        if structs:
            parts.append(df.selectExpr(f"inline(array({', '.join(structs)}))"))
    return names, union_all(parts) if parts else None


def dense(values: DataFrame) -> dict[int, bool]:
    """For each column number of (c, v), whether bitmaps are smaller than its values."""
    pieces = values.where("v is not null").selectExpr(
        "c", "xxhash64(spark_partition_id(), bitmap_bucket_number(v)) as piece")
    facts = pieces.groupBy("c").agg(
        F.count("*").alias("n"), F.approx_count_distinct("piece").alias("pieces")).collect()
    return {r.c: r.pieces * BITMAP_BYTES <= max(r.n * VALUE_BYTES, ALWAYS_BYTES) for r in facts}


def by_bitmaps(values: DataFrame) -> DataFrame:
    """(c, distinct_count) of (c, v), exactly."""
    return values.where("v is not null").selectExpr(
        "c", "bitmap_bucket_number(v) as bucket", "bitmap_bit_position(v) as bit"
    ).groupBy("c", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).groupBy("c").agg(
        F.sum(F.bitmap_count("bits")).alias("distinct_count"))


def by_values(values: DataFrame) -> DataFrame:
    """(c, distinct_count) of (c, v): every distinct value is shuffled once."""
    return values.where("v is not null").distinct().groupBy("c").agg(
        F.count("*").alias("distinct_count"))


def distinct_numbers(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, row_count, non_null_count, distinct_count) of all whole-number
    columns, exactly. Which columns take bitmaps is decided when this is called."""
    names, values = whole_numbers(tables)
    if values is None:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], "table_name string, column_name string, row_count bigint, "
                                         "non_null_count bigint, distinct_count bigint")
    fits = dense(values)
    small = [c for c, yes in fits.items() if yes]
    large = [c for c, yes in fits.items() if not yes]
    parts = [by_bitmaps(values.where(F.col("c").isin(*small)))] if small else []
    parts += [by_values(values.where(F.col("c").isin(*large)))] if large else []
    rows = values.groupBy("c").agg(F.count("*").alias("row_count"),
                                   F.count("v").alias("non_null_count"))
    counts = rows if not parts else rows.join(union_all(parts), "c", "left")
    if not parts:
        counts = counts.withColumn("distinct_count", F.lit(0).cast("long"))
    every = values.sparkSession.range(1, len(names) + 1).select(F.col("id").cast("int").alias("c"))
    tables_of = ", ".join(quoted(t) for t, _ in names)
    columns_of = ", ".join(quoted(c) for _, c in names)
    return every.join(counts, "c", "left").selectExpr(
        f"element_at(array({tables_of}), c) as table_name",
        f"element_at(array({columns_of}), c) as column_name",
        *[f"coalesce({x}, 0) as {x}" for x in ("row_count", "non_null_count", "distinct_count")])


def unique_numbers(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, distinct_count): whole-number columns without NULL whose every
    value is different."""
    return distinct_numbers(tables).where(
        "row_count > 0 and non_null_count = row_count and distinct_count = row_count").select(
        "table_name", "column_name", "distinct_count")
