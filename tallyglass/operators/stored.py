"""Profiles kept as mergeable state: only what is new is read again.

The state of a part of a table (a file, a day, a load) holds, for each column, counts, sums, typed
extremes, the bitmaps of whole numbers and a sketch of the other values. States of several parts fold
into the profile of them all. Counts, extremes, means, lengths and the distinct counts of whole
numbers are exact however the table is cut; other distinct counts are estimates and are marked
so (about 1.6 % off with the default sketch).

State rows: those with a NULL `bucket` hold facts, one for each part and column; the others one
bitmap each. Whole numbers get bitmaps where these are smaller than their values in that part, and a
sketch everywhere.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallyglass.functions import kinds
from tallyglass.functions.text import quoted
from tallyglass.operators import distinct
from tallyglass.operators.profile import text_sql

LG_K = 12
EXTREMES = {"integer": "bigint", "number": "double", "decimal": "decimal(38,18)",
            "temporal": "timestamp_ntz", "text": "string"}
STATE = [
    ("part", "string"), ("column_name", "string"), ("ordinal", "int"), ("declared_type", "string"),
    ("kind", "string"), ("bucket", "bigint"), ("bits", "binary"), ("n", "bigint"), ("known", "bigint"),
    ("total", "double"), ("whole", "decimal(38,0)"), ("length", "bigint"), ("sketch", "binary"),
    ("exact", "boolean"),
    *[(f"{side}_{k}", t) for k, t in EXTREMES.items() for side in ("low", "high")]]


def _shaped(df: DataFrame) -> DataFrame:
    """All columns of a state, NULL where the frame has none."""
    have = set(df.columns)
    return df.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in STATE])


def _extreme_kind(data_type: T.DataType) -> str | None:
    """Which of the typed extremes hold a column's values."""
    if isinstance(data_type, T.DecimalType):
        return "decimal"
    if isinstance(data_type, T.BooleanType):
        return "text"
    kind = kinds.kind_of(data_type)
    return kind if kind in EXTREMES else None


def _facts(df: DataFrame, part: str) -> DataFrame:
    """One row of facts for each part and column, in one pass."""
    aggregates, rows = [F.count("*").alias("n")], []
    for i, field in enumerate(df.schema.fields):
        if field.name == part:
            continue
        name, kind = "`" + field.name.replace("`", "``") + "`", kinds.kind_of(field.dataType)
        text = text_sql(field)
        own = _extreme_kind(field.dataType)
        aggregates += [
            F.expr(f"count({name})").alias(f"known_{i}"),
            F.expr(f"sum(length({text}))").alias(f"length_{i}"),
            F.expr(f"hll_sketch_agg(concat('=', {text}), {LG_K})").alias(f"sketch_{i}")]
        total = whole = "null"
        if kind == "number":
            total = f"total_{i}"
            aggregates.append(F.expr(f"sum(cast({name} as double))").alias(total))
        if kind == "integer":
            whole = f"whole_{i}"
            aggregates.append(F.expr(f"sum(cast({name} as decimal(38,0)))").alias(whole))
        extremes = []
        for k, t in EXTREMES.items():
            for side, function in (("low", "min"), ("high", "max")):
                value = "null"
                if k == own:
                    value = f"{side}_{i}"
                    aggregates.append(F.expr(f"{function}(cast({name} as {t}))").alias(value))
                extremes.append(f"'{side}_{k}', cast({value} as {t})")
        rows.append(
            f"named_struct('column_name', {quoted(field.name)}, 'ordinal', {i + 1}, 'declared_type', "
            f"{quoted(field.dataType.simpleString())}, 'kind', '{kind}', 'n', n, 'known', known_{i}, "
            f"'total', cast({total} as double), 'whole', cast({whole} as decimal(38,0)), "
            f"'length', length_{i}, 'sketch', sketch_{i}, {', '.join(extremes)})")
    return df.groupBy(part).agg(*aggregates).selectExpr(
        f"`{part}` as part", f"inline(array({', '.join(rows)}))")


def _bitmaps(df: DataFrame, part: str) -> tuple[DataFrame | None, list[str]]:
    """(part, column_name, bucket, bits) of dense whole numbers, and their columns' names."""
    names, parts = [], []
    for field in df.schema.fields:
        if field.name != part and kinds.kind_of(field.dataType) == "integer":
            names.append(field.name)
            quoted_name = "`" + field.name.replace("`", "``") + "`"
            parts.append(f"named_struct('c', {len(names)}, 'v', cast({quoted_name} as bigint))")
    if not names:
        return None, []
    values = df.selectExpr(f"`{part}` as part", f"inline(array({', '.join(parts)}))")
    fits = [c for c, yes in distinct.dense(values.select("c", "v")).items() if yes]
    if not fits:
        return None, []
    bits = values.where(F.col("c").isin(*fits) & F.col("v").isNotNull()).selectExpr(
        "part", "c", "bitmap_bucket_number(v) as bucket", "bitmap_bit_position(v) as bit"
    ).groupBy("part", "c", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    listed = ", ".join(quoted(n) for n in names)
    return bits.selectExpr("part", f"element_at(array({listed}), c) as column_name", "bucket",
                           "bits"), [names[c - 1] for c in fits]


def profile_state(df: DataFrame, part: str) -> DataFrame:
    """The state of a table, cut by the text column `part`; which columns take bitmaps is decided
    when this is called. NULL is a part of its own. The column `part` itself is not profiled."""
    df = df.withColumn(part, F.col(part).cast("string"))
    bits, exact = _bitmaps(df, part)
    facts = _facts(df, part).withColumn(
        "exact", F.col("column_name").isin(*exact) if exact else F.lit(False))
    return _shaped(facts) if bits is None else _shaped(facts).unionByName(_shaped(bits))


def merge_states(states: DataFrame, by: str | None = None) -> DataFrame:
    """States of parts folded into one of all (part NULL), or of each `by`, an expression over part.

    Bitmaps are united bucket by bucket, so they stay as small as the column is dense.
    """
    group = F.expr(by).cast("string") if by else F.lit(None).cast("string")
    rows = states.withColumn("part", group)
    facts = rows.where("bucket is null").groupBy("part", "column_name").agg(
        *[F.max(c).alias(c) for c in ("ordinal", "declared_type", "kind")],
        *[F.sum(c).cast(t).alias(c) for c, t in (
            ("n", "bigint"), ("known", "bigint"), ("total", "double"), ("whole", "decimal(38,0)"),
            ("length", "bigint"))],
        F.hll_union_agg("sketch").alias("sketch"),
        F.bool_and(F.col("exact") | (F.col("known") == 0)).alias("exact"),
        *[f(f"{side}_{k}").alias(f"{side}_{k}") for k in EXTREMES
          for side, f in (("low", F.min), ("high", F.max))])
    bits = rows.where("bucket is not null").groupBy("part", "column_name", "bucket").agg(
        F.expr("bitmap_or_agg(bits)").alias("bits"))
    return _shaped(facts).unionByName(_shaped(bits))


#: An extreme as the column's own type would show it.
SHOWN = {
    "integer": "cast({0} as string)",
    "number": "if(declared_type = 'float', cast(cast({0} as float) as string), cast({0} as string))",
    "decimal": "left(cast({0} as string), locate('.', cast({0} as string)) + if("
               "declared_type rlike ',0', -1, cast(regexp_extract(declared_type, ',(\\\\d+)', 1) as int)))",
    "temporal": "if(declared_type = 'date', cast(cast({0} as date) as string), cast({0} as string))",
    "text": "{0}",
}


def profile_of_state(states: DataFrame, table: str) -> DataFrame:
    """One row per column: counts, NULLs, distinct values, extremes, mean and length of all parts."""
    merged = merge_states(states)
    counted = merged.where("bucket is not null").groupBy("column_name").agg(
        F.sum(F.bitmap_count("bits")).alias("counted"))
    extremes = {side: "coalesce(" + ", ".join(
        sql.format(f"{side}_{k}") for k, sql in SHOWN.items()) + ")" for side in ("low", "high")}
    return merged.where("bucket is null").join(counted, "column_name", "left").selectExpr(
        f"{quoted(table)} as table_name", "column_name", "ordinal", "declared_type", "n as row_count",
        "n - known as null_count", "known as non_null_count", "1 - known / n as null_rate",
        "if(exact, coalesce(counted, 0), hll_sketch_estimate(sketch)) as distinct_count",
        "exact as distinct_is_exact", f"{extremes['low']} as min_value",
        f"{extremes['high']} as max_value",
        "coalesce(cast(whole as double), total) / known as mean_value",
        "length / known as avg_length")


# --- states of files -------------------------------------------------------------------------

VERSION = "concat_ws('|', _metadata.file_path, _metadata.file_size, _metadata.file_modification_time)"


def files_of(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """(path, version) of the files in a folder and its subfolders, from the listing alone."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", pattern).load(folder).selectExpr(
        "path", "concat_ws('|', path, length, modificationTime) as version")


def refresh(spark: SparkSession, folder: str, store: str) -> dict[str, int]:
    """Bring the state of a folder of parquet files up to date; returns what was done.

    Only files that are new or were replaced are read. States of files that are gone, or were
    replaced, stay in the store and are left out when it is read (see `stored_profile`). A run that
    is cut off adds nothing: a state is one committed write.
    """
    listed = files_of(spark, folder)
    try:
        known = spark.read.parquet(store).select(F.col("part").alias("version")).distinct()
        fresh = listed.join(known, "version", "left_anti")
        kept = listed.count()
    except AnalysisException:  # no store yet
        fresh, kept = listed, listed.count()
    paths = [r.path for r in fresh.select("path").collect()]  # names of files, not their rows
    if paths:
        new = spark.read.parquet(*paths).withColumn("__part", F.expr(VERSION))
        profile_state(new, "__part").write.mode("append").parquet(store)
    return {"files": kept, "read": len(paths)}


def stored_profile(spark: SparkSession, folder: str, store: str, table: str) -> DataFrame:
    """The profile of the files that are in the folder now, from their stored states."""
    states = spark.read.schema(", ".join(f"{c} {t}" for c, t in STATE)).parquet(store)
    now = files_of(spark, folder).select(F.col("version").alias("part"))
    return profile_of_state(states.join(now, "part", "left_semi"), table)
