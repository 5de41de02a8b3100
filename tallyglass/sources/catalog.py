"""What tables and columns exist, a signature of that, and its history.

A catalog is as large as the number of columns, not rows; it is the only thing the driver reads.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyglass.functions import kinds

COLUMN_SCHEMA = (
    "schema_name string, table_name string, column_name string, ordinal int, "
    "data_type string, nullable boolean, default_value string"
)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _local(metadata_df: DataFrame) -> DataFrame:
    """Catalog rows as a local relation: at most one per table or column."""
    return metadata_df.sparkSession.createDataFrame(metadata_df.collect(), metadata_df.schema)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table; parquet answers a bare count from its footers."""
    return union_all([
        df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ])


def table_columns(spark: SparkSession, tables: dict[str, DataFrame], schema: str) -> DataFrame:
    rows = [
        (schema, name, field.name, i, field.dataType.simpleString(), field.nullable, None)
        for name, df in tables.items()
        for i, field in enumerate(df.schema.fields, start=1)
    ]
    return spark.createDataFrame(rows, COLUMN_SCHEMA)


def unique_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """Key columns by their values: key-like name, no NULL, as many distinct values as rows.

    Candidates are judged by name and type first, then by their range: whole numbers with NULLs, or
    with fewer numbers between the smallest and the largest than rows, cannot all differ. Only
    the values of what is left are shuffled. Stands in for the primary keys a parquet folder
    cannot declare.
    """
    likely = _likely_keys(tables)
    names, cells = [], []
    for name, df in tables.items():
        structs = []
        for column in likely.get(name, []):
            structs.append(f"named_struct('c', {len(names)}, 'v', cast(`{column}` as bigint))")
            names.append((len(names), name, column))
        if structs:
            cells.append(df.selectExpr(f"inline(array({', '.join(structs)}))"))
    spark = next(iter(tables.values())).sparkSession
    listed = spark.createDataFrame(names, "c int, table_name string, column_name string")
    if not cells:
        return listed.drop("c")
    # Counting per value lets map-side sums absorb a hot value before anything moves.
    per_value = union_all(cells).groupBy("c", "v").agg(F.count("*").alias("n"))
    full = per_value.groupBy("c").agg(
        F.max("n").alias("most"), F.count_if(F.col("v").isNull()).alias("n_null")
    ).where("most = 1 and n_null = 0")
    return listed.join(full, "c").select("table_name", "column_name")


def _likely_keys(tables: dict[str, DataFrame]) -> dict[str, list[str]]:
    """Key-named whole-number columns whose range leaves room for all rows; one row per table."""
    parts = []
    for name, df in tables.items():
        fits = [
            f"if(count(`{f.name}`) = count(*) and cast(max(`{f.name}`) as decimal(20,0)) "
            f"- min(`{f.name}`) + 1 >= count(*), '{f.name}', null)"
            for f in df.schema.fields
            if kinds.kind_of(f.dataType) == "integer" and kinds.is_key_name(f.name)
        ]
        if fits:
            parts.append(df.selectExpr(f"array_compact(array({', '.join(fits)})) as likely").select(
                F.lit(name).alias("table_name"), "likely"))
    return {r.table_name: r.likely for r in union_all(parts).collect()} if parts else {}


def build_catalog(
    tables: dict[str, DataFrame], keys: DataFrame | None = None, schema: str = "main",
    comments: dict[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Return (tables, columns). `keys` holds (table_name, column_name) of the primary keys.

    Both are read off the tables once, here: they are as small as the schema, and everything
    later joins them many times.
    """
    spark = next(iter(tables.values())).sparkSession
    comments = comments or {}
    notes = F.lit(None).cast("string")
    for name, comment in comments.items():
        notes = F.when(F.col("table_name") == name, F.lit(comment)).otherwise(notes)
    tables_df = _local(row_counts(tables)).select(
        F.lit(schema).alias("schema_name"), "table_name", F.lit("table").alias("kind"), "n_rows",
        notes.alias("comment"),
    )
    columns_df = table_columns(spark, tables, schema)
    keys = _local((unique_keys(tables) if keys is None else keys).select(
        "table_name", "column_name"))
    marked = keys.withColumn("_key", F.lit(True))
    columns_df = columns_df.join(marked, ["table_name", "column_name"], "left").select(
        "schema_name", "table_name", "column_name", "ordinal", "data_type", "nullable",
        "default_value", F.coalesce("_key", F.lit(False)).alias("is_pk"),
    )
    return tables_df, columns_df


def schema_signature(columns_df: DataFrame, relations_df: DataFrame | None = None) -> DataFrame:
    """SHA-256 per table, for the relations, and over everything (`scope = 'total'`)."""
    def digest(line):
        return F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(line))), 256)

    line = F.concat_ws(",", "column_name", "data_type", F.col("nullable").cast("string"),
                       F.col("is_pk").cast("string"))
    parts = columns_df.groupBy("table_name").agg(digest(line).alias("signature")).select(
        F.lit("table").alias("scope"), "table_name", "signature"
    )
    if relations_df is not None:
        edge = F.concat_ws(",", "from_table", "from_column", "to_table", "to_column", "kind")
        parts = parts.unionByName(relations_df.agg(digest(edge).alias("signature")).select(
            F.lit("relations").alias("scope"), F.lit("*").alias("table_name"), "signature"
        ))
    whole = F.concat_ws(",", "scope", "table_name", "signature")
    total = parts.agg(digest(whole).alias("signature")).select(
        F.lit("total").alias("scope"), F.lit("*").alias("table_name"), "signature"
    )
    return parts.unionByName(total)


def append_snapshot(snapshots_df: DataFrame, signature_df: DataFrame) -> DataFrame:
    """Schema history after a scan: a new version only when the total signature differs.

    `snapshots_df`: version, signature, table_count, is_current.
    """
    scanned = signature_df.agg(
        F.max(F.when(F.col("scope") == "total", F.col("signature"))).alias("signature"),
        F.count_if(F.col("scope") == "table").cast("int").alias("table_count"),
    ).select(F.lit(None).cast("int").alias("version"), "signature", "table_count",
             F.lit(True).alias("is_current"), F.lit(True).alias("_new"))
    # A history has one row per version, so it may sit in one window.
    history = Window.partitionBy(F.lit(0))
    known = snapshots_df.withColumn("_new", F.lit(False)).unionByName(scanned)
    current = F.max(F.when(F.col("is_current") & ~F.col("_new"), F.col("signature"))).over(history)
    seen = F.max(F.when(F.col("_new"), F.col("signature"))).over(history)
    latest = F.coalesce(F.max("version").over(history), F.lit(0))
    return known.withColumn("_changed", ~current.eqNullSafe(seen)).withColumn(
        "_next", latest + 1
    ).where("not _new or _changed").select(
        F.coalesce("version", "_next").alias("version"), "signature", "table_count",
        (F.col("_new") | (F.col("is_current") & ~F.col("_changed"))).alias("is_current"),
    )
