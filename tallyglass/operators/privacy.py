"""Personal data behind stable tokens, and back again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyglass.functions import fixed


def _prefix(kind: str) -> str:
    return fixed.TOKEN_PREFIXES.get(kind, fixed.OTHER_PREFIX)


def token(kind: str, value: Column, salt: str = "") -> Column:
    """The token of a value: the prefix of its kind and digits from a salted hash of both.

    Two parts of 60 bits keep distinct values apart; no table of values is needed to make one, and
    equal values get equal tokens everywhere.
    """
    digest = F.sha2(F.concat_ws("|", F.lit(salt), F.lit(kind), value), 256)
    parts = [F.lpad(F.conv(F.substring(digest, at, 15), 16, 10), 19, "0") for at in (1, 16)]
    return F.when(value.isNotNull(), F.concat(F.lit(_prefix(kind) + "-"), *parts))


def _present(df: DataFrame, pii: dict[str, str]) -> dict[str, str]:
    present = {c: kind for c, kind in pii.items() if c in df.columns}
    if not present:
        raise ValueError("none of the columns to protect is in the table")
    return present


def token_mapping(df: DataFrame, pii: dict[str, str], salt: str = "") -> DataFrame:
    """(column_name, pii_type, value, token) for every distinct value of the PII columns."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(kind).alias("pii_type"),
                 F.col(c).cast("string").alias("value"),
                 token(kind, F.col(c).cast("string"), salt).alias("token"))
        for c, kind in _present(df, pii).items()
    ])
    return df.select(F.inline(cells)).where("value is not null").distinct()


def store_mapping(mapping_df: DataFrame, folder: str) -> DataFrame:
    """Write a mapping, by column, to a folder only its keepers can read, and read it from there.

    The mapping holds every real value: see `forget_mapping`.
    """
    mapping_df.write.partitionBy("column_name").parquet(folder)
    return mapping_df.sparkSession.read.schema(mapping_df.schema).parquet(folder)


def forget_mapping(spark: SparkSession, folder: str) -> None:
    """Delete a stored mapping; from then on tokens cannot be turned back."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pseudonymize(df: DataFrame, pii: dict[str, str], salt: str = "") -> tuple[DataFrame, DataFrame]:
    """(safe table, mapping): each personal value replaced by its token, NULL kept.

    The safe table is made row by row, without a join. The mapping is needed only for the way back;
    it is computed when it is used, and stored only by `store_mapping`.
    """
    present = _present(df, pii)
    safe = df.withColumns({c: token(kind, F.col(c).cast("string"), salt)
                           for c, kind in present.items()})
    return safe, token_mapping(df, pii, salt)


def reidentify(
    texts_df: DataFrame, mapping_df: DataFrame, id_col: str, text_cols: list[str]
) -> DataFrame:
    """Put real values back wherever a whole token stands in a text; unknown tokens stay.

    Each text is cut once into plain pieces and tokens. Distinct tokens of an id are looked up and
    come back as one small map, so a token repeated a thousand times, or in a thousand rows of one
    id, is one lookup.
    """
    pattern = F.lit(fixed.TOKEN)
    found = F.array_distinct(F.flatten(F.array(*[
        F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), pattern, F.lit(0))
        for c in text_cols
    ])))
    values = mapping_df.select("token", "value").distinct()
    known = texts_df.select(id_col, F.explode(found).alias("token")).distinct().join(
        values, "token"
    ).groupBy(id_col).agg(
        F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("_real")
    )

    def restored(column: Column) -> Column:
        pieces = F.split(column, fixed.TOKEN, -1)
        tokens = F.regexp_extract_all(column, pattern, F.lit(0))
        return F.array_join(F.zip_with(pieces, tokens, lambda piece, t: F.concat(
            piece, F.coalesce(F.try_element_at("_real", t), t, F.lit("")))), "")

    joined = texts_df.join(known, id_col, "left")
    return joined.select(*[
        F.when(F.col("_real").isNull() | F.col(c).isNull(), F.col(c))
        .otherwise(restored(F.col(c))).alias(c) if c in text_cols else F.col(c)
        for c in texts_df.columns
    ])


def privacy_audit(mapping_df: DataFrame) -> DataFrame:
    """(column_name, pii_type, method, values_protected)."""
    return mapping_df.groupBy("column_name", "pii_type").agg(
        F.count("*").alias("values_protected")
    ).select("column_name", "pii_type", F.lit("pseudonymisation").alias("method"),
             "values_protected")
