"""Delimited text files as typed tables."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyglass.functions import fixed

BOM = "﻿"


def table_name(path: str) -> str:
    """`/x/Ventes 2024.csv` as `ventes_2024`."""
    stem = os.path.splitext(os.path.basename(path.rstrip("/")))[0]
    name = re.sub(r"\W+", "_", stem, flags=re.ASCII).strip("_").lower()
    return name if name and not name[0].isdigit() else f"t_{name}"


def find_delimiter(lines: DataFrame) -> str:
    """The delimiter that cuts every line alike, or else every line most often; by all lines."""
    bare = lines.where("trim(value) <> ''").select(
        F.regexp_replace("value", '"[^"]*"', "").alias("line"))
    counts = [F.length("line") - F.length(F.translate("line", d, "")) for d in fixed.DELIMITERS]
    seen = bare.agg(*[f(c).alias(f"{name}_{i}") for i, c in enumerate(counts)
                      for name, f in (("low", F.min), ("high", F.max))]).first()
    if seen["low_0"] is None:
        raise ValueError("the file is empty")
    ranked = [(seen[f"low_{i}"] == seen[f"high_{i}"] > 0, seen[f"low_{i}"], -i)
              for i in range(len(fixed.DELIMITERS))]
    best = max(ranked)
    return fixed.DELIMITERS[-best[2]] if best[1] > 0 else ","


def read_delimited(
    spark: SparkSession, path: str, name: str | None = None, sep: str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Read one file or a folder of files whose first row is a header.

    Types come from every row, not a sample: a column is BIGINT when all its values are whole
    numbers, DOUBLE when all are numbers (decimal comma accepted), and text otherwise. Without
    `sep` all lines decide on it. Files are split among tasks line by line, so an unclosed quote
    spoils one line at most; quoted fields that span lines need `multi_line`, one task per file.
    """
    if sep is None:
        sep = find_delimiter(spark.read.text(path))

    reader = (
        spark.read.option("sep", sep)
        .option("header", True).option("inferSchema", False)
        .option("multiLine", multi_line).option("quote", '"').option("escape", '"')
        .option("nullValue", "").option("emptyValue", "")
    )
    raw = reader.csv(path)
    if not any(c.startswith("_c") for c in raw.columns):
        # Files of a folder must agree on their headers; Spark cannot check blank ones.
        raw = reader.option("enforceSchema", False).csv(path)
    names = []
    for i, column in enumerate(raw.columns):
        plain = column.lstrip(BOM).strip()
        # Spark names a blank header cell _c<i>
        names.append(f"col_{i}" if plain in ("", f"_c{i}") else plain)
    raw = raw.toDF(*names).select(
        *[F.when(F.col(f"`{n}`") != "", F.col(f"`{n}`")).alias(n) for n in names]
    )
    return _typed(raw).alias(name or table_name(path))


def _typed(raw: DataFrame) -> DataFrame:
    tests = []
    for i, name in enumerate(raw.columns):
        value = F.col(f"`{name}`")
        tests += [
            # Longer whole numbers do not fit a BIGINT and are read as DOUBLE.
            F.bool_and(value.rlike(fixed.FILE_INTEGER) & (F.length(value) <= 18))
            .alias(f"int_{i}"),
            F.bool_and(F.regexp_replace(value, ",", ".").rlike(fixed.FILE_REAL)).alias(f"num_{i}"),
        ]
    seen = raw.agg(*tests).first()
    typed = []
    for i, name in enumerate(raw.columns):
        value = F.col(f"`{name}`")
        if seen[f"int_{i}"]:
            value = value.cast("bigint")
        elif seen[f"num_{i}"]:
            value = F.regexp_replace(value, ",", ".").cast("double")
        typed.append(value.alias(name))
    return raw.select(*typed)
