"""What several operators share: session settings, whole texts as bytes, written cuts of lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of rows that go to a Python worker at once; one longer row goes alone.
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Bound the memory of a Python worker by bytes, not only by rows, and find the shared folder.

    The folder is the one named in `spark.checkpoint.dir`. Where none is named, a temporary folder
    is used in local mode, and anything else is an error: executors share no local folder.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tallyglass-checkpoint-")
        context.setCheckpointDir(folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one parquet table of a folder, by any path that Spark can open."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def whole_text(column: str = "text"):
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def held_out(column: str, modulo: int):
    """True where crc32 of the id as text leaves no remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulo == 0
