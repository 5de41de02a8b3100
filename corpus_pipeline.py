"""The corpus pipeline: five stages over `documents`, each written and read again before the next.

1. toxicity: documents scored 0.5 or more go (learned from labels outside the held-out fold);
2. near-duplicates: one document of each group of linked fingerprints stays, the smallest id; rows
   without an id, or with a repeated one, are in a group by their text alone;
3. decontamination: documents that hold a passage of the benchmark go;
4. secrets: live-looking secrets are replaced in the text, n_chars follows;
5. tokens: token ids, their number, and whether decoding gives the text back.

Every stage keeps rows with null ids or texts unless its own decision removes them, works on
everything its predecessor kept, and returns the columns of documents; the last adds its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyglass.llm import bpe, contamination, secrets, simhash, toxicity
from tallyglass.llm.common import prepare, table
from tallyglass.llm.queries import CUTS, ONE_PIECE, tokenizer, toxicity_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC = 0.5


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below TOXIC; null texts count as empty."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=tuple(COLUMNS)).where(
        F.col("score") < TOXIC).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each component, nulls last, once; of several rows with
    that id the smallest by the other columns."""
    return simhash.one_of_each(docs, tuple(COLUMNS))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return contamination.contaminated(
        docs, table(spark, sf_dir, "benchmark"), keep=tuple(COLUMNS)).where(
        F.size("found") == 0).select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking secrets replaced; null texts stay null."""
    scanned = secrets.scan(docs.withColumn("__repository", F.concat_ws("/", "source", "lang")),
                           keep=tuple(COLUMNS), repository="__repository")
    changed = F.size("spans") > 0
    return secrets.redact(scanned).withColumns({
        "text": F.when(changed, F.col("__text")).otherwise(F.col("text")),
        "n_chars": F.when(changed, F.char_length("__text").cast("long")).otherwise(F.col("n_chars")),
    }).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with token_ids (binary, unsigned 32-bit), n_tokens and round_trip."""
    ranks, pattern = tokenizer(spark)
    return bpe.round_trip(docs, ranks, pattern, keep=tuple(COLUMNS), cuts=CUTS,
                          one_piece=ONE_PIECE).select(
        *COLUMNS, "token_ids", F.expr("length(token_ids) div 4").alias("n_tokens"),
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"))


STAGES = [
    ("toxicity", not_toxic),
    ("simhash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("secret scan", without_secrets),
    ("byte-level bpe", tokens),
]

#: The stages score with a trained network and hash by XXH64: SQL has neither.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    """Remove a folder of the shared store, by any path that Spark can open."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again.

    A stage's table goes when the next one is written, or when a stage fails; the last one stays, as
    the result is computed from it.
    """
    prepare(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    try:
        for number, (_, stage) in enumerate(STAGES[:-1]):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
            docs = spark.read.parquet(f"{folder}/{number}")
            if number:
                _remove(spark, f"{folder}/{number - 1}")
    except Exception:
        _remove(spark, folder)
        raise
    return STAGES[-1][1](spark, docs, sf_dir)
