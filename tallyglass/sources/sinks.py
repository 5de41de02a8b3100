"""Results written out: the business dictionary and the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

AUDIT_COLUMNS = (
    "analysis_id", "created_at", "question", "query", "tables_used", "columns_used", "status",
    "block_reason", "estimated_cost", "row_count", "duration_ms", "truncated", "confidence",
)


def export_dictionary(mappings_df: DataFrame, concepts_df: DataFrame) -> DataFrame:
    """Every mapping that was not rejected, with its concept and `;`-joined synonyms."""
    return mappings_df.where("status <> 'rejected'").join(concepts_df, "concept").select(
        "concept", "description", F.concat_ws(";", "synonyms").alias("synonyms"),
        "table_name", "column_name", "status", "confidence", "rationale",
    )


def write_dictionary(dictionary_df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Save the export as CSV or JSON lines."""
    ordered = dictionary_df.orderBy("concept", "table_name", "column_name")
    if fmt == "csv":
        ordered.write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "json":
        ordered.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown export format {fmt!r}")


def append_audit(audit_df: DataFrame, path: str) -> None:
    """Append immutable audit rows to a parquet log partitioned by day."""
    missing = [c for c in AUDIT_COLUMNS if c not in audit_df.columns]
    if missing:
        raise ValueError(f"audit rows lack {missing}")
    rows = audit_df.select(*AUDIT_COLUMNS, F.to_date("created_at").alias("day"))
    # Rebalancing splits a large day and joins small ones by size, whatever their number of rows.
    rows.hint("rebalance", F.col("day")).write.mode("append").partitionBy("day").parquet(path)


def read_audit(spark, path: str) -> DataFrame:
    """The whole log; filters on `day` prune its folders."""
    return spark.read.parquet(path)
