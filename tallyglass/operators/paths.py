"""Join paths over several hops of the entity graph, with what a join along them does to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyglass.operators.relations import EDGE, _edge_values

MOST_HOPS = 6


def edge_steps(relations_df: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Both directions of every relation that was not rejected, measured on all rows.

    Returns source, source_column, target, target_column, fan_out and kept: how many rows of the
    target a matched row of the source meets on average, and which share of the source's filled
    keys is matched. Counting values before the join keeps a hot key one row. The relation list
    is catalog-sized and read by the driver.
    """
    usable = relations_df.where("status <> 'rejected'") if "status" in relations_df.columns \
        else relations_df
    edges = [r.asDict() for r in usable.select(*EDGE).distinct().orderBy(*EDGE).collect()
             if r.from_table in tables and r.to_table in tables]
    schema = ("source string, source_column string, target string, target_column string, "
              "fan_out double, kept double")
    spark = relations_df.sparkSession
    if not edges:
        return spark.createDataFrame([], schema)
    left = _edge_values(edges, tables, "from")
    right = _edge_values(edges, tables, "to").select(
        F.col("e").alias("f"), F.col("v").alias("w"), F.col("t").alias("u"), F.col("n").alias("m"))
    same = (F.col("e") == F.col("f")) & F.col("v").eqNullSafe(F.col("w")) & F.col(
        "t").eqNullSafe(F.col("u"))
    facts = left.join(right, same, "full").groupBy(F.coalesce("e", "f").alias("e")).agg(
        F.sum("n").alias("rows_from"), F.sum("m").alias("rows_to"),
        F.sum(F.expr("if(m is null, null, n)")).alias("met_from"),
        F.sum(F.expr("if(n is null, null, m)")).alias("met_to"),
        F.sum(F.expr("n * m")).alias("pairs"))
    known = spark.createDataFrame(
        [(i, *(e[c] for c in EDGE)) for i, e in enumerate(edges)],
        "e int, " + ", ".join(f"{c} string" for c in EDGE))
    measured = known.join(facts, "e", "left")

    def step(source, target, met, rows):
        return measured.selectExpr(
            f"{source}_table as source", f"{source}_column as source_column",
            f"{target}_table as target", f"{target}_column as target_column",
            f"coalesce(pairs / {met}, 0D) as fan_out", f"coalesce({met} / {rows}, 0D) as kept")

    return step("from", "to", "met_from", "rows_from").unionByName(
        step("to", "from", "met_to", "rows_to"))


def join_paths(steps_df: DataFrame, start: str, end: str | None = None, most_hops: int = 4
               ) -> DataFrame:
    """All paths from one table to another, or to every table, that visit no table twice.

    Returns end_table, path, hops, fan_out, kept and multiplies: the product of the steps' fan-out and
    of their kept shares, and whether some step meets more than one row. The steps, two for each relation, are
    collected; the walk is a recursive query.
    """
    if not 1 <= most_hops <= MOST_HOPS:
        raise ValueError(f"most_hops must be between 1 and {MOST_HOPS}")
    spark = steps_df.sparkSession
    steps = spark.createDataFrame(steps_df.collect(), steps_df.schema)
    walked = spark.sql(
        """
        with recursive walk(at_table, visited, path, hops, fan_out, kept, multiplies) as (
          select :start, array(:start), :start, 0, 1D, 1D, false
          union all
          select s.target, array_append(w.visited, s.target),
            concat(w.path, ' -[', s.source_column, '=', s.target_column, ']-> ', s.target),
            w.hops + 1, w.fan_out * s.fan_out, w.kept * s.kept, w.multiplies or s.fan_out > 1
          from walk w join {steps} s on s.source = w.at_table
          where w.hops < :most and not array_contains(w.visited, s.target))
        select at_table as end_table, path, hops, fan_out, kept, multiplies from walk where hops > 0
        """, args={"start": start, "most": most_hops}, steps=steps)
    return walked if end is None else walked.where(F.col("end_table") == end)


def safest_paths(paths_df: DataFrame) -> DataFrame:
    """For each end table the path that multiplies rows least; then the one that keeps most rows,
    the shortest, and the first by name."""
    best = F.min_by(
        F.struct("path", "hops", "fan_out", "kept", "multiplies"),
        F.struct(F.col("fan_out"), -F.col("kept"), "hops", "path"))
    return paths_df.groupBy("end_table").agg(best.alias("b")).select("end_table", "b.*")
