"""Most frequent values by mergeable summaries, with an exact recount.

Frequencies of all values need a shuffle of all distinct values. Here each column is first summed
up in a sketch of frequent items, whose size does not depend on the data. Its candidates are counted
exactly in a second pass. A column is settled if the candidates hold all its rows, or if the last
value wanted is more frequent than any value that the sketch can have missed.

What is not settled by that has many values of small counts. Those are counted into buckets of two
hashes; a value is as frequent as its buckets at most, so only values whose both buckets reach the
last candidate's count can be among the wanted ones, and only they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tallyglass.sources.catalog import union_all

TRACKED = 2048
#: A sketch of `tracked` items misjudges a count by at most this share of the rows over `tracked`;
#: fixed by the sketch (a priori bound), on its smallest map.
ERROR = 3.5
BUCKETS = 1 << 16
COLUMNS_AT_ONCE = 64  # so that candidates that are broadcast have a bound


def _rank(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent items of each column, ties by what is shown of them."""
    order = Window.partitionBy("c").orderBy(F.desc("n"), F.substring("item", 2, 1 << 30), "item")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _recounted(items: DataFrame, k: int, tracked: int) -> list:
    """The best of each column's candidates, counted exactly, with what tells whether they will do."""
    found = items.groupBy("c").agg(
        F.count("*").alias("known"),
        F.expr(f"approx_top_k(item, {tracked}, {tracked})").alias("found"))
    candidates = found.select("c", "known", F.explode("found.item").alias("item"))
    counts = items.join(F.broadcast(candidates), ["c", "item"]).groupBy("c", "known", "item").agg(
        F.count("*").alias("n"))
    held = F.sum("n").over(Window.partitionBy("c"))
    return _rank(counts.withColumn("held", held), k).collect()  # k rows of each column


def _by_buckets(items: DataFrame, least: dict[int, int], k: int) -> DataFrame:
    """(c, item, n, rank) of columns whose k-th most frequent item occurs `least` times at least."""
    whole = items.where(F.col("c").isin([c for c, n in least.items() if n == 1])).groupBy(
        "c", "item").agg(F.count("*").alias("n"))
    least = {c: n for c, n in least.items() if n > 1}
    if not least:
        return _rank(whole, k)
    pairs = ", ".join(f"{c}, {n}L" for c, n in least.items())
    at_least = f"element_at(map({pairs}), c)"
    hashed = items.where(F.col("c").isin(*least)).selectExpr(
        "c", "item", f"cast(pmod(xxhash64(item), {BUCKETS}) as int) as h0",
        f"cast(pmod(xxhash64(item, 1), {BUCKETS}) as int) as h1")
    full = hashed.selectExpr("c", "stack(2, 0, h0, 1, h1) as (r, h)").groupBy("c", "r", "h").agg(
        F.count("*").alias("n")).where(f"n >= {at_least}")
    for r in (0, 1):
        heavy = full.where(f"r = {r}").select("c", F.col("h").alias(f"h{r}"))
        hashed = hashed.join(F.broadcast(heavy), ["c", f"h{r}"], "left_semi")
    reached = hashed.groupBy("c", "item").agg(F.count("*").alias("n"))
    return _rank(whole.unionByName(reached), k)


def smallest(items: DataFrame, columns: list[int], k: int) -> DataFrame:
    """(c, rank, item, n): the k most frequent items of columns in which no item occurs twice."""
    return _rank(items.where(F.col("c").isin(*columns)).withColumn(
        "n", F.lit(1).cast("long")), k).select("c", "rank", "item", "n")


def top_items(items: DataFrame, columns: list[int], k: int, tracked: int = TRACKED) -> DataFrame:
    """(c, rank, item, n): the k most frequent items of each column, exactly, ties by item.

    items: (c int, item string), without NULL; the first character of an item is a mark that ties
    ignore. Candidates are found and counted when this is called.
    """
    tracked = max(tracked, 4 * k)
    missed = 2 * ERROR / tracked
    settled, parts = [], []
    for at in range(0, len(columns), COLUMNS_AT_ONCE):
        some = items.where(F.col("c").isin(*columns[at:at + COLUMNS_AT_ONCE]))
        best: dict[int, list] = {}
        for row in _recounted(some, k, tracked):
            best.setdefault(row.c, []).append(row)
        # A column without a candidate, as its values hardly ever repeat, has to be counted whole.
        least = {c: 1 for c in columns[at:at + COLUMNS_AT_ONCE] if c not in best}
        for c, rows in best.items():
            last = min(r.n for r in rows) if len(rows) == k else 0
            if rows[0].held == rows[0].known or last > missed * rows[0].known:
                settled += [(c, r["rank"], r["item"], r.n) for r in rows]
            else:
                least[c] = max(last, 1)
        if least:
            parts.append(_by_buckets(some, least, k).select("c", "rank", "item", "n"))
    known = items.sparkSession.createDataFrame(settled, "c int, rank int, item string, n bigint")
    return union_all([known, *parts])
