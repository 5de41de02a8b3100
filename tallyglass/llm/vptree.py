"""Nearest neighbours by inner product with vantage-point trees, one tree per shard.

A largest inner product becomes a smallest distance by one more coordinate: with M the largest norm,
x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) give |q' - x'|^2 = |q|^2 + M^2 - 2 q.x.

A vantage-point tree fitted on a sample of SAMPLE_ROWS vectors at most has one leaf for about
SHARD_ROWS vectors of the table, up to MOST_LEAVES; all vectors go down to a leaf, and a leaf is cut
into shards of that size by a hash, so equal vectors spread. Each shard has a tree of its own, which
splits its vectors at the median distance from a vantage point, down to small leaves.

A query first searches the shards of the leaf it would lie in itself. Its k-th best distance there is
the bound with which it goes on: to the leaves, and in them to the sides of the trees, that the
triangle inequality does not put farther than `factor` times that distance. Factor one is exact
search; smaller factors skip more. The k best of all are the result, scored by the original vectors in
double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyglass.llm.common import prepare

FACTOR = 0.9
LEAF = 64
SHARD_ROWS = 8192
QUERY_ROWS = 2048
SAMPLE_ROWS, MOST_LEAVES = 20_000, 4096


class Tree:
    """A vantage-point tree over the rows of `points`, held as an order of rows and a node list."""

    def __init__(self, points: np.ndarray, seed: int = 7):
        self.points, self.order = points, np.arange(len(points))
        self.nodes: list[tuple] = []
        self.pick = np.random.default_rng(seed)
        if len(points):
            self._split(0, len(points))

    def _split(self, a: int, b: int) -> int:
        """Arrange order[a:b]; a node is (a, b, vantage, radius, inner, outer), inner -1 at leaves."""
        at = len(self.nodes)
        self.nodes.append((a, b, -1, 0.0, -1, -1))
        if b - a > LEAF:
            rows = self.order[a:b]
            vantage = int(rows[self.pick.integers(b - a)])
            far = np.sqrt(((self.points[rows] - self.points[vantage]) ** 2).sum(1))
            middle = (b - a) // 2
            part = np.argpartition(far, middle)
            self.order[a:b] = rows[part]
            radius = float(far[part[middle]])
            inner, outer = self._split(a, a + middle), self._split(a + middle, b)
            self.nodes[at] = (a, b, vantage, radius, inner, outer)
        return at

    def search(self, queries: np.ndarray, k: int, factor: float, bound=np.inf) -> np.ndarray:
        """The rows (-1: none) of the k nearest found of each query, in no order; none farther than
        its bound."""
        best = np.tile(np.broadcast_to(bound, len(queries))[:, None], (1, k))
        rows = np.full((len(queries), k), -1)
        if self.nodes:
            self._visit(0, np.arange(len(queries)), queries, factor, best, rows)
        return rows

    def _visit(self, node, ask, queries, factor, best, rows):
        a, b, vantage, radius, inner, outer = self.nodes[node]
        if inner < 0:
            leaf, k = self.order[a:b], best.shape[1]
            far = np.sqrt(np.maximum(
                (queries[ask] ** 2).sum(1)[:, None] + (self.points[leaf] ** 2).sum(1)[None, :]
                - 2 * queries[ask] @ self.points[leaf].T, 0))
            both = np.concatenate((best[ask], far), axis=1)
            name = np.concatenate((rows[ask], np.broadcast_to(leaf, far.shape)), axis=1)
            top = np.argpartition(both, k - 1, axis=1)[:, :k]
            best[ask] = np.take_along_axis(both, top, 1)
            rows[ask] = np.take_along_axis(name, top, 1)
            return
        far = np.sqrt(((queries[ask] - self.points[vantage]) ** 2).sum(1))
        # The nearer side comes first where there is no bound yet; else all go down together.
        bounded = np.isfinite(best[ask[0], 0])
        near_in = np.full(len(ask), True) if bounded else far < radius
        for first_in in (True,) if bounded else (True, False):
            some = near_in if first_in else ~near_in
            for inside in (first_in, not first_in):
                here, there = ask[some], far[some]
                gap = there - radius if inside else radius - there
                here = here[gap <= factor * best[here].max(1)]
                if len(here):
                    self._visit(inner if inside else outer, here, queries, factor, best, rows)


class Upper:
    """The tree above the shards: nodes (vantage, radius, inner, outer) or leaf numbers."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 3):
        self.nodes: list[tuple] = []
        self.leaves, self.pick = 0, np.random.default_rng(seed)
        self._split(sample, max(leaves, 1))
        del self.pick

    def _split(self, points: np.ndarray, leaves: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if leaves > 1 and len(points) > 1:
            vantage = points[self.pick.integers(len(points))]
            far = np.sqrt(((points - vantage) ** 2).sum(1))
            radius = float(np.median(far))
            inner = far < radius
            if inner.any():
                self.nodes[at] = (vantage, radius, self._split(points[inner], leaves // 2),
                                  self._split(points[~inner], leaves - leaves // 2))
                return at
        self.nodes[at] = (self.leaves,)
        self.leaves += 1
        return at

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)

        def go(node, rows):
            if len(self.nodes[node]) == 1:
                out[rows] = self.nodes[node][0]
            elif len(rows):
                vantage, radius, inner, outer = self.nodes[node]
                near = np.sqrt(((points[rows] - vantage) ** 2).sum(1)) < radius
                go(inner, rows[near])
                go(outer, rows[~near])

        go(0, np.arange(len(points)))
        return out

    def least(self, queries: np.ndarray) -> np.ndarray:
        """For each query and leaf, a distance that none of the leaf's vectors is nearer than."""
        out = np.zeros((len(queries), self.leaves))

        def go(node, low):
            if len(self.nodes[node]) == 1:
                out[:, self.nodes[node][0]] = low
            else:
                vantage, radius, inner, outer = self.nodes[node]
                gap = np.sqrt(((queries - vantage) ** 2).sum(1)) - radius
                go(inner, np.maximum(low, gap))
                go(outer, np.maximum(low, -gap))

        go(0, np.zeros(len(queries)))
        return out


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows whose vector is finite, not null and not zero."""
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"),
                          F.col(embedding).cast("array<double>").alias("v")).where(
        "vec_id is not null and v is not null and exists(v, x -> x != 0) and "
        "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")


def matrix(batch) -> np.ndarray:
    v = batch.column("v")
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def lifted(x: np.ndarray, reach: float) -> np.ndarray:
    return np.column_stack((x, np.sqrt(np.maximum(reach - (x * x).sum(1), 0))))


def met(shard: pa.Table, block: pa.Table, k: int, factor: float, reach: float) -> pa.Table:
    """(query_id, mark, vec_id, score): up to k candidates of one shard for each query of a block."""
    found = {"query_id": [], "mark": [], "vec_id": [], "score": []}
    if shard.num_rows and block.num_rows:
        x, q = matrix(shard), matrix(block)
        ids = shard.column("vec_id").to_numpy()
        names, marks = (block.column(c).to_numpy() for c in ("query_id", "mark"))
        # equal vectors are one point, so that ties among them are settled by vec_id alone
        x, point = np.unique(x, axis=0, return_inverse=True)
        point = point.reshape(-1)
        place = np.lexsort((ids, point))
        ids, first = ids[place], np.searchsorted(point[place], np.arange(len(x) + 1))
        bound = block.column("bound").to_numpy()
        rows = Tree(lifted(x, reach)).search(
            np.column_stack((q, np.zeros(len(q)))), k + 1, factor, bound)
        for i, name in enumerate(names):
            got = rows[i][rows[i] >= 0]
            score = (x[got] * q[i]).sum(1)
            near = [ids[first[g]:first[g + 1]] for g in got]
            near = [n[n != name][:k] for n in near]
            score = np.repeat(score, [len(n) for n in near])
            near = np.concatenate(near) if near else ids[:0]
            top = np.lexsort((near, -score))[:k]
            found["query_id"].append(np.full(len(top), name))
            found["mark"].append(np.full(len(top), marks[i]))
            found["vec_id"].append(near[top])
            found["score"].append(score[top])
    return pa.table({c: pa.array(np.concatenate(p) if p else np.array([], t), t) for (c, p), t
                     in zip(found.items(), ("int64", "int64", "int64", "float64"), strict=True)})


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = FACTOR,
            vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found among all vectors.

    Nearest is the largest inner product, ties go to the smaller vec_id, and a query does not find
    rows of its own vec_id. Vectors that are null, zero, hold a null or non-finite component, or are
    of another than the commonest length (of equally common ones the greater), and rows with a null id,
    take no part. With fewer than k candidates all are returned. Empty tables give no rows.
    Repeated rows are candidates of their own, but one query; a query id with several different
    vectors is ranked for each of them.
    """
    spark = vectors.sparkSession
    prepare(spark)
    every = usable(vectors, vec_id, embedding)
    sizes = every.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.expr(
        "aggregate(v, 0d, (a, x) -> a + x * x)")).alias("reach"))
    common = sizes.agg(F.max_by(F.struct("d", "n", "reach"), F.struct("n", "d"))).first()[0]
    d, count, reach = common or (0, 0, 0.0)
    points = every.where(F.size("v") == d)
    ask = usable(queries, vec_id, embedding).where(F.size("v") == d).select(
        F.col("vec_id").alias("query_id"), "v").distinct().withColumn("mark", F.xxhash64("v"))
    share = min(1.0, 2 * SAMPLE_ROWS / max(count, 1))
    seed = F.xxhash64("vec_id", "v")
    sample = points.where(F.pmod(seed, F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(
        seed).limit(SAMPLE_ROWS).select("v").toArrow()
    leaves = 1 << max(-(-count // SHARD_ROWS) - 1, 0).bit_length()  # halves all the way down
    fitted = Upper(lifted(matrix(sample), reach) if sample.num_rows else np.zeros((0, 1)),
                   min(leaves, MOST_LEAVES))
    upper = spark.sparkContext.broadcast((fitted.nodes, fitted.leaves))

    def above():
        tree = Upper.__new__(Upper)
        tree.nodes, tree.leaves = upper.value
        return tree

    def placed(batches):
        tree = above()
        for batch in batches:
            at = tree.leaf_of(lifted(matrix(batch), reach))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)],
                                             [*batch.schema.names, "leaf"])

    def homes(batches):
        tree = above()
        for batch in batches:
            x = matrix(batch)
            at = tree.least(np.column_stack((x, np.zeros(len(x))))).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)],
                                             [*batch.schema.names, "leaf"])

    shown = "query_id long, v array<double>, mark long"
    points = points.mapInArrow(placed, "vec_id long, v array<double>, leaf long")
    rows = points.groupBy("leaf").agg(F.count("*").alias("n")).collect()  # one row of each leaf
    cut = F.create_map(*[F.lit(x) for r in rows for x in (r.leaf, -(-r.n // SHARD_ROWS))]) \
        if rows else F.create_map(F.lit(0).cast("long"), F.lit(1))
    points = points.withColumn("shard", F.pmod(seed, F.element_at(cut, F.col("leaf"))))

    def search(asked: DataFrame) -> DataFrame:
        """Candidates of queries (…, leaf, bound) in all shards of their leaf."""
        asked = asked.checkpoint()
        many = {r.leaf: r.n for r in asked.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
        if not many:
            return spark.createDataFrame(
                [], "query_id long, mark long, vec_id long, score double")
        blocks = F.element_at(F.create_map(*[
            F.lit(x) for leaf, n in many.items() for x in (leaf, -(-n // QUERY_ROWS))]), F.col("leaf"))

        def all_of(n):
            return F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))

        left = points.where(F.col("leaf").isin(list(many))).select(
            "leaf", "shard", all_of(blocks).alias("block"), "vec_id", "v")
        right = asked.select("leaf", all_of(F.element_at(cut, F.col("leaf"))).alias("shard"),
                             F.pmod(F.xxhash64("query_id", "mark"), blocks).alias("block"),
                             "query_id", "mark", "v", "bound")
        keys = ("leaf", "shard", "block")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
            lambda x, q: met(x, q, k, factor, reach),
            "query_id long, mark long, vec_id long, score double")

    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")

    def best(pairs):
        return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    asked = ask.mapInArrow(homes, shown + ", leaf long").checkpoint()
    near = best(search(asked.withColumn("bound", F.lit(float("inf"))))).drop("rank").checkpoint()
    kth = near.groupBy("query_id", "mark").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    bounded = asked.withColumnRenamed("leaf", "home").join(kth, ["query_id", "mark"], "left").select(
        "query_id", "v", "mark", "home", F.when(F.col("n") == k, F.col("least")).alias("least"))

    def onward(batches):
        tree = above()
        for batch in batches:
            q = matrix(batch)
            least = batch.column("least").to_numpy(zero_copy_only=False).astype(float)
            square = (q * q).sum(1) + reach - 2 * least
            # A little more than the k-th best distance, so that ties and rounding pass.
            bound = np.where(np.isnan(least), np.inf, np.sqrt(np.maximum(square, 0)) * (1 + 1e-9) + 1e-12)
            low = tree.least(np.column_stack((q, np.zeros(len(q)))))
            go = low <= factor * bound[:, None]
            go[np.arange(len(q)), batch.column("home").to_numpy()] = False
            row, leaf = np.nonzero(go)
            part = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [part.column("query_id"), part.column("v"), part.column("mark"), pa.array(leaf),
                 pa.array(bound[row])], ["query_id", "v", "mark", "leaf", "bound"])

    others = search(bounded.mapInArrow(onward, shown + ", leaf long, bound double"))
    return best(near.unionByName(others)).select("query_id", "rank", "vec_id", "score")
