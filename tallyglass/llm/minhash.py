"""Near-duplicates by MinHash with tensored banding, confirmed on whole sets of shingles.

Two collections of GROUPS groups hold WIDTH minhashes each: 2 x 8 x 2 = 32 minhashes. A table key is
one group of the first collection with one group of the second, so 32 minhashes give 64 tables of
four minhashes each, where plain banding computes 256. Two sets of similarity s meet in a table if
each collection has a group in which they agree, with probability (1 - (1 - s^2)^8)^2: 0.99993 at
0.85, more above. Candidates are confirmed on the sets themselves, word for word.

Equal texts are one class from the start. A bucket of more than BUCKET classes is not paired.
Its classes are compared with one hub, which puts most of a group of near copies into one component.
Buckets whose classes are then in several components are gathered by their largest component, and
all classes outside of it are compared with all of the group, in blocks. A block holds sets as what
they differ in from the set of most of them, so near copies cost little, and it sends out no more
edges than connect what it has found. So a group of near copies emits about its size in pairs, and no
link inside a bucket is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyglass.llm.common import prepare, whole_text
from tallyglass.llm.components import connected

GROUPS, WIDTH = 8, 2
SHARE = 85  # per cent of the union that two linked sets share at least
BUCKET = 32
BLOCK_SHINGLES = 1 << 20  # of one side of a block
FAN = 1024  # pairs of one class that meet its text in one task
KEPT_WORDS, KEPT_SHINGLES = 200_000, 300_000
ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, words: int) -> set[tuple]:
    """Distinct shingles of a text: A-Z in lower case; fewer words are one shingle, none no shingle."""
    tokens = text.lower().split()
    if len(tokens) < words:
        return {tuple(tokens)} if tokens else set()
    return set(zip(*(tokens[i:] for i in range(words)), strict=False))


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits, scattered."""
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


class Hashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= KEPT_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def shingle_hashes(text: bytes, words: int, known: Hashes) -> np.ndarray:
    """A hash of each shingle, repeats included; none without words."""
    tokens = text.lower().split()
    h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    n = max(len(h) - words + 1, min(len(h), 1))
    out = np.full(n, len(h) if len(h) < words else words, np.uint64)
    for i in range(min(words, len(h))):
        out = (out * ODD ^ h[i:i + n]) * np.uint64(0xC2B2AE3D27D4EB4F)
        out ^= out >> np.uint64(29)
    return out


def group_hashes(hashes: list[np.ndarray]) -> np.ndarray:
    """For each set, 2 GROUPS numbers: each of WIDTH minhashes of its own. Empty sets give zeros."""
    size = np.fromiter(map(len, hashes), np.int64, len(hashes))
    out = np.zeros((len(hashes), 2 * GROUPS), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        flat = np.concatenate([hashes[i] for i in full])
        first = np.cumsum(size[full]) - size[full]
        seeds = mixed(np.arange(1, 2 * GROUPS * WIDTH + 1, dtype=np.uint64) * ODD)
        for g in range(2 * GROUPS):
            both = np.zeros(len(full), np.uint64)
            for s in seeds[g * WIDTH:(g + 1) * WIDTH]:
                both = mixed(both * ODD ^ np.minimum.reduceat(mixed(flat ^ s), first))
            out[full, g] = both
    return out


def sketches(docs: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, sha binary, n_shingles, groups array<long>) of every row."""
    def rows(batches):
        known = Hashes()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            groups = group_hashes([shingle_hashes(t, words, known) for t in texts]).view(np.int64)
            sizes = [len(shingles(t, words)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()),
                 pa.array(list(groups), pa.list_(pa.int64()))], ["doc_id", "sha", "n", "groups"])

    prepare(docs.sparkSession)
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), _sha(text), whole_text(text).alias("text")
    ).mapInArrow(rows, "doc_id long, sha binary, n long, groups array<long>")


def _sha(text: str):
    return F.unhex(F.sha2(whole_text(text), 256)).alias("sha")


def keyed(classes: DataFrame) -> DataFrame:
    """(node, n, key): GROUPS x GROUPS keys of every class that has shingles."""
    pairs = F.expr(f"""explode(flatten(transform(sequence(0, {GROUPS - 1}), i -> transform(
        sequence(0, {GROUPS - 1}), j -> xxhash64(i, j, groups[i], groups[{GROUPS} + j])))))""")
    return classes.where("n > 0").select("node", "n", pairs.alias("key"))


def _alike(a: str, b: str, share: int) -> str:
    """SQL test: sets of these sizes can be linked."""
    return f"100 * least({a}, {b}) >= {share} * greatest({a}, {b})"


def _heavy(pairs: DataFrame, end: str) -> DataFrame:
    """Classes at this end of more than FAN pairs, and the last of the numbers that deal them out."""
    return pairs.groupBy(end).agg(F.expr(f"(count(*) - 1) div {FAN}").alias(f"last_{end}")).where(
        f"last_{end} > 0")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, text_a, text_b); a class in many pairs meets them in several tasks."""
    none = F.lit(0).cast("long")
    heavy = {end: _heavy(pairs, end) for end in "ab"}
    for end in "ab":
        pairs = pairs.join(heavy[end], end, "left").withColumn(
            f"salt_{end}", F.pmod(F.xxhash64("a", "b"), F.coalesce(f"last_{end}", none) + 1))
    for end in "ab":
        spread = texts.withColumnRenamed("node", end).join(heavy[end], end, "left").select(
            end, F.col("text").alias(f"text_{end}"),
            F.explode(F.sequence(none, F.coalesce(f"last_{end}", none))).alias(f"salt_{end}"))
        pairs = pairs.join(spread, [end, f"salt_{end}"])
    return pairs.select("a", "b", "text_a", "text_b")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, share: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets share enough, written to the shared folder."""
    def linked(batches):
        sets: dict[int, set] = {}
        held = 0

        def of(node, text):
            nonlocal held
            if node not in sets:
                if held > KEPT_SHINGLES:
                    sets.clear()
                    held = 0
                sets[node] = shingles(text, words)
                held += len(sets[node])
            return sets[node]

        for batch in batches:
            out = []
            for a, b, one, two in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = of(a, one), of(b, two)
                same = len(x & y)
                out.append(100 * same >= share * (len(x) + len(y) - same))
            yield batch.select([0, 1]).filter(pa.array(out, pa.bool_()))

    pairs = pairs.select("a", "b").distinct().checkpoint()
    return _with_texts(pairs, texts).mapInArrow(linked, "a long, b long").checkpoint()


def spanning(strays: list, members: list, share: int) -> list[tuple[int, int]]:
    """Edges (stray, member) that connect what links between them connect, beyond known roots.

    Each is (node, root, sorted distinct hashes of shingles). Sets are held as differences from the
    set of those hashes that most of them have: |x ^ y| = |dx| + |dy| - 2 |dx & dy|.
    """
    every = members + strays
    values, often = np.unique(np.concatenate([x for _, _, x in every]), return_counts=True)
    usual = values[often * 2 > len(every)]
    gaps = [np.searchsorted(values, np.setxor1d(x, usual, assume_unique=True)) for _, _, x in every]
    size = np.array([len(x) for _, _, x in every])
    gap = np.array([len(g) for g in gaps])
    many = len(members)
    flat = np.concatenate([*gaps[:many], np.zeros(0, np.int64)])
    order = np.argsort(flat, kind="stable")
    holder = np.repeat(np.arange(many), gap[:many])[order]
    ends = np.cumsum(np.bincount(flat, minlength=len(values)))
    starts = np.concatenate(([0], ends[:-1]))
    _, label = np.unique([root for _, root, _ in every], return_inverse=True)
    out = []
    for i in range(many, len(every)):
        first, width = starts[gaps[i]], ends[gaps[i]] - starts[gaps[i]]
        at = np.arange(width.sum()) + np.repeat(first - np.cumsum(width) + width, width)
        shared = np.bincount(holder[at], minlength=many)
        apart = gap[i] + gap[:many] - 2 * shared
        both = size[i] + size[:many]
        linked = np.flatnonzero((100 * (both - apart) >= share * (both + apart))
                                & (label[:many] != label[i]))
        names, one = np.unique(label[linked], return_index=True)
        out += [(every[i][0], members[linked[k]][0]) for k in one]
        if len(names):
            label[np.isin(label, names)] = label[i]
    return out


def _in_blocks(open_: DataFrame, texts: DataFrame, words: int, share: int) -> DataFrame:
    """(a, b): edges that connect what links within open buckets connect; see `spanning`.

    Classes outside the largest component of a bucket are the ones that are compared with all.
    """
    def hashed(batches):
        known = Hashes()
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, words, known)).tobytes()
                    for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], ["node", "tokens"])

    def compared(left, right):
        def rows(table):
            return list(zip(table["node"].to_pylist(), table["root"].to_pylist(), [
                np.frombuffer(t, np.uint64) for t in table["tokens"].to_pylist()], strict=True))

        edges = spanning(rows(left), rows(right), share) if len(left) and len(right) else []
        return pa.table([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

    each = open_.groupBy("key", "root").agg(
        F.count("*").alias("many"), F.min(F.xxhash64("node")).alias("order"))
    largest = each.groupBy("key").agg(
        F.max_by("root", F.struct("many", "order")).alias("group"))
    placed = open_.join(largest, "key").select("group", "node", "n", "root").distinct().checkpoint()
    outside = F.col("root") != F.col("group")
    cuts = placed.groupBy("group").agg(*[
        F.expr(f"(coalesce(sum({n}), 0) div {BLOCK_SHINGLES}) + 1").alias(name)
        for name, n in (("strays", "if(root <> group, n, 0)"), ("members", "n"))])
    tokens = texts.join(placed.select("node").distinct(), "node", "left_semi").select(
        "node", "text").mapInArrow(hashed, "node long, tokens binary")
    rows = placed.join(cuts, "group").join(tokens, "node").checkpoint()

    def block(name):
        return F.pmod(F.xxhash64("node"), F.col(name))

    def all_of(name):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))

    left = rows.where(outside).select("group", block("strays").alias("s"), all_of("members").alias("m"),
                                      "node", "root", "tokens")
    right = rows.select("group", all_of("strays").alias("s"), block("members").alias("m"), "node",
                        "root", "tokens")
    return left.groupBy("group", "s", "m").cogroup(right.groupBy("group", "s", "m")).applyInArrow(
        compared, "a long, b long")


def links(met: DataFrame, texts: DataFrame, words: int, share: int, bucket: int) -> DataFrame:
    """(a, b): edges that connect what confirmed links between classes with a common key connect.

    met: (key, node, n, size) of buckets of two classes or more.
    """
    small = met.where(F.col("size") <= bucket)
    pairs = small.alias("x").join(small.alias("y"), "key").where(
        f"x.node < y.node and {_alike('x.n', 'y.n', share)}").select(
        F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    large = met.where(F.col("size") > bucket).select("key", "node", "n")
    crowded = not large.isEmpty()
    if crowded:
        hubs = large.groupBy("key").agg(F.min(F.struct(
            F.xxhash64("node"), F.col("node").alias("hub"), F.col("n").alias("hub_n"))).alias("h"))
        pairs = pairs.union(large.join(hubs.select("key", "h.hub", "h.hub_n"), "key").where(
            f"node <> hub and {_alike('n', 'hub_n', share)}").select(
            F.col("hub").alias("a"), F.col("node").alias("b")))
    edges = confirmed(pairs, texts, words, share)
    if crowded:
        rooted = large.join(connected(edges), "node", "left").select(
            "key", "node", "n", F.coalesce("root", "node").alias("root"))
        several = rooted.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where(
            "r < s").select("key")
        open_ = rooted.join(several, "key").checkpoint()
        if not open_.isEmpty():
            edges = edges.union(confirmed(
                _in_blocks(open_, texts, words, share), texts, words, share))
    return edges


def near_duplicates(docs: DataFrame, words: int = 3, share: int = SHARE, bucket: int = BUCKET,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs.

    component_id is the smallest doc_id that links reach, itself included; kept is true where it is
    the row's own. Texts without words are linked with nothing, not even with each other. Repeated
    rows stay. A null doc_id is kept and never chosen, except where a component has no other. An empty
    table gives no rows. Other columns of docs are not looked at.
    """
    prepare(docs.sparkSession)
    classes = sketches(docs, words, doc_id, text).groupBy("sha").agg(
        F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("groups").alias("groups")
    ).withColumn("node", F.monotonically_increasing_id()).checkpoint()
    keys = keyed(classes)
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = keys.join(sizes, "key").checkpoint()
    wanted = classes.join(met.select("node").distinct(), "node", "left_semi").select("sha", "node")
    texts = docs.select(_sha(text), whole_text(text).alias("text")).groupBy("sha").agg(
        F.first("text").alias("text")).join(wanted, "sha").select("node", "text").checkpoint()
    roots = connected(links(met, texts, words, share, bucket))
    rooted = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(least, "root").select("sha", "n", "component")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), _sha(text)).join(
        named, "sha").select(
        "doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
