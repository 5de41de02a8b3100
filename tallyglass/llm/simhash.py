"""Near-duplicates by SimHash fingerprints, found with fuzzy keys of the binary Golay code.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits. Two fingerprints that differ in
two bits or fewer agree on at least one whole segment (pigeonhole), and the next segment differs in
two bits at most. That one is padded to the 23 bits of the perfect Golay code and decoded, as it is
and with each of its bits flipped: the codewords found are its fuzzy indices. Two words at most two
bits apart have a word between them that is one flip from each, so they share an index for sure.
A key is the whole segment with one fuzzy index of the next. Fingerprints are joined by key and
verified on all 64 bits.

A bucket of more than `bucket` fingerprints is not paired. Its members go through all their one-bit
neighbours instead: two fingerprints link exactly if they have a neighbour (or themselves) in common,
and a neighbour is shared by 65 fingerprints at most. So no group is ever paired without bound, and
no link is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyglass.llm.common import prepare, whole_text
from tallyglass.llm.components import connected

SEGMENTS = ((0, 22), (22, 21), (43, 21))
GENERATOR = 0xC75  # fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
BUCKET = 64
SEED = 42


def fingerprint(text: bytes, words: int = 3) -> int:
    """The fingerprint of one text: a bit is set if more than half the shingle hashes set it."""
    import xxhash

    tokens = text.lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[words - 1:] if len(tokens) >= words else ends[-1:]
    total, ones, digest = len(last), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    spans = list(zip(starts[:total].tolist(), last.tolist(), strict=True))
    for k in range(0, total, 1 << 16):
        part = spans[k:k + (1 << 16)]
        h = np.fromiter((digest(line[a:b], SEED) for a, b in part), "<u8", len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, doc_id: str = "doc_id", text: str = "text",
                 keep: tuple = ()):
    """(doc_id, fp long) of every row, repeated rows included; a null or empty text has 0. With
    keep, also row: a struct of those columns."""
    def rows(batches):
        for batch in batches:
            fps = [fingerprint(t, words) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps, pa.int64())],
                                             [*batch.schema.names[:-1], "fp"])

    prepare(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                         *([F.struct(*keep).alias("row")] if keep else []),
                         whole_text(text).alias("text"))
    return source.mapInArrow(rows, source.withColumn("text", F.lit(0).cast("long")).withColumnRenamed(
        "text", "fp").schema)


def remainders() -> np.ndarray:
    """The remainder of every 23-bit word's high 12 bits, divided by the generator."""
    out = np.arange(1 << 12, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        out = np.where(out >> bit & 1, out ^ (GENERATOR << (bit - 11)), out)
    return out


def leaders() -> np.ndarray:
    """For each of the 2,048 syndromes, the only error of three bits or fewer that has it."""
    rest, out = remainders(), np.zeros(1 << 11, np.int64)
    one = [1 << i for i in range(23)]
    errors = [a | b | c for a in [0, *one] for b in [0, *one] for c in [0, *one]]
    for e in errors:
        out[rest[e >> 11] ^ (e & 2047)] = e
    return out


def fuzzy_indices(segment: np.ndarray, rest: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """For each word, 24 codeword indices: its own and those of its one-bit neighbours, sorted."""
    flips = np.concatenate(([0], 1 << np.arange(23)))
    near = segment[:, None] ^ flips[None, :]
    fixed = near ^ lead[rest[near >> 11] ^ (near & 2047)]
    return np.sort(fixed >> 11, axis=1)


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in fps, key) of every fuzzy key of every fingerprint."""
    rest, lead = remainders(), leaders()
    bits, at, keys = fps.view(np.uint64), [], []
    cut = [(bits >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
    for k in range(3):
        near = fuzzy_indices(cut[(k + 1) % 3], rest, lead)
        new = np.concatenate((np.ones((len(fps), 1), bool), near[:, 1:] != near[:, :-1]), axis=1)
        row, col = np.nonzero(new)
        at.append(row)
        keys.append(np.int64(k) << 40 | cut[k][row] << 12 | near[row, col])
    return np.concatenate(at), np.concatenate(keys)


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): edges that connect all distinct fingerprints (fp) at two or fewer differing bits.

    Edges within small buckets are all such pairs; within larger ones, stars with the same reach.
    """
    def keyed(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for k in range(0, len(fps), 4096):
                at, keys = keys_of(fps[k:k + 4096])
                yield pa.record_batch([pa.array(keys), pa.array(fps[k:k + 4096][at])],
                                      ["key", "fp"])

    keys = distinct.select("fp").mapInArrow(keyed, "key long, fp long")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = keys.join(sizes, "key").checkpoint()
    small = met.where(F.col("n") <= bucket)
    pairs = small.select("key", F.col("fp").alias("a")).join(
        small.select("key", F.col("fp").alias("b")), "key").where(
        "a < b and bit_count(a ^ b) <= 2").select("a", "b")
    near = met.where(F.col("n") > bucket).select("fp").distinct().select(
        "fp", F.explode(F.concat(F.array(F.col("fp")), F.transform(
            F.sequence(F.lit(0), F.lit(63)),
            lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))
        ))).alias("between"))
    hubs = near.groupBy("between").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all"))
    stars = hubs.where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a < b")
    return pairs.union(stars).distinct()


def components(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(fp, root, least, component_id) of every distinct fingerprint of fps (doc_id, fp): the
    component's smallest fingerprint, and the smallest doc_id of fp and of the component."""
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least")).checkpoint()
    roots = connected(links(distinct, bucket)).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "least", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, bucket: int = BUCKET,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs.

    component_id is the smallest doc_id that links of two or fewer bits reach, itself included.
    Repeated rows stay; a null doc_id is kept and never chosen, except where a component has no
    other. Null and empty texts have fingerprint zero. An empty table gives no rows. Other columns
    of docs are not looked at.
    """
    fps = fingerprints(docs, words, doc_id, text).checkpoint()
    return fps.join(components(fps, bucket), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, keep: tuple, words: int = 3, bucket: int = BUCKET,
                doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The kept columns of one row of each component: that of the smallest doc_id, nulls last, and
    of several such rows the smallest by the kept columns in their order.

    Rows are told apart by their component, not by their id: rows without an id, or with the same
    one, stay as long as their texts are not linked. Rows are folded by fingerprint before they
    meet the components, so that a text that fills a third of the table is one row by then.
    """
    names = components(fingerprints(docs, words, doc_id, text).checkpoint(), bucket)
    best = fingerprints(docs, words, doc_id, text, keep).groupBy("fp").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("missing"), "doc_id", "row")).alias("best"))
    chosen = best.join(names.where("least <=> component_id").select("fp", "root"), "fp").groupBy(
        "root").agg(F.min("best").alias("best"))
    return chosen.select(*[F.col(f"best.row.{c}").alias(c) for c in keep])
