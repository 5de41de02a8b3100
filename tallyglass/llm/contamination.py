"""Benchmark passages in documents: edit distance by a random walk that turns it into Hamming distance.

Items and documents are sequences of words. The walk (CGK) reads a sequence with a pointer: at step j
it writes the word under the pointer, and a random bit drawn for (j, word) decides whether the
pointer moves on. Two sequences that are few edits apart meet again soon after every edit, so their
walks agree at most steps. Keys take the words at a few sampled steps; REPEATS walks with samples of
their own give every near pair many chances (see `recall`). Windows of about an item's size start
at every word; those that share a key with an item are checked by exact word edit distance.

A window can only be within the bound if it shares enough word trigrams with one item (each edit
spoils three at most). Windows with fewer trigrams of all items together are passed over unread;
this loses nothing. Items come in blocks of bounded size, which are broadcast one after another.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from tallyglass.llm.common import prepare, whole_text

SIMILARITY = 0.8
REPEATS, SAMPLED = 24, 3
LEAST_WORDS = 3
BLOCK_BYTES = 4 << 20
WORD = re.compile(r"[^\W_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def edits(size: int, similarity: float) -> int:
    """How many word edits an item of so many words may show."""
    return int(size * (1 - similarity) + 1e-9)


def mixed(x: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit values of whole numbers."""
    x = x.astype(np.uint64) * MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def trigrams(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64)
    return (x[:-2] * MIX + x[1:-1]) * MIX + x[2:] if len(ids) > 2 else x[:0]


def walk_keys(ids: np.ndarray, starts: np.ndarray, stops: np.ndarray, steps: int, repeat: int
              ) -> np.ndarray:
    """The key of one walk from every start: the words at its sampled steps, hashed."""
    rng = np.random.default_rng([steps, repeat])
    sample = set(np.sort(rng.choice(steps, SAMPLED, replace=False)).tolist())
    salt = mixed(rng.integers(1, 1 << 62, steps))
    at, key = starts.copy(), np.zeros(len(starts), np.uint64)
    for j in range(max(sample) + 1):
        word = np.where(at < stops, ids[np.minimum(at, len(ids) - 1)], -1)
        if j in sample:
            key = (key + word.astype(np.uint64) + np.uint64(2)) * MIX
            key ^= key >> np.uint64(31)
        at += (mixed(word.astype(np.uint64) ^ salt[j]) >> np.uint64(40) & np.uint64(1)
               ).astype(at.dtype)
    return key


def distance(item: np.ndarray, text: np.ndarray) -> int:
    """The least word edit distance of the item to any stretch of the text."""
    place = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for k, word in enumerate(item):
        new = np.concatenate(([k + 1], np.minimum(row[1:] + 1, row[:-1] + (text != word))))
        row = np.minimum.accumulate(new - place) + place
    return int(row.min())


class Items:
    """A block of items ready for the search: words, trigrams and keys by class of size."""

    def __init__(self, items: list[tuple[int, str]], similarity: float):
        self.numbers: dict[str, int] = {}
        number = lambda w: self.numbers.setdefault(w, len(self.numbers) + 1)
        parts = [(i, [number(w) for w in words_of(t)]) for i, t in items]
        parts = sorted(((i, np.array(p)) for i, p in parts if len(p) >= LEAST_WORDS),
                       key=lambda x: (len(x[1]), x[0]))
        self.names, self.words = [i for i, _ in parts], [p for _, p in parts]
        self.similarity = similarity
        self.grams = np.unique(np.concatenate([trigrams(p) for p in self.words])
                               ) if parts else np.zeros(0, np.uint64)
        self.classes, first = [], 0
        while first < len(parts):
            low, last = len(self.words[first]), first
            while last < len(parts) and len(self.words[last]) <= max(low * 1.25, low + 1):
                last += 1
            group = range(first, last)
            sizes = [len(self.words[g]) for g in group]
            reach = max(s + edits(s, similarity) for s in sizes)
            need = max(1, min(s - 2 - 3 * edits(s, similarity) for s in sizes))
            steps = max(SAMPLED, int(1.4 * low))
            flat = np.concatenate([self.words[g] for g in group])
            stop = np.cumsum(sizes)
            tables = []
            for repeat in range(REPEATS):
                keys = walk_keys(flat, stop - sizes, stop, steps, repeat)
                order = np.argsort(keys, kind="stable")
                tables.append((keys[order], order + first))
            self.classes.append((reach, need, steps, tables))
            first = last

    def find(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """For each text, (item, distance) of the items it holds within the bound."""
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        get = self.numbers.get
        lists = [[get(w, 0) for w in words_of(t)] for t in texts]
        ends = np.cumsum([len(x) for x in lists])
        ids = np.fromiter((w for x in lists for w in x), np.int64, int(ends[-1]) if lists else 0)
        if len(ids) < LEAST_WORDS or not len(self.grams):
            return out
        known = np.nonzero((ids[:-2] > 0) & (ids[1:-1] > 0) & (ids[2:] > 0))[0]
        x = ids.astype(np.uint64)
        code = (x[known] * MIX + x[known + 1]) * MIX + x[known + 2]
        at = np.minimum(np.searchsorted(self.grams, code), len(self.grams) - 1)
        hits = np.zeros(len(ids) + 1, np.int64)
        hits[known[self.grams[at] == code] + 1] = 1
        hits = np.cumsum(hits)
        for reach, need, steps, tables in self.classes:
            far = np.minimum(np.arange(len(ids)) + reach, len(ids))
            starts = np.nonzero(hits[far] - hits[:-1] >= need)[0]
            for k in range(0, len(starts), 1 << 16):
                self._verify(ids, ends, self._meet(ids, ends, starts[k:k + (1 << 16)], steps, tables),
                             out)
        return out

    def _meet(self, ids, ends, starts, steps, tables) -> np.ndarray:
        """Distinct (item, start) that share a key."""
        stops = ends[np.searchsorted(ends, starts, side="right")]
        found = [np.zeros((0, 2), np.int64)]
        for repeat, (keys, items) in enumerate(tables):
            got = walk_keys(ids, starts, stops, steps, repeat)
            a, b = np.searchsorted(keys, got, "left"), np.searchsorted(keys, got, "right")
            n = b - a
            reach = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            found.append(np.column_stack((items[reach], np.repeat(starts, n))))
        return np.unique(np.concatenate(found), axis=0)

    def _verify(self, ids, ends, pairs, out) -> None:
        done, covered = -1, -1
        for item, start in pairs.tolist():
            if item == done and start <= covered:
                continue
            words = self.words[item]
            k, size = edits(len(words), self.similarity), len(words)
            doc = int(np.searchsorted(ends, start, side="right"))
            first = max(start - size // 2 - k, int(ends[doc - 1]) if doc else 0)
            last = min(start + 2 * size + k, int(ends[doc]))
            done, covered = item, last - 1 if last == ends[doc] else start + size
            d = distance(words, ids[first:last])
            if d <= k:
                out[doc].append((self.names[item], d))


def recall(edit_share: float, size: int = 40, trials: int = 200, seed: int = 3) -> float:
    """The measured share of items of so many words, with random word edits, that share a key."""
    rng, found = np.random.default_rng(seed), 0
    steps = max(SAMPLED, int(1.4 * size))
    for _ in range(trials):
        a = rng.integers(1, 5000, size)
        b = a.tolist()
        for _ in range(int(size * edit_share)):
            p, how = int(rng.integers(len(b))), int(rng.integers(3))
            b[p:p + (how > 0)] = [int(rng.integers(1, 5000))] if how < 2 else []
        both = np.concatenate((a, np.array(b)))
        starts, stops = np.array([0, size]), np.array([size, len(both)])
        found += any(k[0] == k[1] for k in (walk_keys(both, starts, stops, steps, r)
                                            for r in range(REPEATS)))
    return found / trials


def contaminated(docs: DataFrame, benchmark: DataFrame, keep: tuple = ("doc_id",),
                 similarity: float = SIMILARITY, text: str = "text", item_id: str = "item_id",
                 item_text: str = "text") -> DataFrame:
    """The kept columns and found (array of item, distance) of every row of docs.

    found lists the items of which a stretch of the text is within (1 - similarity) of the item's
    words by edit distance. Words are runs of letters and digits, in lower case. Items with the same
    text count once, by the smallest id; items of fewer than LEAST_WORDS words are too short to
    tell and are not looked for. Null texts are empty and hold nothing. Repeated rows stay. With an
    empty benchmark nothing is found. A column called found is replaced.
    """
    spark = docs.sparkSession
    prepare(spark)
    keep = [c for c in keep if c != "found"]
    items = benchmark.where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).groupBy(
        F.col(item_text).cast("string").alias("text")).agg(
        F.min(F.col(item_id).cast("long")).alias("item"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    out = docs.select(*keep, whole_text(text).alias("__bytes"),
                      F.expr("cast(array() as array<struct<item:bigint,distance:bigint>>)"
                             ).alias("found"))
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast(cloudpickle.dumps(
            Items(sorted((r["item"], r["text"]) for r in part), similarity)))

        def rows(batches, shared=shared, names=(*keep, "__bytes", "found")):
            kind = pa.list_(pa.struct([("item", pa.int64()), ("distance", pa.int64())]))
            block = cloudpickle.loads(shared.value)
            for batch in batches:
                texts = [t.decode("utf-8", "replace") for t in batch.column("__bytes").to_pylist()]
                found = []
                for old, new in zip(batch.column("found").to_pylist(), block.find(texts),
                                    strict=True):
                    least = {x["item"]: x["distance"] for x in old}
                    for item, d in new:
                        least[item] = min(d, least.get(item, d))
                    found.append([{"item": i, "distance": d} for i, d in sorted(least.items())])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(found, kind)], list(names))

        out = out.mapInArrow(rows, out.schema)
    return out.drop("__bytes")
