"""Ranked lexical search by scanning documents with an automaton of all items' terms.

No index of the documents is made. The terms of the items become one Aho-Corasick automaton, each
term between two guards, so that it is found only where it is a whole term. A text is rewritten once
(A-Z in lower case, everything that is not part of a term a guard) and scanned; each match counts a
term, and a term leads to the items that hold it.

The first scan counts documents, terms and, for each term of an item, the documents that hold it.
The second one scores every document for all items and keeps the `k` best of each item in its task,
so k rows of each task and item are shuffled and no more.

Items are taken in blocks of at most BLOCK_BYTES of text. Each block is one broadcast of that bound
and two scans of all documents, so any number of items works.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyglass.llm.common import prepare, whole_text

BLOCK_BYTES = 4 << 20
BLOCK_ITEMS = 4096
TOP = 20
AT_ONCE = 1 << 20  # scores held at once in a task: documents times items
#: Bytes that are no part of a term (ASCII but for 0-9, A-Z, a-z) become spaces.
TERMS = bytes(
    ord(" ") if b < 0x80 and not chr(b).isalnum() else ord(chr(b).lower()) if b < 0x80 else b
    for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text, in order, with repeats."""
    return text.translate(TERMS).split()


class Scanner:
    """The automaton of a list of terms between guards; counts them in texts.

    A text has a guard, a space, at both ends and wherever something is not part of a term.
    """

    def __init__(self, terms: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for number, term in enumerate(terms):
            self.automaton.add_word(f" {term} ", number)
        self.automaton.make_automaton()
        self.found = self.automaton.iter if terms else lambda text: ()

    def counts(self, text: bytes) -> tuple[int, Counter]:
        """The number of terms in the text, and how often each of the listed ones occurs."""
        line = text.translate(TERMS)
        found = self.found(f" {line.decode('utf-8', 'replace')} ")
        return len(line.split()), Counter([number for _, number in found])


class Items:
    """Terms of a block of items, and for each term the items that hold it, with repeats."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.item_ids = [item for item, _ in rows]
        held: dict[str, Counter] = {}
        for at, (_, text) in enumerate(rows):
            for term in terms_of(text):
                held.setdefault(term.decode("utf-8", "replace"), Counter())[at] += 1
        self.terms = sorted(held)
        lists = [sorted(held[t].items()) for t in self.terms]
        self.size = np.array([len(x) for x in lists], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.item = np.array([i for x in lists for i, _ in x], np.int64)
        self.repeats = np.array([n for x in lists for _, n in x], np.int64)

    def tables(self) -> tuple:
        """What a task needs, in types that every worker knows."""
        return self.terms, self.item_ids, self.size, self.first, self.item, self.repeats


def blocks(items: DataFrame, item_id: str, text: str):
    """Lists of (item_id, text) of bounded size, read one partition after another."""
    rows = items.select(F.col(item_id).cast("long"), whole_text(text))
    block, size = [], 0
    for item, line in rows.toLocalIterator(prefetchPartitions=False):
        if block and (size + len(line) > BLOCK_BYTES or len(block) >= BLOCK_ITEMS):
            yield block
            block, size = [], 0
        block.append((item, bytes(line)))
        size += len(line)
    if block:
        yield block


def counted(docs: DataFrame, terms) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and for each listed term the documents holding it."""
    def rows(batches):
        scanner, df, some, whole = Scanner(terms.value), Counter(), 0, 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n, tf = scanner.counts(text)
                some, whole = some + (n > 0), whole + n
                df.update(tf.keys())
        yield pa.record_batch([pa.array([-2, -1, *df], pa.int32()),
                               pa.array([some, whole, *df.values()], pa.int64())], ["term", "n"])

    sums = docs.select("text").mapInArrow(rows, "term int, n long").groupBy("term").agg(
        F.sum("n").alias("n")).collect()  # at most two rows more than the block has terms
    at = {r.term: r.n for r in sums}
    return at.get(-2, 0), at.get(-1, 0), np.array(
        [at.get(t, 0) for t in range(len(terms.value))], np.int64)


class Best:
    """The k best (score, then smaller id, null ids last) of each item, among all rows seen."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least = k, np.ones(n_items, np.int64)
        self.rows: list[np.ndarray] = []  # (item, no id, id, score)
        self.held, self.limit = 0, max(4 * n_items * k, 1 << 16)

    def add(self, ids: np.ndarray, missing: np.ndarray, scores: np.ndarray) -> None:
        doc, item = np.nonzero(scores >= self.least)
        if len(doc):
            self.rows.append(np.stack([item, missing[doc], ids[doc], scores[doc, item]]))
            self.held += len(doc)
            if self.held > self.limit:
                self.settle()

    def settle(self) -> np.ndarray:
        if not self.rows:
            return np.zeros((4, 0), np.int64)
        rows = np.concatenate(self.rows, axis=1)
        rows = rows[:, np.lexsort((rows[2], rows[1], -rows[3], rows[0]))]
        first = np.searchsorted(rows[0], rows[0])
        place = np.arange(rows.shape[1]) - first
        rows = rows[:, place < self.k]
        last = place[place < self.k] == self.k - 1
        self.least[rows[0, last]] = np.maximum(rows[3, last], 1)
        self.rows, self.held = [rows], rows.shape[1]
        return rows


def _scored(docs: DataFrame, block: list[tuple[int, bytes]], k: int) -> DataFrame:
    context = docs.sparkSession.sparkContext
    items = Items(block)
    terms = context.broadcast(items.terms)
    n_docs, n_terms, df = counted(docs, terms)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(f) + 1)))
                        for f in df], np.int64)
    shared = context.broadcast((items.tables(), weights, n_docs, n_terms))

    def rows(batches):
        (terms, item_ids, sizes, first, items_of, repeats), weights, n_docs, n_terms = shared.value
        scanner, best = Scanner(terms), Best(len(item_ids), k)
        at_once = max(AT_ONCE // len(item_ids), 1)

        def part(ids, missing, texts):
            number, term, tf, m = [], [], [], []
            for i, text in enumerate(texts):
                n, found = scanner.counts(text)
                if found:
                    m += [75 + 25 * n * n_docs // n_terms] * len(found)
                    number += [i] * len(found)
                    term += found.keys()
                    tf += found.values()
            if not term:
                return
            number, term, tf, m = (np.array(x, np.int64) for x in (number, term, tf, m))
            gain = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m))
            size = sizes[term]
            spread = np.repeat(np.arange(len(term)), size)
            at = np.arange(len(spread)) - np.repeat(np.cumsum(size) - size - first[term], size)
            scores = np.zeros(len(texts) * len(item_ids), np.int64)
            np.add.at(scores, number[spread] * len(item_ids) + items_of[at],
                      repeats[at] * gain[spread])
            best.add(ids, missing, scores.reshape(len(texts), -1))

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            missing = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = batch.column(2).to_pylist()
            for i in range(0, len(texts), at_once):
                j = i + at_once
                part(ids[i:j], missing[i:j], texts[i:j])
        item, missing, ids, scores = best.settle()
        yield pa.record_batch(
            [pa.array([item_ids[i] for i in item], pa.int64()), pa.array(item, pa.int32()),
             pa.array(ids, mask=missing.astype(bool)), pa.array(scores)],
            ["item_id", "place", "doc_id", "score"])

    return docs.select(
        F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"),
        F.col("doc_id").isNull().cast("int").alias("missing"), "text").mapInArrow(
        rows, "item_id long, place int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id",
           item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items, its k best documents of score above 0.

    A term's weight falls with the documents that hold it; a document's length tempers the count of
    its terms; all is whole-number arithmetic. Equal scores go by doc_id, nulls last. Every row is a
    document of its own, also where rows are repeated; every item is one too, also where its id is
    null or repeated. Null and empty texts hold no term: such items and documents are in no result.
    Empty tables give no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    order = Window.partitionBy("item_id", "place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    out = None
    for block in blocks(items, item_id, text):
        ranked = _scored(docs, block, k).withColumn("rank", F.row_number().over(order)).where(
            F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.union(ranked)
    return spark.createDataFrame(
        [], "item_id long, rank int, doc_id long, score long") if out is None else out
