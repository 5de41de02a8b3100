"""Language-model scores by prediction by partial matching over bytes, beside word counts.

The model is a trie of byte contexts up to ORDER bytes, counted over all training texts. A symbol
is coded in the longest context that training has seen; if it never followed there, an escape is
paid (method C: as many escapes as distinct followers) and the next shorter context is tried, without
the symbols that the longer one has ruled out (exclusion). Below all contexts every symbol left is
equally likely. A text ends with a symbol of its own, which also stands before its first byte.

The trie is never held in one place. Texts are dealt into chunks and shuffled once, compressed. Each
chunk sends every distinct string of context and symbol once, with its count. The trie is split by
the two nearest bytes of the context: a part holds all longer contexts beneath them, and gets the two
shortest levels (257 x 257 counts at most) as a broadcast table. It answers each chunk with the log
probability of each string, and the chunk adds them up. Words are counted in the same way.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyglass.llm.common import held_out, prepare, whole_text
from tallyglass.llm.repeats import pack, parts_of, unpack

ORDER = 5
SYMBOLS, END = 257, 256
CHUNK_BYTES = 6 << 20
PART_BYTES = 12 << 20
BLOCK = 1 << 20
ANSWER = "chunk int, part int, payload binary, seen long, total long"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def pack_counts(counts: np.ndarray) -> bytes:
    planes = counts.astype("<i8").view(np.uint8).reshape(-1, 8).T
    return zlib.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack_counts(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts in a row as symbols, each with its marks around it, and where each begins."""
    size = np.array([len(t) + ORDER + 1 for t in texts], np.int64)
    out = np.full(int(size.sum()), END, np.uint16)
    starts = np.cumsum(size) - size
    for a, text in zip(starts.tolist(), texts, strict=True):
        out[a + ORDER:a + ORDER + len(text)] = np.frombuffer(text, np.uint8)
    return out, starts


def coded(line: np.ndarray, starts: np.ndarray):
    """Blocks of (text numbers, symbols of each, codes) of all symbols to be predicted, in a row; a
    code is the context, nearest byte first, and the symbol."""
    for a in range(0, len(line), BLOCK):
        low, high = max(a, ORDER), min(a + BLOCK, len(line))
        if low >= high:
            continue
        code = np.zeros(high - low, np.uint64)
        for k in (*range(1, ORDER + 1), 0):
            code <<= np.uint64(9)
            code |= line[low - k:high - k]
        text = np.arange(*np.searchsorted(starts, (low, high - 1), side="right") + (-1, 0))
        first = np.maximum(starts[text] + ORDER, low)
        many = np.maximum(np.append(starts[text[1:]], high) - first, 0)
        wanted = np.ones(len(code), bool)
        for k in range(ORDER):
            marks = starts[text] + k - low
            wanted[marks[(marks >= 0) & (marks < len(code))]] = False
        yield text, many, code[wanted]


def words_in(text: bytes):
    """Lists of the words of a text, a stretch of the text at a time."""
    a = 0
    while a < len(text):
        b = a + BLOCK
        while b < len(text) and text[b] not in b" \t\n\r\x0b\x0c":
            b += 1
        yield text[a:b].split()
        a = b


class Numbers(dict):
    """Numbers of things, as they come."""

    def __missing__(self, thing) -> int:
        self[thing] = number = len(self)
        return number


class Chunk:
    """Texts of one chunk, in lower case, with their ids and whether they are held out."""

    def __init__(self, docs: pa.Table):
        self.ids = docs.column("doc_id")
        self.held = np.array(docs.column("held_out").to_pylist(), bool)
        self.texts = [zlib.decompress(t) for t in docs.column("packed").to_pylist()]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the distinct words, sorted, and their counts in training."""
        count, others = Counter(), set()
        for text, held in zip(self.texts, self.held, strict=True):
            for words in words_in(text):
                (others if held else count).update(words)
        others -= count.keys()
        names, at = word_names([*count, *others])
        counts = np.zeros(len(names), np.int64)
        np.add.at(counts, at[:len(count)], np.fromiter(count.values(), np.int64, len(count)))
        return names, counts

    def word_places(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Hashes of the distinct words, sorted, and each text's words as places among them."""
        number = Numbers()
        lines = [[np.fromiter(map(number.__getitem__, words), np.int32, len(words))
                  for words in words_in(text)] for text in self.texts]
        names, at = word_names(number)
        return names, [at[np.concatenate([np.zeros(0, np.int32), *line])] for line in lines]

    def strings(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct codes, sorted, and their counts in training."""
        parts, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for text, many, code in coded(*symbols(self.texts)):
            code <<= np.uint64(1)
            code |= np.repeat(~self.held[text], many)
            both, n = np.unique(code, return_counts=True)
            parts.append(both >> np.uint64(1))
            counts.append(n * (both & np.uint64(1)).astype(np.int64))
        return summed(np.concatenate(parts), np.concatenate(counts))

    def places(self) -> tuple[np.ndarray, list]:
        """Distinct codes, sorted, and blocks of (text numbers, symbols of each, places among them)."""
        blocks, parts = [], [np.zeros(0, np.uint64)]
        for text, many, code in coded(*symbols(self.texts)):
            own, at = numbered(code)
            blocks.append((text, many, at))
            parts.append(own)
        names, place = distinct(np.concatenate(parts))
        ends = np.cumsum([len(own) for own in parts])
        return names, [(text, many, place[a:b].astype(np.int32)[at]) for (text, many, at), a, b
                       in zip(blocks, ends[:-1], ends[1:], strict=True)]


def word_names(words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words, sorted, and the place of each word among them."""
    import xxhash

    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)),
                     return_inverse=True)


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys as they come, and the place of each key among them."""
    found = pa.array(keys).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the place of each key among them."""
    names, at = numbered(keys)
    order = np.argsort(names)
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    return names[order], place[at]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of counts of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else []
    return keys[first], (np.add.reduceat(counts[order], first) if len(keys) else counts)


def string_part(code: np.ndarray, parts: int) -> np.ndarray:
    """The part of a code: by the two nearest bytes of its context."""
    return parts_of(mix(code >> np.uint64(9 * (ORDER - 1))), parts)


def pieces(part: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The parts that occur, and the places of each in their order."""
    order = np.argsort(part, kind="stable")
    at, first = np.unique(part[order], return_index=True)
    return at, np.split(order, first[1:]) if len(at) else []


def sent(chunk: int, names: np.ndarray, counts: np.ndarray, part: np.ndarray) -> pa.Table:
    """Rows (part, chunk, payload, counts); names stay sorted within a part."""
    at, places = pieces(part)
    return pa.table({
        "part": pa.array(at.astype(np.int32)),
        "chunk": pa.array([chunk] * len(at), pa.int32()),
        "payload": pa.array([pack(names[p]) for p in places], pa.binary()),
        "counts": pa.array([pack_counts(counts[p]) for p in places], pa.binary())})


def answered(rows: pa.Table, answer, write) -> pa.Table:
    """What a part sends back to each chunk; answer(keys, counts) gives values for sorted keys."""
    packs = [unpack(p, "u8") for p in rows.column("payload").to_pylist()]
    counts = [unpack_counts(c) for c in rows.column("counts").to_pylist()]
    keys, total = summed(np.concatenate(packs), np.concatenate(counts))
    values = answer(keys, total)
    zero = [0] * (len(packs) - 1)
    return pa.table({
        "chunk": rows.column("chunk"), "part": rows.column("part"),
        "payload": pa.array([write(values[np.searchsorted(keys, p)]) for p in packs], pa.binary()),
        "seen": pa.array([int((total > 0).sum()), *zero], pa.int64()),
        "total": pa.array([int(total.sum()), *zero], pa.int64())})


def look_up(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted key among sorted distinct keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Level:
    """All contexts of one length in a part: followers with counts, and sums of each context."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        context = keys >> np.uint64(9)
        first = np.flatnonzero(np.diff(context, prepend=~context[:1]))
        self.contexts = context[first]
        self.distinct = np.diff(np.concatenate((first, [len(keys)])))
        self.first = first
        self.total = np.add.reduceat(counts, first) if len(keys) else counts

    def count(self, wanted: np.ndarray) -> np.ndarray:
        at = look_up(self.keys, wanted)
        return np.where(at >= 0, self.counts[at], 0) if len(self.keys) else np.zeros(len(at), int)


def shorter(code: np.ndarray, order: int) -> np.ndarray:
    """Codes of ORDER bytes of context as codes of fewer: the farthest bytes go."""
    cut = np.uint64(9 * (ORDER - order + 1))
    return (code >> cut) << np.uint64(9) | code & np.uint64(511)


def log_probabilities(keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 of the probability of each code, from the counts of all codes that share two bytes of
    context with it, and the counts of (byte before, symbol) of the whole corpus."""
    seen = counts > 0
    levels = {k: Level(*summed(shorter(keys[seen], k), counts[seen])) for k in range(2, ORDER + 1)}
    before, symbol = np.nonzero(pairs)
    levels[1] = Level(before.astype(np.uint64) << np.uint64(9) | symbol.astype(np.uint64),
                      pairs[before, symbol])
    single = pairs.sum(0)
    levels[0] = Level(np.nonzero(single)[0].astype(np.uint64), single[single > 0])
    out, found = np.zeros(len(keys)), np.zeros(len(keys), bool)
    longer = np.full(len(keys), -1)
    for order in range(ORDER, -1, -1):
        level = levels[order]
        code = shorter(keys, order)
        context = look_up(level.contexts, code >> np.uint64(9))
        total = np.where(context >= 0, level.total[context] if len(level.total) else 0, 0)
        kinds = np.where(context >= 0, level.distinct[context] if len(level.total) else 0, 0)
        if order < ORDER and len(above.keys):
            cut = above.keys >> np.uint64(18) << np.uint64(9) | above.keys & np.uint64(511)
            ruled = np.add.reduceat(level.count(cut), above.first)
            total = total - np.where(longer >= 0, ruled[longer], 0)
            kinds = kinds - np.where(longer >= 0, above.distinct[longer], 0)
        here = level.count(code)
        open_ = ~found & (kinds > 0)
        hit, miss = open_ & (here > 0), open_ & (here == 0)
        out[hit] += np.log10(here[hit] / (total[hit] + kinds[hit]))
        out[miss] += np.log10(kinds[miss] / (total[miss] + kinds[miss]))
        found |= hit
        longer, above = context, level
    left = np.where(longer >= 0, SYMBOLS - len(levels[0].keys), SYMBOLS)
    out[~found] -= np.log10(left[~found])
    return out


def pair_counts(source: DataFrame) -> np.ndarray:
    """Counts of (byte before, symbol) over the training texts: 257 x 257 numbers at most."""
    def count(batches):
        total = np.zeros(SYMBOLS * SYMBOLS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for a in range(0, len(text) + 1, BLOCK):
                    part = np.frombuffer(text[max(a - 1, 0):a + BLOCK].lower(), np.uint8)
                    line = part.astype(np.int64)
                    if a == 0:
                        line = np.concatenate(([END], line))
                    if a + BLOCK > len(text):
                        line = np.concatenate((line, [END]))
                    total += np.bincount(line[:-1] * SYMBOLS + line[1:], minlength=len(total))
        at = np.nonzero(total)[0]
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["pair", "n"])

    rows = source.where("not held_out").select("text").mapInArrow(
        count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SYMBOLS * SYMBOLS, np.int64)
    for r in rows:
        out[r["pair"]] = r["n"]
    return out.reshape(SYMBOLS, SYMBOLS)


def score(docs: DataFrame, modulo: int = 10, doc_id: str = "doc_id", text: str = "text",
          chunk_bytes: int = CHUNK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    Rows whose crc32 of doc_id (null: empty) leaves no remainder by modulo are held out, the others
    train. A-Z count as lower case. base_score adds, over words and one end, the smoothed log10 share
    of the token in training; score is the log10 probability of the bytes and the end by the trie.
    Null texts are empty: one end. Repeated rows count each time. An empty table gives no rows; with
    nothing to train on, all symbols are equally likely. Columns of docs not named are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                         held_out(doc_id, modulo).alias("held_out"), whole_text(text).alias("text"))
    size, ends = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)),
                            F.count_if(~F.col("held_out"))).first()
    chunks = max(1, -(-size // chunk_bytes))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // part_bytes)
    pairs = spark.sparkContext.broadcast(pair_counts(source))

    def deal(batches):
        for batch in batches:
            packed = [zlib.compress(t.lower(), 1) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary())],
                                             ["chunk", "doc_id", "held_out", "packed"])

    dealt = source.select(
        F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(chunks)).cast("int").alias(
            "chunk"), "doc_id", "held_out", "text").mapInArrow(
        deal, "chunk int, doc_id long, held_out boolean, packed binary").groupBy("chunk")

    def send_words(key, rows):
        names, counts = Chunk(rows).words()
        return sent(key[0].as_py(), names, counts, parts_of(names, parts))

    def send_strings(key, rows):
        names, counts = Chunk(rows).strings()
        return sent(key[0].as_py(), names, counts, string_part(names, parts))

    def count_words(rows: pa.Table) -> pa.Table:
        return answered(rows, lambda _, total: total, pack_counts)

    def rate_strings(rows: pa.Table) -> pa.Table:
        return answered(rows, lambda keys, total: log_probabilities(keys, total, pairs.value),
                        lambda values: values.astype("<f4").tobytes())

    names = "part int, chunk int, payload binary, counts binary"
    words = dealt.applyInArrow(send_words, names).groupBy("part").applyInArrow(count_words, ANSWER)
    strings = dealt.applyInArrow(send_strings, names).groupBy("part").applyInArrow(
        rate_strings, ANSWER)
    answers = words.withColumn("kind", F.lit("w")).union(strings.withColumn("kind", F.lit("s"))
                                                         ).select("chunk", "kind", "part", "payload")

    def finish(rows: pa.Table, notes: pa.Table) -> pa.Table:
        chunk = Chunk(rows)
        got = dict(zip(zip(notes.column("kind").to_pylist(), notes.column("part").to_pylist(),
                           strict=True), notes.column("payload").to_pylist(), strict=True))

        def values(kind, part, read, dtype):
            out = np.zeros(len(part), dtype)
            for k, at in zip(*pieces(part), strict=True):
                out[at] = read(got[kind, int(k)])
            return out

        codes, blocks = chunk.places()
        log = values("s", string_part(codes, parts), lambda b: np.frombuffer(b, "<f4"), float)
        score_ = np.zeros(len(chunk.texts))
        for text, many, at in blocks:
            score_ += np.bincount(np.repeat(text, many), log[at], len(score_))
        hashes, lines = chunk.word_places()
        count = values("w", parts_of(hashes, parts), unpack_counts, np.int64)
        share = np.log10(count + 0.1)
        tokens, known, base = [], [], []
        for line in lines:
            tokens.append(len(line) + 1)
            known.append(int((count[line] > 0).sum()))
            base.append(float(share[line].sum()))
        return pa.table({
            "doc_id": chunk.ids, "held_out": rows.column("held_out"),
            "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(known, pa.int64()),
            "shares": pa.array(base, pa.float64()), "score": pa.array(score_)})

    out = dealt.cogroup(answers.groupBy("chunk")).applyInArrow(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, shares double, "
                "score double")
    facts = words.agg(F.struct((F.coalesce(F.sum("total"), F.lit(0)) + ends).alias("n"),
                               (F.coalesce(F.sum("seen"), F.lit(0)) + int(ends > 0)).alias("v")
                               ).alias("facts")).scalar()
    out = out.withColumn("facts", facts)
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + int(ends > 0)).alias("n_known"), F.col("facts.n").alias("train_tokens"),
        (F.col("shares") + float(np.log10(ends + 0.1)) - F.col("n_tokens") * F.log10(
            F.col("facts.n") + 0.1 * (F.col("facts.v") + 1))).alias("base_score"), "score")
