"""Repeated byte strings by a distributed difference-cover suffix comparison.

A difference cover modulo 57 has eight residues whose differences are all residues. So whatever the
places of two equal strings of 100 bytes, some shift of at most 56 brings both to sampled places, and
the 44 bytes that follow there are equal as well. This is the difference-cover suffix algorithm with
samples of 44 bytes in place of triples, and with suffixes told apart only up to 100 bytes, which is
all that the comparison of adjacent prefixes needs:

1. sample: the 44 bytes at sampled places get names (hashes), which are sorted; a name that stands
   alone in the corpus ends the matter for its suffix (most do), so only repeated ones go on;
2. recursion: the suffixes that lead to a repeated name, sampled or not, are named again by their
   whole 100 bytes, from 64-bit hashes of prefixes;
3. merge: these names are sorted over the whole corpus; equal neighbours are equal prefixes, and the
   first place in order of (doc_id, start) stays.

Documents are dealt into chunks by ranges of doc_id, so that the order of chunks is the order of
places. A chunk sends each name once, sorted and packed, and gets one bit for each back: a name held
by a third of all places is sent once by each chunk. Texts are shuffled once, compressed; the rounds
read the same exchange. Whole copies of earlier texts are found first and take no further part.

Equality is that of 64-bit hashes of 100 bytes: for n places, the chance of one wrong pair is about
n^2 / 2^60.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyglass.llm.common import prepare, whole_text

LENGTH = 100
PERIOD, COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)
SAMPLE = LENGTH - PERIOD + 1
CHUNK_BYTES = 2 << 20
PART_NAMES = 1 << 21
BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15 * 8 + 5 & (1 << 64) - 1
LAST = (1 << 63) - 1


class Hashes:
    """Polynomial hashes of windows, modulo 2^64, over random values of bytes."""

    def __init__(self):
        self.values = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)
        power = np.ones(BLOCK + LENGTH, np.uint64)
        power[1:] = np.uint64(BASE)
        inverse = power.copy()
        inverse[1:] = np.uint64(pow(BASE, -1, 1 << 64))
        self.power, self.inverse = np.cumprod(power), np.cumprod(inverse)

    def of(self, text: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """The hash of the `width` bytes at each of the ascending places."""
        out = np.zeros(len(at), np.uint64)
        cuts = np.searchsorted(at, np.arange(0, len(text) + BLOCK, BLOCK))
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a < b:
                part = text[k * BLOCK:(k + 1) * BLOCK + width]
                sums = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(self.values[part] * self.power[:len(part)], out=sums[1:])
                i = at[a:b] - k * BLOCK
                out[a:b] = (sums[i + width] - sums[i]) * self.inverse[i]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ out >> np.uint64(30)


def parts_of(h: np.ndarray, parts: int) -> np.ndarray:
    return (h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


def pack(values: np.ndarray) -> bytes:
    """Sorted whole numbers; the two high bytes of each, which vary little, are compressed."""
    planes = values.astype(values.dtype.newbyteorder(">")).view(np.uint8).reshape(len(values), -1).T
    high = zlib.compress(np.ascontiguousarray(planes[:2]).tobytes(), 1)
    return len(high).to_bytes(4, "little") + high + np.ascontiguousarray(planes[2:]).tobytes()


def unpack(data: bytes, kind: str) -> np.ndarray:
    cut = 4 + int.from_bytes(data[:4], "little")
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zlib.decompress(data[4:cut]) + data[cut:], np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(np.dtype(kind).newbyteorder(">")).ravel().astype(kind)


class Chunk:
    """Documents of one range of ids: their texts in a row, without copies, and both rounds' names."""

    def __init__(self, docs: pa.Table, notes: pa.Table, parts: int):
        self.parts, self.hashes = parts, Hashes()
        kinds, numbers = notes.column("kind").to_pylist(), notes.column("part").to_pylist()
        payload = notes.column("payload").to_pylist()
        copies = {p for k, p in zip(kinds, payload, strict=True) if k == 0}
        self.bits = {(k, n): p for k, n, p in zip(kinds, numbers, payload, strict=True) if k}
        rows = sorted((LAST if i is None else i, i is None, zlib.decompress(t)) for i, t in zip(
            docs.column("doc_id").to_pylist(), docs.column("packed").to_pylist(), strict=True))
        self.rows, self.place, self.ids, texts, size = rows, [], [], [], 0
        for at, (doc, _, text) in enumerate(rows):
            if at and rows[at - 1] == rows[at]:
                self.place.append(self.place[-1])
            elif is_copy(doc, text, copies):
                self.place.append(-1)
            else:
                self.place.append(size)
                self.ids.append(doc)
                texts.append(text)
                size += len(text)
        self.text = np.frombuffer(b"".join(texts), np.uint8)
        self.starts = np.cumsum([0] + [len(t) for t in texts])

    def fits(self, width: int) -> np.ndarray:
        """True at places where so many bytes follow in the same document."""
        out = np.ones(len(self.text), bool)
        for a, b in zip(self.starts[:-1], self.starts[1:], strict=True):
            out[max(a, b - width + 1):b] = False
        return out

    def flags(self, kind: int, part: np.ndarray) -> np.ndarray:
        """The bits sent back for sorted names, whose parts are given in that order."""
        cuts = np.searchsorted(part, np.arange(self.parts + 1))
        out = np.zeros(len(part), bool)
        for k in np.nonzero(np.diff(cuts))[0].tolist():
            bits = np.frombuffer(self.bits[kind, k], np.uint8)
            out[cuts[k]:cuts[k + 1]] = np.unpackbits(bits, count=int(cuts[k + 1] - cuts[k]))
        return out

    def sampled(self):
        """Sampled places, their distinct sorted names, and which name each place has."""
        residue = np.zeros(PERIOD, bool)
        residue[list(COVER)] = True
        wanted = np.resize(residue, len(self.text)) & self.fits(SAMPLE)
        at = np.nonzero(wanted)[0]
        h = self.hashes.of(self.text, at, SAMPLE)
        code = parts_of(h, self.parts) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)
        names, name_of, count = np.unique(code, return_inverse=True, return_counts=True)
        return at, names, name_of, count

    def suffixes(self):
        """Places that lead to a repeated sample, and the sorted distinct names of their 100 bytes."""
        at, names, name_of, count = self.sampled()
        repeated = (count > 1) | self.flags(1, names >> np.uint64(32))
        hot = at[repeated[name_of]]
        edge = np.zeros(len(self.text) + 1, np.int32)
        np.add.at(edge, np.maximum(hot - PERIOD + 1, 0), 1)
        np.add.at(edge, hot + 1, -1)
        places = np.nonzero((np.cumsum(edge[:-1]) > 0) & self.fits(LENGTH))[0]
        names, name_of = np.unique(self.hashes.of(self.text, places, LENGTH), return_inverse=True)
        return places, names, name_of

    def removed(self) -> np.ndarray:
        """True at bytes of a 100-byte string that also starts earlier."""
        places, names, name_of = self.suffixes()
        earlier = self.flags(2, parts_of(names, self.parts))[name_of]
        doc = np.searchsorted(self.starts, places, side="right") - 1
        ranks = np.unique(self.ids, return_inverse=True)[1] if len(self.ids) else np.zeros(0, int)
        order = ranks[doc] * np.int64(1 << 40) + (places - self.starts[doc])
        first = np.full(len(names), LAST)
        np.minimum.at(first, name_of, order)
        matched = places[earlier | (order > first[name_of])]
        edge = np.zeros(len(self.text) + 1, np.int32)
        np.add.at(edge, matched, 1)
        np.add.at(edge, matched + LENGTH, -1)
        return np.cumsum(edge[:-1]) > 0

    def results(self) -> pa.Table:
        gone, out = self.removed(), {"doc_id": [], "n_bytes": [], "spans": [], "kept": []}
        for (doc, null, text), at in zip(self.rows, self.place, strict=True):
            cut = np.ones(len(text), bool) if at < 0 else gone[at:at + len(text)]
            turns = np.flatnonzero(np.diff(np.concatenate(([0], cut.view(np.int8), [0]))))
            out["doc_id"].append(None if null else doc)
            out["n_bytes"].append(len(text))
            out["spans"].append([{"start": a, "stop": b} for a, b in turns.reshape(-1, 2).tolist()])
            out["kept"].append(np.frombuffer(text, np.uint8)[~cut].tobytes())
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        kinds = (pa.int64(), pa.int64(), span, pa.binary())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})


def is_copy(doc: int, text: bytes, copies: set[bytes]) -> bool:
    import xxhash

    return len(text) >= LENGTH and (doc.to_bytes(8, "little", signed=True)
                                    + xxhash.xxh64_digest(text, 42)[::-1]) in copies


def sent(chunk: int, names: np.ndarray, part: np.ndarray, parts: int) -> pa.Table:
    """Rows (part, chunk, payload) of sorted names."""
    cuts = np.searchsorted(part, np.arange(parts + 1))
    full = np.nonzero(np.diff(cuts))[0].tolist()
    return pa.table({"part": pa.array(full, pa.int32()),
                     "chunk": pa.array([chunk] * len(full), pa.int32()),
                     "payload": pa.array([pack(names[cuts[k]:cuts[k + 1]]) for k in full],
                                         pa.binary())})


def compared(kind: int, dtype: str):
    """A function of one part's names that sends a bit back for each: met in another chunk (kind 1),
    or in an earlier one (kind 2)."""
    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        packs = [unpack(p, dtype) for p in rows.column("payload").to_pylist()]
        values = np.concatenate(packs)
        order = np.argsort(values, kind="stable")
        same = values[order[1:]] == values[order[:-1]]
        flag = np.zeros(len(values), bool)
        flag[order[1:]] = same
        if kind == 1:
            flag[order[:-1]] |= same
        cuts = np.cumsum([len(p) for p in packs])[:-1]
        return pa.table({
            "chunk": rows.column("chunk"), "kind": pa.array([kind] * len(packs), pa.int32()),
            "part": rows.column("part"),
            "payload": pa.array([np.packbits(f).tobytes() for f in np.split(flag, cuts)],
                                pa.binary())})
    return compare


NOTE = "chunk int, kind int, part int, payload binary"


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   chunk_bytes: int = CHUNK_BYTES, part_names: int = PART_NAMES) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row of docs: the bytes left, and the runs taken out.

    A byte goes if a string of 100 bytes over it also starts earlier, at a smaller doc_id, or in the
    same document at a smaller start; matches do not cross documents. Strings are judged on the
    input. Rows of one doc_id are one document; equal rows are judged alike. A null doc_id comes
    after all others. Null texts are empty; an empty table gives no rows. Columns of docs other than
    the two named are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    size, count, parts_least = (*source.agg(
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("doc_id")).first(),
        int(spark.conf.get("spark.sql.shuffle.partitions")))
    chunks = max(1, -(-size // chunk_bytes))
    parts = max(parts_least, size * len(COVER) // PERIOD // part_names + 1)
    bounds = np.array(sorted(set(source.approxQuantile(
        "doc_id", [k / chunks for k in range(1, chunks)], 0.1 / chunks))) if count and chunks > 1
        else [], np.int64)

    def deal(batches):
        for batch in batches:
            ids = batch.column(0).fill_null(LAST).to_numpy()
            chunk = np.searchsorted(bounds, ids, side="right").astype(np.int32)
            packed = [zlib.compress(t, 1) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunk), batch.column(0), pa.array(packed, pa.binary())],
                ["chunk", "doc_id", "packed"])

    dealt = source.mapInArrow(deal, "chunk int, doc_id long, packed binary")
    order = F.coalesce("doc_id", F.lit(LAST))
    digests = source.where(F.octet_length("text") >= LENGTH).select(
        order.alias("doc"), F.xxhash64("text").alias("h"),
        F.xxhash64(F.lit("again"), "text").alias("g"))
    firsts = digests.groupBy("h", "g").agg(F.min("doc").alias("first"), F.count("*").alias("n"))
    copies = digests.join(firsts.where("n > 1"), ["h", "g"]).where("doc > first").select("doc", "h")

    def note(batches):
        for batch in batches:
            ids, h = (batch.column(k).to_numpy().astype("<i8") for k in (0, 1))
            chunk = np.searchsorted(bounds, ids, side="right").astype(np.int32)
            keys = np.column_stack((ids, h)).view(np.uint8).reshape(len(ids), 16)
            zero = np.zeros(len(ids), np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunk), pa.array(zero), pa.array(zero),
                 pa.array([k.tobytes() for k in keys], pa.binary())],
                ["chunk", "kind", "part", "payload"])

    notes = copies.mapInArrow(note, NOTE)

    def of_chunk(work):
        def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
            return work(key[0].as_py(), Chunk(left, right, parts))
        return run

    def first_round(number: int, chunk: Chunk) -> pa.Table:
        names = chunk.sampled()[1]
        return sent(number, (names & np.uint64(0xFFFFFFFF)).astype(np.uint32),
                    names >> np.uint64(32), parts)

    def second_round(number: int, chunk: Chunk) -> pa.Table:
        names = chunk.suffixes()[1]
        return sent(number, names, parts_of(names, parts), parts)

    def meet(work, schema):
        return dealt.groupBy("chunk").cogroup(notes.groupBy("chunk")).applyInArrow(
            of_chunk(work), schema)

    for kind, work, dtype in ((1, first_round, "u4"), (2, second_round, "u8")):
        names = meet(work, "part int, chunk int, payload binary")
        notes = notes.union(names.groupBy("part").applyInArrow(compared(kind, dtype), NOTE))
    return meet(lambda _, chunk: chunk.results(), "doc_id long, n_bytes long, "
                "spans array<struct<start:bigint,stop:bigint>>, kept binary")
