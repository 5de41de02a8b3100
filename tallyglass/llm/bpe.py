"""Byte-level BPE as a monoid: halves are encoded apart and joined, in any order of joining.

The text is cut by the tokenizer's pattern, and each piece is encoded by itself. A piece is halved
down to short leaves; leaves are merged by rank. Two encoded neighbours are joined by encoding a
window around their border anew. The window grows until its outermost tokens come out as they went
in. Then every two neighbouring tokens of the result are what encoding their bytes alone gives, and
a sequence with that property is the encoding of the whole: the first merge across a border
would also happen within the two tokens at that border. So all tokens outside are proved stable.

A worker keeps the tokens of stretches that it has met, from one task to the next, up to a bound
and oldest first to go; this changes no result.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyglass.llm.common import prepare, whole_text

LEAF = 24
#: Cuts at single spaces between two visible characters, and what tells that a text has others.
SINGLE_SPACES = r"(?<=\S) (?=\S)"
BLANK = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]"
BESIDE_SPACE = f"^ | $| {BLANK}|{BLANK} "
KEPT_PIECES, KEPT_LENGTH = 150_000, 64


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The ranks of a file of `base64 rank` lines, read where the driver runs (about 1 MB)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Merge the pair of least rank, leftmost first, until no pair has a rank."""
    none, get = len(ranks) + (1 << 40), ranks.get
    ends = list(range(len(piece) + 1))
    pairs = [get(piece[i:i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) != none:
        i = pairs.index(least)
        del pairs[i], ends[i + 1]
        if i:
            pairs[i - 1] = get(piece[ends[i - 1]:ends[i + 1]], none)
        if i < len(pairs):
            pairs[i] = get(piece[ends[i]:ends[i + 2]], none)
    return [piece[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def join(left: list[bytes], right: list[bytes], ranks: dict[bytes, int]) -> list[bytes]:
    """The encoding of two neighbours' bytes, from their encodings."""
    if not left or not right:
        return left + right
    a = b = 1
    while True:
        a, b = min(a, len(left)), min(b, len(right))
        window = merge(b"".join(left[-a:]) + b"".join(right[:b]), ranks)
        left_stays = a == len(left) or window[0] == left[-a]
        right_stays = b == len(right) or window[-1] == right[b - 1]
        if left_stays and right_stays:
            return left[:-a] + window + right[b:]
        a, b = a if left_stays else 2 * a, b if right_stays else 2 * b


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens of one piece, as bytes, by tree reduction over its halves."""
    if piece in ranks:
        return [piece]
    if len(piece) <= LEAF:
        return merge(piece, ranks)
    level = [merge(piece[i:i + LEAF], ranks) for i in range(0, len(piece), LEAF)]
    while len(level) > 1:
        level = [join(level[i], level[i + 1], ranks) if i + 1 < len(level) else level[i]
                 for i in range(0, len(level), 2)]
    return level[0] if level else []


class Leaves:
    """Merges many short pieces at once: in each round, every piece its own pair of least rank."""

    def __init__(self, ranks: dict[bytes, int]):
        import numpy as np

        self.many = max(ranks.values(), default=0) + 1
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = sorted((ranks[t[:i]] * self.many + ranks[t[i:]], r) for t, r in ranks.items()
                       for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        self.pairs = np.array([p for p, _ in pairs] + [np.iinfo(np.int64).max])
        self.ranks = np.array([r for _, r in pairs] + [0], np.int32)
        self.none = np.iinfo(np.int32).max

    def rank(self, left, right):
        """The rank of each pair of tokens, which is what they merge into; none where there is none."""
        import numpy as np

        key = left * self.many + right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.ranks[at], self.none)

    def merged(self, data, size):
        """(ids of all pieces one after another, number of ids of each): the pieces lie in data one
        after another, and each has one byte or more."""
        import numpy as np

        place = np.arange(int(size.max()))
        inside = place < size[:, None]
        token = np.full(inside.shape, -1, np.int64)
        token[inside] = self.byte[data]
        after = np.tile((place + 1).astype(np.int16), (len(size), 1))
        before = after - np.int16(2)
        rank = np.full(inside.shape, self.none, np.int32)
        both = inside[:, 1:]
        rank[:, :-1][both] = self.rank(token[:, :-1][both], token[:, 1:][both])
        row = np.arange(len(size))
        while len(row):
            here = rank[row]
            left = here.argmin(1)
            new = here[np.arange(len(row)), left]
            go = new != self.none
            row, left, new = row[go], left[go], new[go].astype(np.int64)
            right = after[row, left]
            far = after[row, right]
            token[row, left], token[row, right] = new, -1
            after[row, left], rank[row, right], rank[row, left] = far, self.none, self.none
            some = far < size[row]
            r, k = row[some], far[some]
            before[r, k] = left[some]
            rank[r, left[some]] = self.rank(new[some], token[r, k])
            near = before[row, left]
            some = near >= 0
            rank[row[some], near[some]] = self.rank(token[row[some], near[some]], new[some])
        left = token >= 0
        return token[left].astype("<u4"), left.sum(1)


class Encoder:
    """Texts to ids. Stretches between cuts are looked up whole, by what follows the space that they
    begin with; of a batch of texts each distinct one is encoded once, all new ones together."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cuts: str | None,
                 one_piece: str | None = None):
        import re

        import numpy as np
        import regex

        self.ranks, self.find, self.cuts = ranks, regex.compile(pattern).findall, cuts
        self.split = re.compile(cuts).split if cuts else lambda text: [text]
        self.ids = {token: rank.to_bytes(4, "little") for token, rank in ranks.items()}
        self.leaves = Leaves(ranks)
        self.known, self.old = {}, {}
        # Pieces that are tokens are so at once; where merging would not find one of them, pieces
        # are looked up one by one.
        short = [t for t in ranks if len(t) <= LEAF]
        many = self.leaves.merged(np.frombuffer(b"".join(short), np.uint8),
                                  np.fromiter(map(len, short), np.int64, len(short)))[1]
        self.one_piece = one_piece if (many == 1).all() else None

    def encoded(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of each piece: short ones together, long ones by tree reduction."""
        import numpy as np

        out, short, ids = {}, [], self.ids
        for piece in pieces:
            data = piece.encode("utf-8", "surrogatepass")
            if data in ids:
                out[piece] = ids[data]
            elif len(data) <= LEAF:
                short.append((len(data), data, piece))
            else:
                out[piece] = b"".join(map(ids.__getitem__, encode_piece(data, self.ranks)))
        short.sort(key=lambda x: x[0])
        for k in range(0, len(short), 1 << 14):
            part = short[k:k + (1 << 14)]
            flat, many = self.leaves.merged(
                np.frombuffer(b"".join([data for _, data, _ in part]), np.uint8),
                np.array([size for size, _, _ in part]))
            flat, end = flat.tobytes(), 0
            for (_, _, piece), n in zip(part, many.tolist(), strict=True):
                out[piece] = flat[end:(end := end + 4 * n)]
        return out

    def looked_up(self, stretches: list[str]) -> list[bytes]:
        """The ids of distinct stretches, the space before them included."""
        known, old = self.known, self.old
        out = [known.get(rest) or old.get(rest) for rest in stretches]
        new = [i for i, ids in enumerate(out) if ids is None]
        found = [self.find(" " + stretches[i]) for i in new]
        ids = self.encoded(set().union(*found))
        for i, pieces in zip(new, found, strict=True):
            out[i] = ids[pieces[0]] if len(pieces) == 1 else b"".join([ids[p] for p in pieces])
        # Two generations of bounded size: what is met again moves to the new one.
        if len(known) > KEPT_PIECES:
            self.old, self.known = known, {}
        self.known.update(x for x in zip(stretches, out, strict=True) if len(x[0]) <= KEPT_LENGTH)
        return out

    def cut(self, texts: pa.Array):
        """(stretches, number of them of each text); all but a text's first follow a space."""
        import numpy as np
        import pyarrow.compute as pc

        if self.cuts != SINGLE_SPACES:
            lists = [self.split(t) for t in texts.to_pylist()]
            return pa.array([x for parts in lists for x in parts], pa.large_string()), np.array(
                [len(parts) for parts in lists], np.int64)
        # Where no white space stands beside a space, every space is a cut.
        odd = pc.match_substring_regex(texts, BESIDE_SPACE).to_numpy(zero_copy_only=False)
        plain = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        lists = [self.split(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        stretches = pa.concat_arrays([plain.flatten().cast(pa.large_string()), pa.array(
            [x for parts in lists for x in parts], pa.large_string())])
        many = np.zeros(len(texts), np.int64)
        many[~odd] = pc.list_value_length(plain).to_numpy(zero_copy_only=False)
        many[odd] = [len(parts) for parts in lists]
        # Back into the order of the texts.
        order = np.concatenate((np.flatnonzero(~odd), np.flatnonzero(odd)))
        start = np.zeros(len(texts), np.int64)
        start[order] = np.cumsum(many[order]) - many[order]
        at = np.arange(many.sum()) + np.repeat(start - np.cumsum(many) + many, many)
        return (stretches.take(pa.array(at)) if odd.any() else stretches), many

    def packed(self, texts: pa.Array):
        """(ids of all texts one after another, where each text's ids end)."""
        import numpy as np
        import pyarrow.compute as pc

        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        stretches, many = self.cut(texts)
        first = np.cumsum(many) - many
        rest = np.ones(len(stretches), bool)
        rest[first] = False
        named = pc.dictionary_encode(stretches.filter(pa.array(rest)))
        flat, size, order = self.table(named.dictionary)
        starts = [self.find(t) for t in stretches.take(pa.array(first)).to_pylist()]
        ids = self.encoded(set().union(*starts))
        starts = [b"".join([ids[p] for p in pieces]) for pieces in starts]
        entry = np.zeros(len(stretches), np.int64)
        entry[rest] = order[named.indices.to_numpy(zero_copy_only=False)]
        entry[first] = len(size) + np.arange(len(texts))
        flat = np.concatenate((flat, np.frombuffer(b"".join(starts), "<u4")))
        size = np.concatenate((size, [len(x) // 4 for x in starts]))
        begin = np.cumsum(size) - size
        wide = size[entry]
        end = np.cumsum(wide)
        at = np.arange(end[-1]) + np.repeat(begin[entry] - end + wide, wide)
        return flat[at], end[first + many - 1]

    def table(self, distinct: pa.Array):
        """(ids of distinct stretches one after another in some order, number of ids of each in that
        order, place of each stretch in that order)."""
        import numpy as np
        import pyarrow.compute as pc

        length = pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        fast = np.zeros(len(distinct), bool)
        if self.one_piece is not None and len(distinct):
            fast = (length <= LEAF) & pc.match_substring_regex(distinct, self.one_piece).to_numpy(
                zero_copy_only=False)
        place = np.flatnonzero(fast)
        place = place[np.argsort(length[place], kind="stable")]
        slow = np.flatnonzero(~fast)
        order = np.empty(len(distinct), np.int64)
        order[np.concatenate((place, slow))] = np.arange(len(distinct))
        flats, sizes = [], []
        for k in range(0, len(place), 1 << 14):
            part = place[k:k + (1 << 14)]
            space, none = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
            words = pc.binary_join_element_wise(space, distinct.take(pa.array(part)), none)
            size = length[part]
            flat, many = self.leaves.merged(
                np.frombuffer(words.buffers()[2], np.uint8)[:int(size.sum())], size)
            flats.append(flat)
            sizes.append(many)
        ids = self.looked_up(distinct.take(pa.array(slow)).to_pylist())
        flats.append(np.frombuffer(b"".join(ids), "<u4"))
        sizes.append(np.array([len(x) // 4 for x in ids], np.int64))
        return np.concatenate(flats), np.concatenate(sizes), order


def _binary(data: bytes, ends) -> pa.Array:
    """Values that lie one after another, by where each ends."""
    import numpy as np

    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [
        None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


class Decoder:
    """Ids to bytes: all tokens lie in one buffer, and ids gather their bytes from it."""

    def __init__(self, ranks: dict[bytes, int]):
        import numpy as np

        size = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        for token, rank in ranks.items():
            size[rank] = len(token)
        ordered = sorted(ranks, key=ranks.__getitem__)
        self.size, self.start = size, np.cumsum(size) - size
        self.buffer = np.frombuffer(b"".join(ordered), np.uint8)

    def decoded(self, ids):
        """(bytes of all ids, where each id's bytes end), put together from blocks up a tree."""
        import numpy as np

        blocks = [self.gathered(ids[i:i + (1 << 16)]) for i in range(0, len(ids), 1 << 16)]
        return concat(blocks), np.cumsum(self.size[ids])

    def gathered(self, ids) -> bytes:
        import numpy as np

        size = self.size[ids]
        end = np.cumsum(size)
        at = np.arange(end[-1]) + np.repeat(self.start[ids] - end + size, size)
        return self.buffer[at].tobytes()

    def texts(self, ids, ends) -> pa.Array:
        """The bytes of each text, given where its ids end."""
        import numpy as np

        data, end = self.decoded(ids)
        return _binary(data, np.concatenate(([0], end))[ends])


def _strings(texts: pa.Array) -> pa.Array:
    """Bytes as text; what is not UTF-8 is replaced."""
    try:
        return texts.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())


def _of_worker(name: str, key: tuple, make):
    """An object that a worker process keeps from task to task; one of each name."""
    import sys
    import types

    kept = sys.modules.setdefault("_tallyglass_kept", types.ModuleType("_tallyglass_kept"))
    found = getattr(kept, name, None)
    if found is None or found[0] != key:
        found = (key, make())
        setattr(kept, name, found)
    return found[1]


def _key(ranks: dict[bytes, int], *more) -> tuple:
    """What tells tokenizers apart within a worker."""
    import hashlib

    listed = b"".join(len(t).to_bytes(4, "little") + t + r.to_bytes(4, "little")
                      for t, r in ranks.items())
    return (hashlib.sha256(listed).hexdigest(), *more)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: tuple = ("doc_id",),
           text: str = "text", cuts: str | None = None,
           one_piece: str | None = None) -> DataFrame:
    """The kept columns and token_ids, binary: the ids as little-endian unsigned 32-bit integers.

    One row per row of docs. A null or empty text has no ids. Text that looks like a special token
    is ordinary text. A column of docs called token_ids is replaced.

    cuts may name, as a regular expression, single spaces before which the pattern is known always
    to begin a piece; stretches between them are then looked up whole. one_piece may name stretches that are known to be
    one piece with the space before them. Neither changes a result.
    """
    return _run(docs, ranks, pattern, keep, text, cuts, one_piece, ("token_ids",))


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: tuple = ("doc_id",),
               text: str = "text", cuts: str | None = None,
               one_piece: str | None = None) -> DataFrame:
    """The kept columns, token_ids as `encode` gives them, and decoded as `decode` gives them of these,
    in one pass of the texts through Python. Columns of docs called so are replaced."""
    return _run(docs, ranks, pattern, keep, text, cuts, one_piece, ("token_ids", "decoded"))


def _run(docs, ranks, pattern, keep, text, cuts, one_piece, made) -> DataFrame:
    spark = docs.sparkSession
    prepare(spark)
    key = _key(ranks, pattern, cuts, one_piece)
    shared = spark.sparkContext.broadcast(ranks)
    keep = [c for c in keep if c not in made]

    def rows(batches):
        encoder = _of_worker("encoder", key, lambda: Encoder(
            shared.value, pattern, cuts, one_piece))
        decoder = _of_worker("decoder", key[:1], lambda: Decoder(shared.value)) \
            if "decoded" in made else None
        for batch in batches:
            ids, ends = encoder.packed(_strings(batch.column(batch.num_columns - 1)))
            out = [_binary(ids.tobytes(), 4 * ends)]
            if decoder is not None:
                out.append(decoder.texts(ids, ends))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], [*keep, *made])

    source = docs.select(*keep, whole_text(text).alias("__bytes"))
    schema = source.drop("__bytes").withColumns({c: F.lit(b"") for c in made}).schema
    return source.mapInArrow(rows, schema)


def concat(parts: list[bytes]) -> bytes:
    """Decoded parts joined up the tree, neighbour by neighbour."""
    while len(parts) > 1:
        parts = [b"".join(parts[i:i + 2]) for i in range(0, len(parts), 2)]
    return parts[0] if parts else b""


def decode(encoded: DataFrame, ranks: dict[bytes, int], keep: tuple = ("doc_id",),
           ids: str = "token_ids") -> DataFrame:
    """The kept columns and decoded, binary: the bytes of the ids; null ids give no bytes."""
    spark = encoded.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(ranks)
    keep = [c for c in keep if c != "decoded"]

    key = _key(ranks)

    def rows(batches):
        import numpy as np

        decoder = _of_worker("decoder", key, lambda: Decoder(shared.value))
        for batch in batches:
            packed = batch.column(batch.num_columns - 1).to_pylist()
            ids = np.frombuffer(b"".join(packed), "<u4")
            ends = np.cumsum([len(x) // 4 for x in packed], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], decoder.texts(ids, ends)], [*keep, "decoded"])

    source = encoded.select(*keep, F.coalesce(F.col(ids), F.lit(b"")).alias("__ids"))
    schema = source.drop("__ids").withColumn("decoded", F.lit(b"")).schema
    return source.mapInArrow(rows, schema)
