"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text is cut into words, and into overlapping windows of words that cover all of it. A word enters
as a learned vector (for words of two or more training documents) beside the scaled sum of learned
vectors of its character pieces: three and five bytes long, its ends included, hashed into rows. Two
gated recurrent layers read a window in both directions, attention weighs their states, and a
logistic unit scores the sum. A document's score is that of its most toxic window, as one passage is
enough.

Training runs in one task, over a sample with a stated bound: SAMPLE_DOCS labelled documents, as many
of either label where there are enough, chosen by a hash of their id, each with all its windows.
The first number of a word's or piece's vector starts from how much oftener it occurs in documents of
label 1 (a log ratio of counts), all others at random; all are learned. A label belongs to a document, so a document of label 1
is represented by the window that scores highest so far, one of label 0 by that or by any other, in
turn. One document in VALIDATED takes no part in that; on those the bias is set so that a score of 0.5 parts the
labels best. Scoring runs over all windows of all documents, in blocks of bounded size.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyglass.llm.common import prepare, whole_text

SAMPLE_DOCS = 4000
COMPARED = 12  # windows spread over a document by which copies of it are known
WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM, CHAR_ROWS = 8, 8, 8, 1 << 14
PIECES = (3, 5)  # bytes
STEPS, BATCH, RATE, DECAY = 900, 64, 0.003, 0.01
UNKNOWN = 0.5  # share of words that a step knows by their pieces only
SCORED = 3  # times that all windows are scored during training
VALIDATED = 8
PRIOR = 4  # documents of both labels that are added to every count, as often as these come
MARKS = b".,;:!?\"'()[]{}*#&$%-_|<>~+=/\\"
BLOCK_WORDS = 100_000
BLOCK_WINDOWS = 2048
MET_WORDS, MET_BYTES = 1 << 17, 16 << 20  # words whose inputs a task keeps while scoring


def words_of(text: bytes) -> list[bytes]:
    """The words of a text: A-Z in lower case, marks at both ends taken off, no empty ones."""
    return [w for w in (x.strip(MARKS) for x in text.lower().split()) if w]


def window_starts(n_words: int) -> range:
    """Starts of overlapping windows that cover n words; a text without words has one window."""
    return range(0, max(n_words - WINDOW + STRIDE, 1), STRIDE)


class Words:
    """Word and piece numbers of distinct words."""

    def __init__(self, words: list[bytes], vocabulary: dict[bytes, int]):
        get = vocabulary.get
        self.word = np.array([get(w, 0) for w in words], np.int64)
        line = np.frombuffer(b"\n" + b"\n".join(words) + b"\n" * max(PIECES), np.uint8).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(size + 1) - size - 1  # the newline before each word
        grams, owners = [], []
        for n in PIECES:
            many = np.maximum(size + 3 - n, 0) * (size > 0)
            code = np.full(max(len(line) - n + 1, 0), n, np.int64)
            for k in range(n):
                code = (code * 0x9E3779B1 + line[k:k + len(code)]) & 0xFFFFFFFF
            owner = np.repeat(np.arange(len(words)), many)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + first[owner]
            mixed = code[at] * 0x85EBCA6B & 0xFFFFFFFF
            grams.append((mixed >> 16) % CHAR_ROWS)
            owners.append(owner)
        order = np.argsort(np.concatenate(owners), kind="stable")
        self.gram = np.concatenate(grams)[order].astype(np.int32)
        self.of = np.concatenate(owners)[order].astype(np.int32)
        self.scale = np.sqrt(np.maximum(np.bincount(self.of, minlength=len(words)), 1))

    def inputs(self, p: dict) -> np.ndarray:
        grams = np.zeros((len(self.word), CHAR_DIM), p["char"].dtype)
        for k in range(0, len(self.word), 1 << 14):
            first = np.searchsorted(self.of, np.arange(k, min(k + (1 << 14), len(grams)) + 1))
            if first[-1] > first[0]:
                sums = np.add.reduceat(p["char"][self.gram[first[0]:first[-1]]],
                                       np.minimum(first[:-1], first[-1] - 1) - first[0])
                sums[first[1:] == first[:-1]] = 0
                grams[k:k + (1 << 14)] = sums / self.scale[k:k + (1 << 14), None]
        return np.concatenate((p["word"][self.word], grams), axis=1).astype(p["char"].dtype)


def parameters(n_words: int, seed: int = 5) -> dict[str, np.ndarray]:
    rng, d = np.random.default_rng(seed), WORD_DIM + CHAR_DIM

    def draw(*shape):
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

    p = {"word": rng.normal(0, .1, (n_words, WORD_DIM)),
         "char": rng.normal(0, .1, (CHAR_ROWS, CHAR_DIM)),
         "attend": draw(2 * HIDDEN, HIDDEN), "query": draw(HIDDEN), "out": draw(2 * HIDDEN),
         "bias": np.array([-1.0])}
    for side in "fb":
        p |= {f"w{side}": draw(d, 3 * HIDDEN), f"u{side}": draw(HIDDEN, 3 * HIDDEN),
              f"b{side}": np.zeros(3 * HIDDEN)}
    return p


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def read_one_way(gates: np.ndarray, mask: np.ndarray, u: np.ndarray, steps, keep: list | None):
    """States (n, time, hidden) of one direction; gates (n, time, 3 hidden): inputs' part."""
    n, time, h3 = gates.shape
    h = np.zeros((n, h3 // 3), gates.dtype)
    out = np.zeros((n, time, h3 // 3), gates.dtype)
    k = h3 // 3
    for t in steps:
        own = h @ u
        zr = sigmoid(gates[:, t, :2 * k] + own[:, :2 * k])
        z, r = zr[:, :k], zr[:, k:]
        new = np.tanh(gates[:, t, 2 * k:] + r * own[:, 2 * k:])
        m = mask[:, t, None]
        after = h + m * (1 - z) * (new - h)
        if keep is not None:
            keep.append((t, h, z, r, new, own[:, 2 * k:], m))
        out[:, t] = h = after
    return out


def forward(p: dict, table: dict, ids: np.ndarray, mask: np.ndarray, keep: dict | None = None):
    """Scores of windows; ids (n, time) are rows of the tables of gates, mask is 1 at words."""
    states = []
    for side in "fb":
        steps = range(ids.shape[1]) if side == "f" else range(ids.shape[1] - 1, -1, -1)
        if keep is not None:
            keep[side] = []
        states.append(read_one_way(table[side][ids], mask, p["u" + side], steps,
                                   None if keep is None else keep[side]))
    both = np.concatenate(states, axis=2)
    return pooled_score(p, both, mask, keep)


def pooled_score(p: dict, both: np.ndarray, mask: np.ndarray, keep: dict | None) -> np.ndarray:
    """Scores from the states of both directions, by attention."""
    view = np.tanh(both @ p["attend"])
    weight = np.exp(np.minimum(view @ p["query"], 30)) * mask
    weight = weight / np.maximum(weight.sum(1, keepdims=True), 1e-9)
    pooled = (both * weight[:, :, None]).sum(1)
    if keep is not None:
        keep |= {"both": both, "view": view, "weight": weight, "pooled": pooled}
    return sigmoid(pooled @ p["out"] + p["bias"])


def backward(p: dict, ids, mask, keep: dict, wrong: np.ndarray) -> tuple[dict, dict]:
    """Gradients of parameters, and of the tables' rows at ids; wrong: score minus label."""
    g = {"bias": wrong.sum(keepdims=True), "out": keep["pooled"].T @ wrong}
    pooled, both, weight = wrong[:, None] * p["out"], keep["both"], keep["weight"]
    d_both = weight[:, :, None] * pooled[:, None, :]
    d_weight = (both * pooled[:, None, :]).sum(2)
    d_logit = weight * (d_weight - (weight * d_weight).sum(1, keepdims=True))
    g["query"] = (keep["view"] * d_logit[:, :, None]).sum((0, 1))
    d_view = d_logit[:, :, None] * p["query"] * (1 - keep["view"] ** 2)
    flat = both.reshape(-1, both.shape[2])
    g["attend"] = flat.T @ d_view.reshape(len(flat), -1)
    d_both = d_both + d_view @ p["attend"].T
    rows = {}
    for at, side in enumerate("fb"):
        u, d_state = p["u" + side], d_both[:, :, at * HIDDEN:(at + 1) * HIDDEN]
        g["u" + side] = np.zeros_like(u)
        d_gate = np.zeros((*ids.shape, 3 * HIDDEN), u.dtype)
        d_h = np.zeros((len(ids), HIDDEN), u.dtype)
        for t, h, z, r, new, own, m in reversed(keep[side]):
            d = d_h + d_state[:, t]
            d_new = m * d * (1 - z) * (1 - new ** 2)
            d_z = m * d * (h - new) * z * (1 - z)
            d_r = d_new * own * r * (1 - r)
            d_gate[:, t] = np.concatenate((d_z, d_r, d_new), axis=1)
            d_own = np.concatenate((d_z, d_r, d_new * r), axis=1)
            g["u" + side] += h.T @ d_own
            d_h = d * (1 - m * (1 - z)) + d_own @ u.T
        rows[side] = d_gate
        g["b" + side] = d_gate.sum((0, 1))
    return g, rows


def gates(p: dict, x: np.ndarray) -> dict:
    """For each direction, the inputs' part of the gates of every distinct word."""
    return {side: x @ p["w" + side] + p["b" + side] for side in "fb"}


class Met(dict):
    """Words as texts hold them, by number: marks at both ends are taken off, and 0 has no letters left.

    The inputs of each word are kept from one block of windows to the next.
    """

    def __init__(self, model: dict):
        self.model = model
        self.forget([])

    def forget(self, lines: list[np.ndarray]) -> list[np.ndarray]:
        """Start anew, with the words of some lines, which get other numbers."""
        words = [[self.words[k] for k in line] for line in lines]
        self.clear()
        self.words, self.number, self.held = [b""], {b"": 0}, 0
        self.x = np.zeros((0, WORD_DIM + CHAR_DIM), self.model["p"]["char"].dtype)
        self.filled = 0
        return [self.numbers(line) for line in words]

    def __missing__(self, text: bytes) -> int:
        word = text.strip(MARKS)
        self[text] = number = self.number.setdefault(word, len(self.words))
        if number == len(self.words):
            self.words.append(word)
        self.held += len(text)
        return number

    def numbers(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        return out[out > 0]

    def lines(self, text: bytes):
        """(numbers of words, how many windows) of the stretches of a text, of bounded size."""
        words = text.lower().split()
        if len(words) <= BLOCK_WORDS:
            line = self.numbers(words)
            yield line, len(window_starts(len(line)))
            return
        words = words_of(text)
        windows, most = len(window_starts(len(words))), BLOCK_WORDS // STRIDE
        for k in range(0, windows, most):
            n = min(most, windows - k)
            yield self.numbers(words[k * STRIDE:(k + n - 1) * STRIDE + WINDOW]), n

    def inputs(self, numbers: np.ndarray) -> np.ndarray:
        """The inputs of words; those of words met since the last call are looked up first."""
        a, b = self.filled, len(self.words)
        if a < b:
            if b > len(self.x):
                self.x = np.concatenate((self.x[:a], np.zeros((2 * b - a, self.x.shape[1]), self.x.dtype)))
            self.x[a:b] = Words(self.words[a:], self.model["vocabulary"]).inputs(self.model["p"])
            self.filled = b
        return self.x[numbers]


def read_windows(p: dict, table: dict, ids: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Scores of windows of the given lengths as by `forward`, which keeps what learning needs; ids
    (time, n) are rows of the tables of both gates and of new states."""
    time, n = ids.shape
    over = [np.flatnonzero(length <= t) for t in range(time)]
    both = np.empty((n, time, 2 * HIDDEN), p["attend"].dtype)
    for at, side in enumerate("fb"):
        (gate, fresh), h = table[side], np.zeros((n, HIDDEN), both.dtype)
        for t in range(time) if side == "f" else range(time - 1, -1, -1):
            own = h @ p["u" + side]
            zr = gate.take(ids[t], axis=0)
            zr += own[:, :2 * HIDDEN]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.divide(1, zr, out=zr)
            new = zr[:, HIDDEN:] * own[:, 2 * HIDDEN:]
            new += fresh.take(ids[t], axis=0)
            np.tanh(new, out=new)
            new -= h
            new *= 1 - zr[:, :HIDDEN]
            new[over[t]] = 0
            h += new
            both[:, t, at * HIDDEN:(at + 1) * HIDDEN] = h
    return pooled_score(p, both, (np.arange(time) < length[:, None]).astype(np.float32), None)


class Sample:
    """Labels and numbered words of training documents, and the windows over them, by number.

    A document that shares one of its compared windows with an earlier one of the same label is a
    copy, and adds nothing. Only the distinct words and four bytes of each word are held.
    """

    def __init__(self, rows):
        known: dict[bytes, int] = {b"": 0}
        met, label, lines = (set(), set()), [], []
        for y, line in rows:
            words = line.split()
            starts = window_starts(len(words))
            some = np.unique(np.linspace(0, len(starts) - 1, COMPARED).astype(int)).tolist()
            own = {b" ".join(words[starts[k]:starts[k] + WINDOW]) for k in some} - {b""}
            if met[y].isdisjoint(own):
                label.append(y)
                lines.append(np.array([known.setdefault(w, len(known)) for w in words], np.int32))
            met[y].update(own)
        self.label, self.words = np.array(label, float), list(known)
        self.ids = np.concatenate([*lines, np.zeros(1, np.int32)])
        self.begin = np.cumsum([0] + [len(x) for x in lines])
        self.first = np.cumsum([0] + [len(window_starts(len(x))) for x in lines])
        # Every eighth document of each label, as they come, is left for validation.
        self.held = np.zeros(len(label), bool)
        for y in (0, 1):
            self.held[np.flatnonzero(self.label == y)[VALIDATED - 1::VALIDATED]] = True
        own = [np.unique(x) for x, held in zip(lines, self.held, strict=True) if not held]
        self.learned = self.label[~self.held]
        self.occurs = np.zeros((2, len(self.words)))
        for y, x in zip(self.learned, own, strict=True):
            self.occurs[int(y), x] += 1
        self.repeated = sorted(self.words[k] for k in np.flatnonzero(self.occurs.sum(0) >= 2) if k)
        self.own = own

    def ratios(self, occurs: np.ndarray) -> np.ndarray:
        """How much oftener each thing occurs in documents of label 1, as a log ratio; 0 if once only."""
        docs = np.array([(self.learned == y).sum() + .5 for y in (0, 1)])[:, None]
        log = np.log((occurs + PRIOR * docs / docs.sum()) / docs)
        return np.where(occurs.sum(0) >= 2, np.clip(log[1] - log[0], -4, 4), 0)

    def start(self, p: dict, vocabulary: dict) -> None:
        """Set the first number of each word's and piece's vector from the counts of documents."""
        held = np.array([vocabulary.get(w, 0) for w in self.words])
        p["word"][held, 0] = self.ratios(self.occurs) / 4 * (held > 0)
        part = Words(self.words, {})
        ends = np.searchsorted(part.of, np.arange(len(self.words) + 1))
        occurs = np.zeros((2, CHAR_ROWS))
        for y, own in zip(self.learned, self.own, strict=True):
            width = ends[own + 1] - ends[own]
            at = np.arange(width.sum()) + np.repeat(ends[own] - np.cumsum(width) + width, width)
            occurs[int(y), np.unique(part.gram[at])] += 1
        p["char"][:, 0] = self.ratios(occurs) / 4

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers and masks of windows."""
        doc = np.searchsorted(self.first, chosen, side="right") - 1
        at = (self.begin[doc] + (chosen - self.first[doc]) * STRIDE)[:, None] + np.arange(WINDOW)
        held = at < self.begin[doc + 1][:, None]
        return np.where(held, self.ids[np.where(held, at, -1)], 0), held.astype(np.float32)

    def scored(self, score) -> np.ndarray:
        """What a function of (word numbers, mask) gives each window, in blocks."""
        out = np.zeros(self.first[-1], np.float32)
        for k in range(0, len(out), BLOCK_WINDOWS):
            ids, mask = self.windows(np.arange(k, min(k + BLOCK_WINDOWS, len(out))))
            out[k:k + BLOCK_WINDOWS] = score(ids, mask)
        return out

    def scorer(self, p: dict, vocabulary: dict):
        """The network, as a function of word numbers and mask."""
        def score(ids, mask):
            rows, small = np.unique(ids, return_inverse=True)
            small = small.reshape(ids.shape)
            table = gates(p, Words([self.words[r] for r in rows], vocabulary).inputs(p))
            return np.concatenate([forward(p, table, small[j:j + 512], mask[j:j + 512])
                                   for j in range(0, len(ids), 512)])
        return score

    def best(self, score) -> np.ndarray:
        """The number of each document's highest window."""
        scores = self.scored(score)
        return np.array([a + int(np.argmax(scores[a:b]))
                         for a, b in zip(self.first[:-1], self.first[1:], strict=True)])

    def most(self, score) -> np.ndarray:
        """The score of each document's highest window."""
        return np.maximum.reduceat(self.scored(score), self.first[:-1])


def train(rows, seed: int = 11) -> dict:
    """A model from (label, joined words) of documents; without any, one that scores all low."""
    sample = Sample(rows)
    vocabulary = {w: i + 1 for i, w in enumerate(sample.repeated)}
    p = parameters(len(vocabulary) + 1)
    label, words, first = sample.label, sample.words, sample.first
    if not len(label):
        return {"p": p, "vocabulary": vocabulary}
    sample.start(p, vocabulary)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    rng = np.random.default_rng(seed)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    docs = np.flatnonzero(~sample.held)
    # Documents of both labels come equally often.
    odds = np.where(label[docs] == 1, 1 / max((label[docs] == 1).sum(), 1),
                    1 / max((label[docs] == 0).sum(), 1))
    odds /= odds.sum()
    x = Words(words, vocabulary).inputs(p)
    hint = x[:, 0] + x[:, WORD_DIM]
    best = sample.best(lambda ids, mask: (np.maximum(hint[ids], 0) * mask).sum(1))
    for step in range(1, STEPS + 1):
        if step > 1 and (step - 1) % (STEPS // (SCORED + 1)) == 0:
            best = sample.best(sample.scorer(p, vocabulary))
        chosen = rng.choice(docs, BATCH, p=odds)
        any_ = first[chosen] + (rng.random(BATCH) * (first[chosen + 1] - first[chosen])).astype(int)
        at = np.where((label[chosen] == 1) | (rng.random(BATCH) < .5), best[chosen], any_)
        ids, m = sample.windows(at)
        rows, small = np.unique(ids, return_inverse=True)
        small = small.reshape(ids.shape)
        part = Words([words[r] for r in rows], vocabulary)
        part.word[rng.random(len(rows)) < UNKNOWN] = 0
        x, keep = part.inputs(p), {}
        score = forward(p, gates(p, x), small, m, keep)
        g, d_rows = backward(p, small, m, keep, ((score - label[chosen]) / BATCH).astype(np.float32))
        g |= input_gradients(p, part, x, small, d_rows, g)
        for name, value in p.items():
            a, b = moment[name]
            a += .1 * (g[name] - a)
            b += .001 * (g[name] ** 2 - b)
            value -= RATE * (a / (1 - .9 ** step) / (np.sqrt(b / (1 - .999 ** step)) + 1e-8)
                             + DECAY * value)
    score = sample.most(sample.scorer(p, vocabulary))
    p["bias"] = (p["bias"] - parting(score, label, sample.held)).astype(np.float32)
    return {"p": p, "vocabulary": vocabulary}


def input_gradients(p: dict, part: Words, x, ids, d_rows: dict, g: dict) -> dict:
    """Gradients of the input weights, words and pieces, from those of the gates of each position."""
    out, d_x = {}, np.zeros_like(x)
    for side in "fb":
        d_table = np.zeros((len(x), 3 * HIDDEN), x.dtype)
        np.add.at(d_table, ids.ravel(), d_rows[side].reshape(-1, 3 * HIDDEN))
        out["w" + side] = x.T @ d_table
        d_x += d_table @ p["w" + side].T
    out["word"], out["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
    np.add.at(out["word"], part.word, d_x[:, :WORD_DIM])
    np.add.at(out["char"], part.gram, (d_x[:, WORD_DIM:] / part.scale[:, None])[part.of])
    return out


def parting(scores: np.ndarray, label: np.ndarray, held: np.ndarray) -> float:
    """The log odds that part the labels best: at which most of both are on their side.

    Taken on the documents held for validation, or on all where these have one label only. Of equally
    good places the middle of the widest gap is taken.
    """
    logit = np.log(np.clip(scores, 1e-7, 1 - 1e-7) / (1 - np.clip(scores, 1e-7, 1 - 1e-7)))
    use = held if len(np.unique(label[held])) == 2 else np.ones_like(held)
    y, x = label[use], logit[use].astype(float)
    if len(np.unique(y)) < 2:
        return 0.0
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    below = np.cumsum(y == 0) / (y == 0).sum() - np.cumsum(y == 1) / (y == 1).sum()
    gap = np.diff(x)
    good = below[:-1] >= below[:-1][gap > 0].max(initial=-1) - 1e-12
    k = int(np.argmax(np.where(good, gap, -1)))
    return float((x[k] + x[k + 1]) / 2)


def score_texts(texts: list[bytes], model: dict, met: Met | None = None) -> np.ndarray:
    """The score of each text: its highest window's. Every word of every text is read.

    met: the words met in earlier calls with the same model.
    """
    p, best = model["p"], np.zeros(len(texts))
    met = Met(model) if met is None else met
    most = -(-BLOCK_WORDS // WINDOW)
    lines: list[np.ndarray] = []
    owner: list[int] = []
    many: list[int] = []

    def flush():
        size, n = np.array([len(x) for x in lines]), np.array(many)
        end = np.cumsum(size)
        own, last = np.repeat(owner, n), np.repeat(end, n)
        first = np.repeat(end - size, n) + STRIDE * (
            np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n))
        length = np.minimum(last - first, WINDOW)
        # The words of the block, as they come after the empty one.
        words, begin, line = np.unique(np.concatenate(([0], *lines)), return_index=True,
                                       return_inverse=True)
        order = np.argsort(begin)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        line = np.concatenate((place[line[1:]], np.zeros(WINDOW, np.int32)))
        table = {side: [np.ascontiguousarray(t) for t in np.split(rows, [2 * HIDDEN], axis=1)]
                 for side, rows in gates(p, met.inputs(words[order])).items()}
        steps = np.arange(WINDOW)[:, None]
        for k in range(0, len(own), 1024):
            got = read_windows(p, table, line[first[k:k + 1024] + steps], length[k:k + 1024])
            np.maximum.at(best, own[k:k + 1024], got)
        lines.clear()
        owner.clear()
        many.clear()

    for i, text in enumerate(texts):
        for line, n in met.lines(text):
            k = 0
            while k < n:
                some = min(n - k, most - sum(many))
                lines.append(line[k * STRIDE:(k + some - 1) * STRIDE + WINDOW])
                owner.append(i)
                many.append(some)
                k += some
                if sum(many) >= most:
                    flush()
            if len(met.words) > MET_WORDS or met.held > MET_BYTES:
                lines[:] = met.forget(lines)
    if lines:
        flush()
    return best


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE_DOCS) -> DataFrame:
    """(label, joined words) of at most `size` labelled documents, each whole.

    Half of them of either label, or as many more of one as the other lacks, by a hash of the id. Of
    rows with the same id the smallest text counts, and the larger of several labels.
    """
    def joined(batches):
        for batch in batches:
            lines = [b" ".join(words_of(text)) for text in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(lines, pa.binary())],
                                  ["label", "words"])

    there = labels.groupBy("doc_id").agg(F.max("label").alias("label")).join(
        docs.select("doc_id").distinct(), "doc_id", "left_semi")
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = there.withColumn("at", F.row_number().over(order)).where(F.col("at") <= size)
    rows = chosen.orderBy("at", "label").limit(size).select("doc_id", "label")
    return docs.join(F.broadcast(rows), "doc_id").groupBy("doc_id", "label").agg(
        F.min(whole_text()).alias("text")).select("label", "text").mapInArrow(
        joined, "label int, words binary")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
        label: str = "toxic", size: int = SAMPLE_DOCS) -> dict:
    """A model learned from labelled documents; labels other than 0 and 1 take no part."""
    prepare(docs.sparkSession)

    def learn(batches):
        rows = (row for batch in batches for row in zip(
            batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        yield pa.record_batch([pa.array([pickle.dumps(train(rows))])], ["model"])

    chosen = sample(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")),
        labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where(
            "label in (0, 1) and doc_id is not null"), size)
    found = chosen.repartition(1).sortWithinPartitions(F.xxhash64("words"), "words", "label").mapInArrow(
        learn, "model binary").first()
    return train([]) if found is None else pickle.loads(found.model)


def score(docs: DataFrame, model: dict, keep: tuple = ("doc_id",), text: str = "text"
          ) -> DataFrame:
    """The kept columns and score (double, 0 to 1) of every row of docs.

    Null and empty texts get the score of a window without words. Repeated rows stay; an empty table
    gives no rows. A column called score is replaced; columns not kept are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    keep = [c for c in keep if c != "score"]

    def rows(batches):
        met = Met(shared.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            got = score_texts(texts, met.model, met).astype(float)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got)],
                                             [*keep, "score"])

    source = docs.select(*keep, whole_text(text).alias("__bytes"))
    schema = source.drop("__bytes").withColumn("score", F.lit(0.0)).schema
    return source.mapInArrow(rows, schema)
