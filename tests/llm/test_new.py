"""MinHash groups, lexical search and whitening, against brute force on small tables."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyglass.llm import lexical, minhash, whitening


def brute_groups(texts: dict) -> dict:
    sets = {i: minhash.shingles((t or "").encode(), 3) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            same = len(sets[a] & sets[b])
            if a < b and same and 100 * same >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


def edited(rng, words, share):
    return [rng.choice("abcdefgh") * 5 + str(rng.random()) if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def near():
    """Chains of edits, a large group of near copies, and texts that share much but not enough."""
    rng = random.Random(8)
    texts = []
    for _ in range(12):
        words = [rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(150)]
        for _ in range(8):
            texts.append(" ".join(words))
            words = edited(rng, words, rng.choice([.01, .02, .03, .06]))
    base = [str(rng.randrange(500)) for _ in range(200)]
    texts += [" ".join(edited(rng, base, .015)) for _ in range(90)]
    texts += [" ".join(base[:150] + [str(rng.random()) for _ in range(40)]) for _ in range(70)]
    texts += ["", None, "one", "One ", "two words", "TWO  words", "a b c", "a b c a b c", "É b", "é b"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return {i * 2: texts[k] for i, k in enumerate(order)}


@pytest.mark.parametrize("bucket", [3, minhash.BUCKET])
def test_minhash_groups(spark, near, bucket, odd, none):
    truth = brute_groups(near)
    docs = spark.createDataFrame(list(near.items()), "doc_id long, text string").repartition(4)
    got = minhash.near_duplicates(docs, bucket=bucket).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == truth
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    if bucket > 3:
        rows = minhash.near_duplicates(odd).collect()
        assert len(rows) == odd.count() and minhash.near_duplicates(none).count() == 0
        by_id = defaultdict(set)
        for r in rows:
            by_id[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
        assert by_id[7] == {(8, 1, False)} and by_id[6] == {(3, 5, False)}
        assert by_id[2] == {(0, 2, True)} and by_id[4] == {(0, 4, True)}
        assert by_id[None] == {(3, None, True), (0, None, True)}


def test_minhash_small_blocks_and_heavy_ends(spark, near, monkeypatch):
    """With many blocks, and with pairs dealt out, the result is the same."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 3000)
    monkeypatch.setattr(minhash, "FAN", 5)
    docs = spark.createDataFrame(list(near.items()), "doc_id long, text string")
    got = minhash.near_duplicates(docs, bucket=3).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_groups(near)


def test_minhash_blocks_connect_what_links_connect():
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 1 << 60, 200).astype(np.uint64)) for _ in range(3)]
    sets = []
    for k in range(120):
        own = base[k % 3]
        lost = rng.random(len(own)) > rng.choice([.01, .05, .1])
        sets.append(np.unique(np.concatenate((own[lost], rng.integers(0, 1 << 60, 5).astype(np.uint64)))))
    roots = [0 if k < 30 and k % 3 == 0 else k for k in range(120)]
    members = [(k, roots[k], x) for k, x in enumerate(sets)]
    edges = minhash.spanning([m for m in members if m[1]], members, 85)
    assert len(edges) < 120

    def groups(pairs):
        label = list(roots)
        for a, b in pairs:
            x, y = label[a], label[b]
            label = [min(x, y) if v in (x, y) else v for v in label]
        return label

    links = [(a, b) for a in range(120) for b in range(a) if 100 * len(np.intersect1d(
        sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))]
    got, want = groups(edges), groups(links)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_minhash_keys_meet_as_computed():
    rng, known, met = random.Random(2), minhash.Hashes(), 0
    for _ in range(400):
        words = [str(rng.random()) for _ in range(222)]
        other = words[:204] + [str(rng.random()) for _ in range(18)]  # 202 of 238 shingles: 0.849
        a, b = minhash.group_hashes([minhash.shingle_hashes(" ".join(w).encode(), 3, known)
                                     for w in (words, other)])
        half = minhash.GROUPS
        met += bool((a[:half] == b[:half]).any() and (a[half:] == b[half:]).any())
    assert met >= 399


TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, k=20):
    def terms(text):
        return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]

    tfs = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, whole = sum(bool(c) for _, c in tfs), sum(sum(c.values()) for _, c in tfs)
    df = Counter(t for _, c in tfs for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in tfs:
            n = sum(c.values())
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * (10 ** 9 * c[t] // (1000 * c[t] + 12 * (75 + 25 * n * n_docs // whole)))
                for t in terms(text) if c[t])
            if score > 0:
                scores.append((-score, d is None, d or 0))
        for rank, (score, lost, d) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, None if lost else d, -score))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [lexical.BLOCK_BYTES, 300])
def test_search(spark, odd, none, block, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    rng = random.Random(4)
    words = ["the", "The", "É", "é", "x1", "don't", "a\x00b", "日本", "re-run", "A", "zz", "_q", "\x7f9"]
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(words, k=rng.randint(0, 60))))
            for i in range(300)]
    docs += [(5, "the the zz"), (5, "the the zz"), (None, "zz é"), (None, None), (7, ""), (8, "..,")]
    items = [(i, " ".join(rng.choices(words + ["nowhere"], k=rng.randint(0, 9)))) for i in range(60)]
    items += [(70, None), (71, ""), (72, "?!"), (None, "zz")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumn(
        "score", F.lit("clash")).withColumn("term", F.lit(1))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("place", F.lit("clash"))
    got = sorted((tuple(r) for r in lexical.search(d, i).collect()), key=str)
    assert got == brute_search(docs, items)
    assert lexical.search(odd, i).where("score <= 0").count() == 0
    assert lexical.search(none, i).count() == lexical.search(d, i.limit(0)).count() == 0


def check_whitened(rows, points, most=32):
    x = np.floor(64 * np.asarray(points, float))
    v = np.cov(x.T, bias=True)
    values = np.linalg.eigvalsh(v)[::-1]
    k = int((values > 1e-9 * values[0]).sum())
    assert len(rows) == len(points) * min(k, most)
    n, s = len(points), x.sum(0)
    table = np.zeros((n, min(k, most)))
    for r in rows:
        table[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == int(((n * x[r.vec_id] - s) ** 2).sum())
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(v), rel=1e-6)
        assert r.identity_error < 1e-9
    cov = table.T @ table / n
    assert np.abs(cov - np.eye(len(cov))).max() < 1e-9
    for c in range(min(k, most)):  # projections have the eigenvector's direction
        w, e = np.linalg.eigh(v)
        own = (x - x.mean(0)) @ e[:, -1 - c] / math.sqrt(w[-1 - c])
        gap = min(np.abs(own - table[:, c]).max(), np.abs(own + table[:, c]).max())
        assert gap < 1e-5


@pytest.mark.parametrize("shape", [(300, 8), (200, 40), (30, 40)])
def test_whitening(spark, shape):
    rng = np.random.default_rng(3)
    points = rng.normal(size=shape) @ np.diag(np.linspace(3, .5, shape[1])) + 7
    rows = [(i, v.tolist()) for i, v in enumerate(points)]
    rows += [(900, None), (901, [float("nan")] * shape[1]), (902, [None] * shape[1]), (903, []),
             (904, [float("inf")] * shape[1]), (905, [1.0] * (shape[1] + 1))]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>").repartition(5).withColumn(
        "component", F.lit("clash")).withColumn("v", F.lit(1)).withColumn("n", F.lit(2))
    if shape[0] > shape[1]:
        check_whitened(whitening.whiten(df).collect(), points)
    else:
        got = whitening.whiten(df).collect()
        assert len(got) == 30 * 29 and max(r.identity_error for r in got) < 1e-8


def test_whitening_edges(spark):
    schema = "vec_id int, embedding array<double>"
    rng = np.random.default_rng(5)
    twice = [(k % 50, [float(x) for x in rng.integers(-9, 9, 3)] + [0.0]) for k in range(100)]
    rows = twice + [(None, [1.0, 2.0, 3.0, 0.0]), twice[0]]
    got = whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 102 * 3 and {r.component for r in got} == {1, 2, 3}
    assert sum(r.vec_id is None for r in got) == 3
    for few in ([], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, None)]):
        assert whitening.whiten(spark.createDataFrame(few, schema)).count() == 0
    large = [(k, [k * 1e15, -k * 1e14]) for k in range(5)]
    out = whitening.whiten(spark.createDataFrame(large, schema)).collect()
    assert all(r.deviation is None or r.vec_id == 2 for r in out)


def test_cholesky_and_jacobi_of_wide_spectra():
    rng = np.random.default_rng(9)
    q, _ = np.linalg.qr(rng.normal(size=(21, 21)))
    want = 10.0 ** -np.arange(21)[:8]
    values, axes = whitening.eigen((q[:, :8] * want) @ q[:, :8].T)
    assert values[:8] == pytest.approx(want, rel=1e-6)
    assert np.abs(np.abs(axes[:, :8].T @ q[:, :8]) - np.eye(8)).max() < 1e-6
    assert whitening.eigen(np.zeros((3, 3)))[0].size == 0
