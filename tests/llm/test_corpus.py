"""Operators over a whole corpus, against brute force on small tables."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyglass.llm import ppm, repeats, simhash, urls, vptree
from tallyglass.llm.components import connected
from tallyglass.llm.queries import ORACLES, QUERIES


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    vocabulary = ["al", "be", "cor", "Dan", "é", "fi", "go", "hu", "\u65e5"]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(3)]
    texts = []
    for _ in range(n):
        how = rng.random()
        if texts and how < .2:
            texts.append(rng.choice(texts))
        elif texts and how < .4:
            words = rng.choice(texts).split(" ")
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
        else:
            parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 90)))]
            if rng.random() < .5:
                parts.insert(rng.randint(0, 1), rng.choice(passages))
            texts.append(" ".join(parts))
    return texts + ["", "ab" * 400, "ab" * 300]


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)],
                                 "doc_id long, text string").repartition(5)


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(1)
    rest, lead = simhash.remainders(), simhash.leaders()
    assert len(set(lead.tolist())) == 2048  # the code is perfect
    words = rng.integers(0, 1 << 23, 300)
    for _ in range(20):
        errors = (1 << rng.integers(0, 23, 300)) | (1 << rng.integers(0, 23, 300))
        a, b = (simhash.fuzzy_indices(w, rest, lead) for w in (words, words ^ errors))
        assert all(set(x) & set(y) for x, y in zip(a.tolist(), b.tolist(), strict=True))


@pytest.mark.parametrize("bucket", [0, 64])
def test_links_reach_what_all_pairs_reach(spark, bucket):
    rng = np.random.default_rng(2)
    seeds = rng.integers(-1 << 63, (1 << 63) - 1, 20)
    fps = {int(s) for s in seeds}
    for s in seeds.tolist():
        for _ in range(40):
            for bit in rng.integers(0, 63, rng.integers(1, 4)).tolist():
                s ^= 1 << bit
            fps.add(int(s))
    fps = sorted(fps)
    near = [(a, b) for i, a in enumerate(fps) for b in fps[:i]
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    truth = components(fps, near)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    simhash.prepare(spark)
    got = {r.node: r.root for r in connected(simhash.links(df, bucket)).collect()}
    assert all(got.get(f, f) == r for f, r in truth.items())


def test_near_duplicates(spark, docs, texts, odd, none):
    fps = {}
    for i, text in enumerate(texts):
        words = text.encode().lower().split()
        shingles = [b" ".join(words[k:k + 3]) for k in range(max(len(words) - 2, 1))] \
            if words else []
        ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
        fps[i * 3] = sum(1 << b for b in range(64) if ones[b] * 2 > len(shingles))
    near = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    truth = components(fps, near)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert {d: int(r.fingerprint, 16) for d, r in got.items()} == fps
    assert {d: r.component_id for d, r in got.items()} == truth
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and simhash.near_duplicates(none).count() == 0
    assert {r.component_id for r in rows if r.doc_id in (1, 7)} == {1}


def test_repeats(spark, docs, texts, odd, none):
    seen, truth = set(), {}
    for i, text in enumerate(texts):
        data = text.encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 99):
            if data[k:k + 100] in seen:
                gone[k:k + 100] = b"\x01" * 100
            seen.add(data[k:k + 100])
        truth[i * 3] = bytes(b for b, g in zip(data, gone, strict=True) if not g)
    for chunk_bytes in (1 << 20, 4000):
        rows = repeats.remove_repeats(docs, chunk_bytes=chunk_bytes, part_names=500).collect()
        assert {r.doc_id: bytes(r.kept) for r in rows} == truth
        assert all(sum(s.stop - s.start for s in r.spans) + len(r.kept) == r.n_bytes for r in rows)
    rows = repeats.remove_repeats(odd).collect()
    assert len(rows) == odd.count() and repeats.remove_repeats(none).count() == 0
    left = {r.doc_id: len(r.kept) for r in rows}
    assert left[6] == 0 < left[5] and left[7] == 44  # repeated rows of one id are one document


def test_scores(spark, docs, texts, odd, none):
    held = {i * 3: zlib.crc32(str(i * 3).encode()) % 10 == 0 for i in range(len(texts))}
    count, follow, order = Counter(), defaultdict(Counter), ppm.ORDER
    lines = {i * 3: [256] * order + list(t.encode().lower()) + [256] for i, t in enumerate(texts)}
    for i, text in enumerate(texts):
        if not held[i * 3]:
            count.update([*text.encode().lower().split(), None])
            line = lines[i * 3]
            for k in range(order, len(line)):
                for n in range(order + 1):
                    follow[tuple(line[k - n:k])][line[k]] += 1
    total, kinds = sum(count.values()), len(count)

    def symbol(line, k):
        out, ruled = 0.0, set()
        for n in range(order, -1, -1):
            left = {s: c for s, c in follow[tuple(line[k - n:k])].items() if s not in ruled}
            if left:
                whole = sum(left.values()) + len(left)
                if line[k] in left:
                    return out + math.log10(left[line[k]] / whole)
                out += math.log10(len(left) / whole)
                ruled |= set(left)
        return out - math.log10(257 - len(ruled))

    for sizes in ({}, {"chunk_bytes": 5000, "part_bytes": 3000}):
        for r in ppm.score(docs, **sizes).collect():
            tokens = [*texts[r.doc_id // 3].encode().lower().split(), None]
            line = lines[r.doc_id]
            base = sum(math.log10((count[t] + .1) / (total + .1 * (kinds + 1))) for t in tokens)
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
                held[r.doc_id], len(tokens), sum(count[t] > 0 for t in tokens), total)
            assert r.base_score == pytest.approx(base, rel=1e-9)
            assert r.score == pytest.approx(
                sum(symbol(line, k) for k in range(order, len(line))), rel=1e-5)
    assert ppm.score(odd).where("score <= 0").count() == odd.count()
    assert ppm.score(none).count() == 0
    untrained = spark.createDataFrame([(30, "ab")], "doc_id long, text string")
    if zlib.crc32(b"30") % 10 == 0:
        assert ppm.score(untrained).first().score == pytest.approx(-3 * math.log10(257))


def test_scores_find_the_places_of_symbols_once(texts, monkeypatch):
    """Chunks count and place the same strings and words in blocks of any size, and look up no symbol
    one by one."""
    held = [i % 4 == 1 for i in range(len(texts))]
    lower = [t.encode().lower() for t in texts]
    chunk = ppm.Chunk(pa.table({"doc_id": range(len(texts)), "held_out": held,
                                "packed": [zlib.compress(t) for t in lower]}))
    strings, trained, words = [], Counter(), Counter()
    for text, out in zip(lower, held, strict=True):
        line = [256] * ppm.ORDER + list(text) + [256]
        own = [sum(line[k - n] << 9 * (ppm.ORDER + 1 - n) for n in range(1, ppm.ORDER + 1)) + line[k]
               for k in range(ppm.ORDER, len(line))]
        strings.append(own)
        trained.update(own if not out else [])
        words.update(text.split() if not out else [])
    every = sorted({c for own in strings for c in own})
    size, plain, asked = ppm.BLOCK, np.searchsorted, []

    def counted(a, v, *more, **named):
        asked.append(np.size(v))
        return plain(a, v, *more, **named)

    monkeypatch.setattr(np, "searchsorted", counted)
    for block in (3, 50, 1000, size):
        monkeypatch.setattr(ppm, "BLOCK", block)
        names, counts = chunk.strings()
        assert names.tolist() == every and counts.tolist() == [trained[c] for c in every]
        asked.clear()
        names, blocks = chunk.places()
        assert sum(asked) <= 2 * len(blocks) + 2 * 5 * len(texts)
        got = [[] for _ in texts]
        for text, many, at in blocks:
            for i, c in zip(np.repeat(text, many).tolist(), names[at].tolist(), strict=True):
                got[i].append(c)
        assert names.tolist() == every and got == strings
        (hashes, counts), (names, lines) = chunk.words(), chunk.word_places()
        assert hashes.tolist() == names.tolist() and counts.sum() == words.total()
        for text, line in zip(lower, lines, strict=True):
            some = text.split()
            assert len(line) == len(some)
            known = dict(zip(some, line.tolist(), strict=True))
            assert all(counts[known[w]] == words[w] for w in some)
            assert len(set(known.values())) == len(known)
    part = np.array([5, 2, 5, 0, 2])
    at, pieces = ppm.pieces(part)
    assert at.tolist() == [0, 2, 5] and [p.tolist() for p in pieces] == [[3], [1, 4], [0, 2]]


def test_nearest(spark, none):
    rng = np.random.default_rng(6)
    points = rng.normal(size=(700, 12))
    points[50:90] = points[7]
    rows = [(i, v.tolist()) for i, v in enumerate(points)] + [
        (900, None), (901, [0.0] * 12), (902, [float("nan")] * 12), (903, [None] * 12),
        (904, [float("inf")] * 12), (None, [1.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn(
        "score", F.lit(1)).withColumn("shard", F.lit("x"))
    asked = df.where("vec_id % 20 = 0")
    for factor, least in ((1.0, 1.0), (vptree.FACTOR, .9)):
        got = defaultdict(list)
        for r in sorted(vptree.nearest(df, asked, 20, factor).collect(), key=lambda r: r["rank"]):
            got[r.query_id].append(r.vec_id)
        hits = 0
        for q in range(0, 700, 20):
            score = (points * points[q]).sum(1)
            score[q] = -np.inf
            want = np.lexsort((np.arange(700), -score))[:20].tolist()
            hits += len(set(want) & set(got[q]))
            if factor == 1.0:
                assert got[q] == want
        assert hits >= least * 20 * 35
    few = df.where("vec_id in (0, 1, 2)")
    assert vptree.nearest(few, few.where("vec_id = 0")).count() == 2
    assert vptree.nearest(df.limit(0), df.limit(0)).count() == 0


def test_nearest_in_many_leaves(spark, monkeypatch):
    """Small shards, repeated query rows, mixed lengths, a vector that a third of all rows have, and
    queries in many blocks: factor one is exact."""
    for name, value in (("SHARD_ROWS", 60), ("QUERY_ROWS", 7), ("SAMPLE_ROWS", 200)):
        monkeypatch.setattr(vptree, name, value)
    rng = np.random.default_rng(8)
    points = np.concatenate([rng.normal(c, .4, (130, 6)) for c in rng.normal(0, 3, (5, 6))])
    points[100:300] = points[100]
    rows = [(i, v.tolist()) for i, v in enumerate(points)]
    odd = [(1000 + i, [1.0] * n) for i, n in enumerate((1, 5, 7, 12))] + [(20, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd + rows[:1] * 3 + rows[100:102], "vec_id long, embedding array<double>"
                               ).repartition(6).withColumn("leaf", F.lit("x")).withColumn("bound", F.lit(1))
    ids = np.array([i for i, _ in rows] + [0] * 3 + [100, 101])
    every = points[ids]
    got = defaultdict(list)
    for r in vptree.nearest(df, df.where("vec_id % 20 = 0"), 20, 1.0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 650, 20))
    for q, found in got.items():
        score = (every * points[q]).sum(1)
        score[ids == q] = -np.inf
        want = np.lexsort((ids, -score))[:20]
        found.sort()
        assert [x[0] for x in found] == list(range(1, 21))
        assert [x[1] for x in found] == ids[want].tolist()
        assert [x[2] for x in found] == pytest.approx(score[want].tolist())
    # fewer vectors are met than there are pairs of shards and queries
    assert vptree.nearest(df.where("vec_id >= 1000"), df.where("vec_id = 1000"), 20).count() == 0


def test_urls(spark):
    rows = [(1, "HTTP://WWW.Example.ORG/es/x"), (2, "http://sub.example.org/en/12?q#f"), (3, None),
            (4, "no scheme"), (5, "https://a.com/fr/"), (6, "https://com/de/"), (7, "x://a.net"),
            (8, "x://www.bad.net:443/p/index.html"), (9, "x://m.bad.net/p/"), (9, "x://m.bad.net/p/"),
            (10, "x://bad.net/q"), (None, ""), (11, "x://notexample.org#"), (12, "a\n://b.org/\nc")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("block", F.lit(1)) \
        .withColumn("verdict", F.lit("clash"))
    listed = spark.createDataFrame([("bad.net/p",), ("bad.net/p",), (None,)], "canonical string")
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"),
             ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    got = defaultdict(list)
    for r in urls.judge(pages, listed, rules).collect():
        got[r.page_id].append((r.host, r.path, r.rule, r.verdict))
    assert got[1] == [("www.example.org", "/es/x", "example.org/es/", "block")]
    assert got[2] == [("sub.example.org", "/en/12", "example.org/en/1", "block")]
    assert got[3] == got[4] == got[None] == [("", "", None, "allow")]
    assert got[5][0][2:] == ("com/fr/", "allow") and got[6][0][2:] == ("com/de/", "block")
    assert got[7] == [("a.net", "", None, "allow")]
    assert got[8][0][3] == "block" and got[9] == [("m.bad.net", "/p/", None, "block")] * 2
    assert got[10][0][3] == "allow" and got[11] == [("notexample.org", "", None, "allow")]
    assert got[12] == [("b.org", "/\nc", "org/", "allow")]
    assert urls.judge(pages, listed.limit(0), rules).where("listed").count() == 0
    assert urls.judge(pages.limit(0), listed, rules).count() == 0


def test_oracles(spark):
    import check

    con = check.duck("/root/testdata/sf0.001")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        cursor = con.execute(sql)
        columns = [d[0] for d in cursor.description]
        assert check.normal(df.columns, df.collect()) == check.normal(columns, cursor.fetchall())


def test_pipeline(spark, odd):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert out and all(r.round_trip for r in out)
    assert len({r.doc_id for r in out}) == len(out) <= len(docs)
    rows = odd.select("doc_id", "text", "lang", "source").withColumn("n_chars", F.lit(1).cast("long"))
    kept = dict(corpus_pipeline.STAGES)["simhash near-dedup"](spark, rows, sf)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 5, 8]
    assert rows.columns == kept.columns
    for name, stage in corpus_pipeline.STAGES[2:]:
        assert stage(spark, rows, sf).count() == rows.count(), name
        assert stage(spark, rows.limit(0), sf).count() == 0, name


def test_pipeline_keeps_one_row_of_each_component(spark):
    import corpus_pipeline

    one, two, three = ("the quick brown fox jumps over the lazy dog again",
                       "a wholly different sentence about rivers and stones",
                       "numbers and letters fill this third line up to its end")
    rows = [(None, "a text without an id"), (None, None), (4, ""), (None, one), (None, one),
            (None, two), (7, one), (8, two), (8, three), (8, three), (9, three), (None, "only here"),
            (None, "only here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "doc_id", "text", "'en' as lang", "'s' as source", "1L as n_chars")
    kept = dict(corpus_pipeline.STAGES)["simhash near-dedup"](spark, docs, "")
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(None, "a text without an id"), (4, ""), (7, one), (8, two), (8, three),
                          (None, "only here")], key=str)
    assert kept.columns == docs.columns
