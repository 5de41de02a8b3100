"""Operators on one text at a time, against plain Python."""

from __future__ import annotations

import datetime
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallyglass.llm import bpe, contamination, pii, secrets, toxicity
from tallyglass.llm.queries import CUTS, ONE_PIECE, tokenizer


@pytest.fixture(scope="module")
def ranks(spark):
    return tokenizer(spark)[0]


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


def test_bpe_matches_the_library(spark, odd, none, ranks, library):
    got = bpe.encode(odd, ranks, public_tokenizers.PATTERN, cuts=CUTS)
    assert bpe.decode(bpe.encode(none, ranks, public_tokenizers.PATTERN), ranks).count() == 0
    rows = bpe.decode(got, ranks, keep=("doc_id", "token_ids")).collect()
    texts = [r.text or "" for r in odd.collect()]
    assert sorted(bytes(r.token_ids) for r in rows) == sorted(
        np.array(library.encode_ordinary(t), "<u4").tobytes() for t in texts)
    assert sorted(bytes(r.decoded) for r in rows) == sorted(t.encode() for t in texts)


@pytest.fixture(scope="module")
def encoders(ranks):
    return [bpe.Encoder(ranks, public_tokenizers.PATTERN, *given)
            for given in ((CUTS, ONE_PIECE), (CUTS,), (None,))]


def ids_of(encoder, texts):
    ids, ends = encoder.packed(pa.array(texts, pa.string()))
    return [part.tolist() for part in np.split(ids, ends[:-1])] if texts else []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abe tion\n \t\x1c\x85\u3000\xa0\u2003'!.9éß", max_size=120), max_size=4))
def test_bpe_cuts_and_joins(encoders, library, texts):
    for encoder in encoders:
        assert ids_of(encoder, texts) == [library.encode_ordinary(t) for t in texts]


def test_bpe_merges_short_pieces_together(ranks):
    rng = random.Random(3)
    pieces = [bytes(rng.choice(b"abtheion \xc3\xa9zQ") for _ in range(rng.randint(1, bpe.LEAF)))
              for _ in range(3000)] + [b"a", b"\xff"]
    flat, many = bpe.Leaves(ranks).merged(
        np.frombuffer(b"".join(pieces), np.uint8), np.array(list(map(len, pieces))))
    want = [[ranks[t] for t in bpe.merge(p, ranks)] for p in pieces]
    assert many.tolist() == [len(w) for w in want]
    assert flat.tolist() == [i for w in want for i in w]


def test_bpe_forgets_the_oldest_and_changes_nothing(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 20)
    encoder, rng = bpe.Encoder(ranks, public_tokenizers.PATTERN, CUTS), random.Random(4)
    for _ in range(30):
        texts = [" ".join(f"word{rng.randrange(60)}" for _ in range(9)) for _ in range(3)] + [
            "first " + "x" * 90]
        assert ids_of(encoder, texts) == [library.encode_ordinary(t) for t in texts]
        assert len(encoder.known) <= 60 and len(encoder.old) <= 60


def test_bpe_round_trip_is_encode_and_decode(spark, odd, none, ranks):
    want = bpe.decode(bpe.encode(odd, ranks, public_tokenizers.PATTERN, cuts=CUTS), ranks,
                      keep=("doc_id", "token_ids"))
    got = bpe.round_trip(odd, ranks, public_tokenizers.PATTERN, cuts=CUTS, one_piece=ONE_PIECE)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert bpe.round_trip(none, ranks, public_tokenizers.PATTERN).count() == 0
    empty = bpe.decode(odd.selectExpr("doc_id", "cast(null as binary) as token_ids"), ranks)
    assert {bytes(r.decoded) for r in empty.collect()} == {b""}


def test_bpe_tree_reduction_of_long_pieces(ranks):
    rng = random.Random(1)
    for _ in range(60):
        piece = bytes(rng.choice(b"abtheion ") for _ in range(rng.randint(1, 300)))
        assert bpe.encode_piece(piece, ranks) == bpe.merge(piece, ranks)


KINDS = [("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
          r"([A-Za-z0-9+/_.=-]+)", 1, 12), ("access", "AKIA[A-Z0-9]+", 0, 18),
         ("hex", "[0-9a-f]+", 0, 16)]


def base_spans(text):
    found = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        found += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}")
                  for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return ",".join(s for *_, s in sorted(found))


def secret_texts():
    rng = random.Random(2)
    parts = ["token=", "Secret: \"", "API_KEY = '", "passwd=", "AKIA", "ABCDEFGH12345678", "é",
             "0123456789abcdef", "deadbeef", " ", "\n", "=", "\"", "short", "日本", "passwordx"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(300)] + [
        "token=secret:abcdefghijklmnop", "x " + "0123456789abcdef " * 3000]


def test_secret_spans(spark, odd, none):
    texts = secret_texts()
    df = spark.createDataFrame(
        [(i, t, f"o{i % 2}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    rows = secrets.scan(df).select("doc_id", secrets.listed(F.col("base")).alias("b")).collect()
    assert {r.doc_id: r.b for r in rows} == {i: base_spans(t) for i, t in enumerate(texts)}
    assert secrets.scan(odd).count() == odd.count()
    assert secrets.scan(none).count() == 0


def test_secrets_shared_by_owners_stay(spark):
    shared, own = "a" * 8 + "0" * 8, "b" * 8 + "1" * 8
    rows = [(i, f"x {shared} y", f"owner{i}") for i in range(4)] + [(9, f"key {own} z", "me")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = secrets.scan(df)
    text = {r.doc_id: r.t for r in secrets.redact(out).selectExpr("doc_id", "__text as t").collect()}
    assert text[9] == f"key {secrets.MARK} z"
    assert all(text[i] == f"x {shared} y" for i in range(4))
    opaque = "Zk3" * 8
    more = spark.createDataFrame([(i, opaque, f"o{i}") for i in range(3)] + [(7, opaque[1:], "o")],
                                 "doc_id long, text string, source string")
    spans = {r.doc_id: len(r.spans) for r in secrets.scan(more).collect()}
    assert spans == {0: 0, 1: 0, 2: 0, 7: 1}


@pytest.mark.parametrize("hot", [2, secrets.HOT_PLACES])
def test_secrets_need_owners_and_repositories(spark, hot, monkeypatch):
    """A value of many owners in one repository is a fork's; one of a third of all rows is like any."""
    monkeypatch.setattr(secrets, "HOT_PLACES", hot)
    fork, example, own = "c" * 8 + "2" * 8, "d" * 8 + "3" * 8, "e" * 8 + "4" * 8
    rows = [(i, f"x {fork} y", f"owner{i}", "same") for i in range(4)]
    rows += [(10 + i, f"x {example} y {own}", f"owner{i % 5}", f"repo{i}") for i in range(40)]
    rows += [(90, f"z {own}", None, None), (91, f"z {example}", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, repo string")
    out = secrets.scan(df, repository="repo").checkpoint()
    live = {r.doc_id: [s.value for s in r.spans] for r in out.withColumn(
        "spans", F.filter("spans", lambda s: secrets.looks_live(s))).collect()}
    assert all(live[i] == [fork] for i in range(4))
    assert all(live[10 + i] == [] for i in range(40)) and live[90] == live[91] == []
    assert {len(r.owners) for r in out.where("doc_id between 10 and 49").collect()} == {2}
    few = secrets.scan(df.where("doc_id in (10, 11, 90)"), repository="repo")
    assert {len(r.spans) for r in few.withColumn("spans", F.filter(
        "spans", lambda s: secrets.looks_live(s))).where("doc_id < 90").collect()} == {2}


def pem(seed, label="RSA ", lines=20, end=True, head="", br="\n"):
    rng = random.Random(seed)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    body = ["".join(rng.choice(alphabet) for _ in range(64)) for _ in range(lines)] + ["q7+/Zw=="]
    return br.join([f"-----BEGIN {label}PRIVATE KEY-----", *([head, ""] if head else []), *body,
                    *([f"-----END {label}PRIVATE KEY-----"] if end else [])])


def test_private_keys_are_told_apart_and_taken_whole(spark):
    encrypted = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-256-CBC,0123456789abcdef0123456789abcdef"
    keys = [pem(0), pem(1), pem(2), pem(3, "", end=False), pem(4, head=encrypted),
            pem(5, "EC ", br="\\n"), pem(6, head=encrypted, end=False),
            pem(7, lines=6000), pem(8, lines=6000, end=False), pem(9, end=False, br=" ")]
    rows = [(i, f"before\n{k}\nafter it", f"owner{i}") for i, k in enumerate(keys)]
    example = pem(10)
    rows += [(100 + i, f"x {k} y", f"owner{i}") for i, k in enumerate(
        [example, example.replace("\n", "\r\n"), example.replace("\n", "\\n")])]
    rows += [(200, f"{pem(0)} and {example}", "owner0"), (201, "-" * 5 + "BEGIN PRIVATE KEY" + "-" * 5
                                                           + " heads a file of words", "owner1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = secrets.scan(df)
    got = {r.doc_id: r for r in secrets.redact(out).select("doc_id", "spans", "__text").collect()}
    for i, key in enumerate(keys):
        assert got[i]["__text"] == f"before\n{secrets.MARK}\nafter it", i
        assert [(s.start, s.stop) for s in got[i].spans if s.kind == "pem"] == [(7, 7 + len(key))]
        assert not any(s.kind == "opaque" for s in got[i].spans)
    for i in range(3):
        assert got[100 + i]["__text"] == rows[len(keys) + i][1] and not got[100 + i].spans
    assert got[200]["__text"] == f"{secrets.MARK} and {example}"
    assert got[201]["__text"] == f"{secrets.MARK} heads a file of words"


def luhn_ok(digits):
    odd = [int(d) for d in digits[::-1]]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(odd)) % 10 == 0


def test_pseudonyms_keep_formats(spark, odd, none):
    text = ("mail a.b@site.example and a.b@site.example, card 4111 1111 1111 1111 or "
            "4111111111111111, not 4111111111111112, IBAN DE89 3704 0044 0532 0130 00, "
            "ssn 123-45-6789 not 000-45-6789, tel +1 (212) 555-0100, ip 10.0.0.255 not 10.0.0.256, "
            "born 1999-12-31 not 1999-13-31, 31.12.1999, 12/31/1999.")
    df = spark.createDataFrame([(1, text), (2, text), (3, "clean text 12 345")],
                               "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.pseudonymize(df, "key").collect()}
    new = rows[1].text
    assert new == rows[2].text and rows[3].text == "clean text 12 345"
    assert (rows[1].n_email, rows[1].n_card, rows[1].n_iban, rows[1].n_ssn, rows[1].n_phone,
            rows[1].n_ip, rows[1].n_date) == (2, 2, 1, 1, 1, 1, 3)
    for kept in ("4111111111111112", "000-45-6789", "10.0.0.256", "1999-13-31"):
        assert kept in new
    for gone in ("a.b@site", "4111 1111 1111 1111", "4111111111111111,", "0532", "123-45-6789",
                 "555-0100", "10.0.0.255 ", "1999-12-31", "31.12.1999", "12/31/1999"):
        assert gone not in new
    spaced, plain = re.search(r"card ((?:\d{4} ){3}\d{4}) or (\d{16})", new).groups()
    assert spaced.replace(" ", "") == plain and luhn_ok(plain)
    iban = re.search(r"IBAN (DE[\d ]{25})", new)[1].replace(" ", "")
    assert int(iban[4:] + "1314" + iban[2:4]) % 97 == 1
    iso, dotted, slashed = re.search(
        r"born (\S+) not \S+ (\d\d\.\d\d\.\d{4}), (\d\d/\d\d/\d{4})", new).groups()
    day = datetime.date.fromisoformat(iso)
    assert dotted == day.strftime("%d.%m.%Y") and slashed == day.strftime("%m/%d/%Y")
    assert pii.pseudonymize(odd, "key").count() == odd.count()
    assert pii.pseudonymize(none, "key").count() == 0
    assert pii.pseudonymize(df, "other").where("doc_id = 1").first().text != new


def test_feistel_is_a_permutation(spark):
    df = spark.range(91 * 53)
    out = df.select(pii.feistel(df.id, 91, 53, "k", "x").alias("y"))
    assert sorted(r.y for r in out.collect()) == list(range(91 * 53))


def edit_truth(items, text):
    words = contamination.words_of(text)
    number = {w: i + 1 for i, w in enumerate(dict.fromkeys(words))}
    ids = np.array([number[w] for w in words], np.int64)
    out = []
    for name, item in items:
        seq = contamination.words_of(item)
        own = np.array([number.get(w, -1 - k) for k, w in enumerate(seq)])
        if len(seq) >= contamination.LEAST_WORDS and len(ids) and contamination.distance(
                own, ids) <= contamination.edits(len(seq), contamination.SIMILARITY):
            out.append(name)
    return sorted(out)


def test_contamination_against_all_pairs(spark, odd, none):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]

    def words(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    items = [(i, words(rng.randint(5, 50))) for i in range(30)]
    texts = []
    for _ in range(60):
        text = words(rng.randint(0, 80))
        if rng.random() < .7:
            passage = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, len(passage) // 4)):
                p = rng.randrange(len(passage))
                passage[p:p + rng.randint(0, 1)] = words(rng.randint(0, 1))
            at = rng.randint(0, len(text))
            text[at:at] = [w.upper() + "!!" for w in passage]
        texts.append(" ".join(text))
    bench = [(i, " ".join(w)) for i, w in items]
    truth = [edit_truth(bench, t) for t in texts]
    got = [sorted({i for i, _ in f}) for f in contamination.Items(bench, .8).find(texts)]
    assert all(set(g) <= set(t) for g, t in zip(got, truth, strict=True))
    assert sum(map(len, got)) >= .95 * sum(map(len, truth)) > 20
    exact = spark.createDataFrame([(1, bench[0][1]), (2, bench[0][1]), (3, None), (None, "a b c d"),
                                   (4, "")], "item_id long, text string")
    more = odd.select("doc_id", "text").union(spark.createDataFrame(
        [(99, "before " + bench[0][1].title() + " after")], "doc_id long, text string"))
    rows = contamination.contaminated(more, exact).collect()
    assert {r.doc_id: [x["item"] for x in r.found] for r in rows if r.found} == {99: [1]}
    assert len(rows) == more.count()
    assert contamination.contaminated(none, exact).count() == 0
    assert contamination.contaminated(odd, exact.limit(0)).count() == odd.count()


def test_contamination_recall():
    assert contamination.recall(.1) == 1.0 and contamination.recall(.2) >= .9


def test_toxicity(spark, odd, none):
    rng = random.Random(5)
    plain = [f"plain{i}" for i in range(40)]
    rows = []
    for i in range(400):
        text = [rng.choice(plain) for _ in range(rng.randint(20, 80))]
        if i % 4 == 0:
            text[rng.randrange(len(text))] = rng.choice(["vile", "nasty"])
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.where("doc_id < 300").select("doc_id", "toxic").union(spark.createDataFrame(
        [(None, 1), (1, None), (2, 7)], "doc_id long, toxic int"))
    model = toxicity.fit(df, labels)
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    hits = sum((got[i] >= .5) == (i % 4 == 0) for i in range(300, 400))
    assert hits >= 97
    scores = toxicity.score(odd, model).collect()
    assert len(scores) == odd.count() and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.score(none, model).count() == 0
    empty = toxicity.fit(df, labels.limit(0))
    assert toxicity.score(df, empty).where("score between 0 and 1").count() == 400


def test_toxicity_reads_whole_training_documents(spark):
    rng = random.Random(6)
    lines = [" ".join(f"plain{rng.randrange(400)}" for _ in range(n)) for n in (0, 5, 900, 1700)]
    lines[3] = lines[3][:4000] + " vile " + lines[3][4000:]
    sample = toxicity.Sample((i % 2, x.encode()) for i, x in enumerate(lines))
    got = [[sample.words[k] for k, m in zip(ids, mask, strict=True) if m] for ids, mask in zip(
        *(x.tolist() for x in sample.windows(np.arange(sample.first[-1]))), strict=True)]
    assert got == [x.encode().split()[a:a + toxicity.WINDOW] for x in lines
                   for a in toxicity.window_starts(len(x.split()))]
    df = spark.createDataFrame([(i, x, i % 2) for i, x in enumerate(lines)],
                               "doc_id long, text string, label int")
    rows = toxicity.sample(df.drop("label"), df.select("doc_id", "label")).collect()
    assert sorted(bytes(r[1]) for r in rows) == sorted(x.encode() for x in lines)


def test_toxicity_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    words = [b"ab", b"", b"longer", b"x", "é".encode(), b"ab cd".replace(b" ", b"")]
    vocabulary = {b"ab": 1, b"x": 2}
    p = toxicity.parameters(3, seed=1)
    p = {k: v + rng.normal(0, .3, v.shape) for k, v in p.items()}
    ids = rng.integers(0, len(words), (4, 7))
    mask = (np.arange(7) < np.array([7, 3, 1, 5])[:, None]).astype(float)
    label = np.array([1.0, 0, 0, 1])
    part = toxicity.Words(words, vocabulary)

    def loss(q):
        s = toxicity.forward(q, toxicity.gates(q, part.inputs(q)), ids, mask)
        return -(label * np.log(s) + (1 - label) * np.log(1 - s)).sum()

    keep, x = {}, part.inputs(p)
    score = toxicity.forward(p, toxicity.gates(p, x), ids, mask, keep)
    g, rows = toxicity.backward(p, ids, mask, keep, score - label)
    g |= toxicity.input_gradients(p, part, x, ids, rows, g)
    assert g.keys() == p.keys()
    for name, value in p.items():
        places = [tuple(rng.integers(0, n) for n in value.shape) for _ in range(6)]
        if name == "char":
            places += [(int(k), 2) for k in part.gram[:6]]
        for at in places:
            high, low = ({k: v.copy() for k, v in p.items()} for _ in range(2))
            high[name][at] += 1e-6
            low[name][at] -= 1e-6
            slope = (loss(high) - loss(low)) / 2e-6
            assert g[name][at] == pytest.approx(slope, abs=1e-5, rel=1e-4), (name, at)


def test_toxicity_learns_rare_vocabularies_too():
    """Three vocabularies with marks of their own; the rarer ones have few documents of label 1."""
    rng = random.Random(2)

    def document(kind, toxic):
        words = [f"{kind}{rng.randrange(900):03d}" for _ in range(rng.randint(30, 120))]
        for _ in range(3 * toxic):
            words[rng.randrange(len(words))] = f"{kind}zzq{rng.randrange(12)}"
        return int(toxic), " ".join(words).encode()

    def table(n):
        return [document(kind, i % every == 0) for kind, share, every in
                (("alp", 1.0, 5), ("bet", .3, 8), ("gam", .2, 8)) for i in range(int(n * share))]

    rows = table(700)
    rng.shuffle(rows)
    model = toxicity.train(rows)
    tested = table(240)
    scores = toxicity.score_texts([t for _, t in tested], model) >= .5
    for kind in (b"alp", b"bet", b"gam"):
        hits = [s for s, (y, t) in zip(scores, tested, strict=True) if y and t.startswith(kind)]
        false = [s for s, (y, t) in zip(scores, tested, strict=True) if not y and t.startswith(kind)]
        assert np.mean(hits) >= .8 and np.mean(false) <= .1, kind


def test_toxicity_sample_takes_as_many_of_either_label(spark):
    docs = spark.range(500).selectExpr("id as doc_id", "concat('text ', id) as text")
    labels = docs.where("doc_id >= 20").selectExpr("doc_id", "int(doc_id % 10 = 0) as label").unionByName(
        spark.createDataFrame([(999, 1), (20, 0)], "doc_id long, label int"))
    for size, ones in ((40, 20), (300, 48)):
        rows = toxicity.sample(docs.union(docs.limit(5)), labels, size).collect()
        assert len(rows) == size and sum(r.label for r in rows) == ones
    assert len(toxicity.sample(docs, labels, 4000).collect()) == 480


def test_toxicity_scores_are_those_of_the_network_and_words_are_read_once(monkeypatch):
    """Blocks of few words, texts longer than these, marks, empty texts: the pieces of a word are looked
    up once for all blocks and batches, and scores are those of `forward` over all windows."""
    rng = random.Random(8)
    many = [f"{rng.choice(['', '(', '--'])}W{rng.randrange(300)}{rng.choice(['', ',', ' -- ', '.)'])}"
            for _ in range(6000)]
    texts = [" ".join(rng.choices(many, k=n)).encode() for n in (0, 1, 16, 17, 33, 90, 700, 2900, 31)]
    texts += [b" ... ", b"", texts[5]]
    vocabulary = {f"w{i}".encode(): i + 1 for i in range(0, 200)}
    p = {k: v.astype(np.float32) for k, v in toxicity.parameters(201, seed=4).items()}
    model = {"p": p, "vocabulary": vocabulary}
    want = []
    for text in texts:
        words = toxicity.words_of(text)
        windows = [words[a:a + toxicity.WINDOW] for a in toxicity.window_starts(len(words))]
        known = sorted({b"", *words})
        ids, mask = np.zeros((2, len(windows), toxicity.WINDOW), int)
        for i, w in enumerate(windows):
            ids[i, :len(w)], mask[i, :len(w)] = [known.index(x) for x in w], 1
        x = toxicity.Words(known, vocabulary).inputs(p)
        want.append(toxicity.forward(p, toxicity.gates(p, x), ids, mask.astype(np.float32)).max())
    assert len(set(want)) >= 8
    asked, plain = [], toxicity.Words

    def counted(words, known):
        asked.extend(words)
        return plain(words, known)

    monkeypatch.setattr(toxicity, "Words", counted)
    monkeypatch.setattr(toxicity, "BLOCK_WORDS", 640)
    assert toxicity.score_texts(texts, model) == pytest.approx(want, abs=1e-6)
    distinct = {b"", *(w for text in texts for w in toxicity.words_of(text))}
    assert sorted(asked) == sorted(distinct)
    met, before = toxicity.Met(model), len(asked)
    for text, score in zip(texts, want, strict=True):
        assert toxicity.score_texts([text], model, met) == pytest.approx([score], abs=1e-6)
    assert len(asked) - before == len(distinct)
    for name in ("MET_WORDS", "MET_BYTES"):
        monkeypatch.setattr(toxicity, name, 20)
        assert toxicity.score_texts(texts, model) == pytest.approx(want, abs=1e-6)


def test_toxicity_windows_cover_everything():
    for n in (0, 1, 16, 17, 32, 33, 100):
        seen = {k for a in toxicity.window_starts(n) for k in range(a, a + toxicity.WINDOW)}
        assert set(range(n)) <= seen
