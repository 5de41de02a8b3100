"""All five stages over odd tables, against a plain composition of what each should do."""

from __future__ import annotations

import os
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tallyglass.llm import secrets, simhash, toxicity
from tallyglass.llm.common import prepare
from tallyglass.llm.queries import tokenizer

SECRET = "deadbeef0123456789"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score string, "
          "found int, fp string, token_ids string")


def row(doc_id, text, source="here"):
    return (doc_id, text, "en", source, None if text is None else len(text), "clash", 1, None, "x")


@pytest.fixture(scope="module")
def corpus():
    """(documents, ids of toxic ones, benchmark passages)."""
    rng = random.Random(9)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}{k % 7}" for k in range(400)]
    passages = [" ".join(rng.choice(words) for _ in range(14)) for _ in range(3)]
    rows, toxic = [], set()
    for i in range(260):
        text = [rng.choice(words) for _ in range(rng.randint(25, 60))]
        if i % 4 == 0:
            toxic.add(i)
            for _ in range(4):
                text[rng.randrange(len(text))] = rng.choice(["vileness", "nastyish", "horridly"])
        elif i % 17 == 1:
            text[10:10] = passages[i % 3].split()
        elif i % 13 == 2:
            text.insert(5, SECRET + str(i))
        rows.append(row(i, " ".join(text), f"owner{i % 5}"))
    clean = [r for r in rows if r[0] not in toxic]
    rows += [row(500 + k, r[1]) for k, r in enumerate(clean[:6])]  # copies under other ids
    rows += [clean[7], clean[7], row(None, clean[8][1]), row(None, "a text without an id"),
             row(None, "a text without an id"), row(None, None), row(600, None), row(601, ""),
             row(602, "  \n "), row(603, "word " * 9000)]
    return rows, toxic, passages


def expected(rows, toxic, passages):
    left = [r for r in rows if r[0] not in toxic]
    prints = [simhash.fingerprint((r[1] or "").encode()) & (1 << 64) - 1 for r in left]
    group = list(range(len(left)))
    for a in range(len(left)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    best = {}
    for g, r in zip(group, left, strict=True):
        key = (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")
        if g not in best or key < best[g][0]:
            best[g] = (key, r)
    kept = [r for _, r in best.values() if not any(p in (r[1] or "") for p in passages)]
    out = []
    for doc_id, text, lang, source, n_chars, *_ in kept:
        if text is not None and SECRET in text:
            text = " ".join(secrets.MARK if w.startswith(SECRET) else w for w in text.split(" "))
            n_chars = len(text)
        out.append((doc_id, text, lang, source, n_chars))
    return sorted(out, key=str)


def write(spark, folder, rows, labels, passages):
    for name, data, schema in (
            ("documents", rows, SCHEMA), ("labels", labels, "doc_id long, quality int, toxic int"),
            ("benchmark", list(enumerate(passages)), "item_id long, text string")):
        spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")


def test_pipeline_end_to_end(spark, corpus, tmp_path, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(toxicity, "STEPS", 300)
    prepare(spark)
    rows, toxic, passages = corpus
    folder = str(tmp_path / "tables")
    labels = [(i, 1, int(i in toxic)) for i in range(260)] + [(None, 1, 1), (3, None, None)]
    write(spark, folder, rows, labels, passages)
    shared = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(shared))
    got = corpus_pipeline.run(spark, folder).collect()
    ours = [d for d in set(os.listdir(shared)) - before if d.startswith("pipeline-")]
    assert [os.listdir(f"{shared}/{d}") for d in ours] == [["3"]]
    want = expected(rows, toxic, passages)
    assert sorted(((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in got), key=str) == want
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                                mergeable_ranks=tokenizer(spark)[0], special_tokens={})
    for r in got:
        ids = np.frombuffer(r.token_ids, "<u4").tolist()
        assert ids == library.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids) and r.round_trip


def test_pipeline_of_empty_tables(spark, corpus, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path / "none")
    write(spark, folder, [], [], corpus[2])
    assert corpus_pipeline.run(spark, folder).count() == 0
    folder = str(tmp_path / "unlabelled")
    write(spark, folder, corpus[0][-8:], [], [])
    assert os.path.isdir(f"{folder}/labels.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(
        (r[:2] for r in expected(corpus[0][-8:], set(), ["no such passage"])), key=str)
