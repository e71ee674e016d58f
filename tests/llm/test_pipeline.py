"""The corpus pipeline at the smallest scale."""

from __future__ import annotations

import hashlib
import math
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from panelloom.llm import bytetext, langid, packing
from panelloom.llm.common import Stash, table

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    docs, stash = table(spark, SF, "documents"), Stash(spark, "test")
    columns, before = docs.columns, {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stash.put(stage(spark, docs, SF))
        now = {r["doc_id"] for r in docs.collect()}
        assert now and now <= before, name
        before = now
        if name != "packing":
            assert docs.columns == columns
    assert {"doc_id", "start", "ids", "sequence_id", "offset"} <= set(docs.columns)


@pytest.mark.parametrize(("langs", "least"), [(1, 1.0), (2, 0.6), (4, 0.4), (50, 0.216)])
def test_least_score_is_above_a_guess(langs, least):
    assert corpus_pipeline.least_score({"langs": ["x"] * langs}) == pytest.approx(least) and corpus_pipeline.least_score({"langs": ["x"] * langs}) <= 1


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, n_words string, target string, lang_pred string, copies string"


def _odd():
    """Nulls, empties, repeated rows and a very long text, with columns named like what the stages work out."""
    body = lambda k, n=80: " ".join(f"{'abcdefghij'[k % 10]}{'klmnopqrst'[j % 10]}{'uvwxyzabcd'[j // 10 % 10]}o" for j in range(n))
    texts = [None, "", " \n", "12 34", body(1), body(1), body(2, 20_000), body(3), body(4), body(5)]
    rows = [(k, t, "en" if k % 2 else None, None if k == 7 else "s", len(t or ""), "a", "b", "c", "d", "e", "f") for k, t in enumerate(texts)]
    return [*rows, rows[8], (None, body(6), "en", "s", 9, *"abcdef")]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    df = spark.createDataFrame(_odd(), COLUMNS)
    made = stage(spark, df, SF)
    rows = made.collect()
    assert rows and stage(spark, df.limit(0), SF).count() == 0
    if name != "packing":
        assert made.columns == df.columns and all([r[c] for c in ("size", "score", "n_words", "target", "lang_pred", "copies")] == list("abcdef") for r in rows)
    assert {r["doc_id"] for r in rows} <= {None, *range(10)}


def test_run_is_its_stages(spark, tmp_path):
    """run() over a table gives what the stages do one after the other, and whole documents' tokens."""
    spark.createDataFrame([r[:5] for r in _odd()], COLUMNS.split(", size")[0]).write.parquet(f"{tmp_path}/documents.parquet")
    docs, stash = table(spark, str(tmp_path), "documents"), Stash(spark, "test")
    for _, stage in corpus_pipeline.STAGES:
        docs = stash.put(stage(spark, docs, str(tmp_path)))
    key = lambda df: sorted((r["doc_id"] or -1, r["start"], r["length"], bytes(r["ids"])) for r in df.collect())
    assert key(corpus_pipeline.run(spark, str(tmp_path))) == key(docs)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _quality(docs: list[tuple]) -> list[tuple]:
    """(doc_id, text, source) that pass the rules, without frequent lines."""
    norm = lambda x: re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", x.lower())).strip(" ")
    lines = {(i, s): [(k, norm(x)) for k, x in enumerate(t.split("\n")) if WORD.search(x)] for i, t, s in docs}
    having, size = defaultdict(set), Counter()
    for i, t, s in docs:
        size[s] += any(WORD.search(x) for x in t.split("\n"))
        for _, x in lines[i, s]:
            having[s, x].add(i)
    often = {}
    for (s, x), held in having.items():
        if len(held) > min(100, max(3, 0.05 * size[s])):
            often[s, x] = min(held)
    kept = []
    for i, t, s in docs:
        w = WORD.findall(t)
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeated = {k + d for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for d in range(3)}
        gone = {k for k, x in lines[i, s] if often.get((s, x), i) != i}
        removed = sum(len(x.split(" ")) for k, x in lines[i, s] if k in gone)
        if len(w) >= 50 and 2 * len(repeated) <= len(w) and len(w) - removed >= 0.5 * len(w):
            kept.append((i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone), s))
    return kept


def _mixed(docs: list[tuple]) -> Counter:
    """Copies by doc_id."""
    size = {i: len(WORD.findall(t)) for i, t, _ in docs}
    sources = sorted({s for *_, s in docs}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    own = {s: sum(size[i] for i, _, x in docs if x == s) for s in sources}
    target, left, open_ = {}, sum(own.values()), set(sources)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * own[s]}
        for s in full or open_:
            target[s] = 3 * own[s] if full else level * weight[s]
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    copies = Counter()
    for s in sources:
        whole = math.floor(min(target[s] / own[s], 3))
        lacks, before = target[s] - whole * own[s], 0
        coin = lambda i: int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:13], 16)
        for i in sorted((i for i, _, x in docs if x == s), key=coin):
            copies[i] = whole + (lacks - before >= size[i] / 2)
            before += size[i]
    return copies


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_run_against_brute_force(spark):
    """Every document's tokens in the result of run(), against plain Python of all five stages."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from tests.llm.test_operators import brute

    table_docs = table(spark, SF, "documents")
    model = langid.train(langid.training_sample(table_docs))
    docs = []
    for r in table_docs.collect():
        best, score = langid.predict(model, langid.folded(model), *bytetext.flat(pa.array([r["text"] or ""])))
        if any(c.isalpha() for c in r["text"] or "") and score[0] >= corpus_pipeline.least_score(model):
            docs.append((r["doc_id"], r["text"], r["source"]))
    docs = _quality(docs)
    component = brute({i: t for i, t, _ in docs})[1]
    docs = [d for d in docs if component[d[0]] == d[0]]
    copies, tokenizer = _mixed(docs), Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t, _ in docs if copies[i]}
    got = defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    assert set(got) == set(want)
    for i, pieces in got.items():
        places = Counter((lo + k, x) for lo, ids in pieces for k, x in enumerate(ids))
        assert places == Counter({(k, x): copies[i] for k, x in enumerate(want[i])}), i
