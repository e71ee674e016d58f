"""The operators against brute force, round trips, held-out accuracy and odd inputs."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelloom.llm import audit, bytetext, chat, common, components, jaccard, langid, licenses, linedup, mixing, neardup, packing, quality, registry, resample, toxicity, urlgraph
from panelloom.llm.common import Stash, is_held_out
from tests.test_queries import same

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, extra int"
ODD = [(1, None, "en", None, 1), (2, "", None, "a", 1), (3, " \n\t ", "en", "a", 1), (3, " \n\t ", "en", "a", 1), (4, "12 34 !!", "en", "a", 1), (5, "word " * 30000, "en", "a", 1), (None, "Some text here", "fr", "b", 2)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    same(df.collect(), df.columns, con.execute(registry.oracle_sql()[name]))


def test_word_hashes():
    texts = ["ab cd", "", None, "cd\x0bab  AB", "é cd", "x" * (bytetext.SLAB + 5) + " cd"]
    data, offsets = bytetext.flat(pa.array(texts))
    doc, h = bytetext.all_words(data, offsets, lower=True)
    assert doc.tolist() == [0, 0, 3, 3, 3, 4, 4, 5, 5]
    assert h[0] == h[3] == h[4] and h[1] == h[2] == h[6] == h[8] and h[5] not in (h[0], h[1])


def _thue_morse(n: int, letters: str) -> str:
    return "".join(letters[k.bit_count() % 2] for k in range(n))


def test_structured_words_have_hashes_of_their_own():
    texts = [_thue_morse(n, x) for n in (8, 64, 1024, 2048, 4096) for x in ("ab", "ba", "cd", "dc")]
    texts += ["ab" * k for k in range(1, 700)] + ["ba" * k for k in range(1, 700)] + ["a" * i + "b" + "a" * (40 - i) for i in range(40)] + ["x" * k for k in range(1, 1200)]
    for joined in ([" ".join(texts)], texts):
        _, h = bytetext.all_words(*bytetext.flat(pa.array(joined)))
        assert len(set(h.tolist())) == len(h) == len(texts)
    # One word by itself, longer than a slab, and at other places.
    long = "y" * (bytetext.SLAB + 9)
    _, h = bytetext.all_words(*bytetext.flat(pa.array([long, f"a {long}", "z" + long[1:]])))
    assert h[0] == h[2] and len(set(h.tolist())) == 3
    heads = [p for _, _, p in bytetext.words(*bytetext.flat(pa.array(["abcdef abcd abcdzz abc", "abcd"])), prefixes=(4,))][0][0]
    assert heads[0] == heads[2] != 0 and not heads[[1, 3, 4]].any()


def test_structured_words_in_sets_and_parts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [_thue_morse(n, x) for n in (1024, 2048, 4096) for x in ("ab", "ba")]
    got = jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r["component_id"] == r["doc_id"] for r in got)
    same_start = [f"a long beginning {t}" for t in texts] + [t[:8] + x for t in texts for x in ("q" * 30, "r" * 30)]
    ids, tokens = packing.Encoder(path := public_tokenizers.path(packing.TOKENIZER))(*bytetext.flat(pa.array(same_start * 2)))
    want = [x for t in same_start * 2 for x in (*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 1)]
    assert ids.tolist() == want and tokens.sum() == len(want)


def test_held_out(spark):
    rows = spark.range(50).select("id", is_held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 3), (7, 9), (5, 4)] + [(k, k + 1) for k in range(100, 160)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(edges, Stash(spark, "test")).collect()}
    assert got == {5: 3, 4: 3, 3: 3, 9: 7, 8: 7, 7: 7} | {k: 100 for k in range(100, 161)}
    assert components.components(edges.filter("a < 0"), Stash(spark, "test")).count() == 0


# 1


def test_language(spark, odd, empty):
    rng = np.random.default_rng(0)
    parts = {"en": ["the", "and", "ing", "tion"], "fr": ["é", "eau", "que", "les"], "de": ["sch", "ung", "der", "ß"]}
    make = lambda k: " ".join("".join(rng.choice(parts[k], 3)) for _ in range(60))
    docs = spark.createDataFrame([(i, make(k), k) for i in range(150) for k in [list(parts)[i % 3]]], "doc_id long, text string, lang string")
    model = langid.train(langid.training_sample(docs))
    made = langid.with_language(docs, model).filter(is_held_out("doc_id")).collect()
    assert made and all(r["lang"] == r["lang_pred"] and 0 <= r["score"] <= 1 for r in made)
    got = langid.with_language(odd, model).collect()
    assert len(got) == len(ODD) and {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3, 4)} == dict.fromkeys((1, 2, 3, 4), "und")
    assert langid.with_language(empty, model).count() == 0
    assert langid.train(langid.training_sample(empty)) is None
    assert {r["lang_pred"] for r in langid.with_language(odd, None).collect()} == {"und"}


def test_folded_tables_equal_the_network():
    rng = np.random.default_rng(1)
    p = langid.train([("a", [b"abc abd" * 9]), ("b", [b"xyz xyw" * 9])])
    data = rng.integers(32, 120, 700, dtype=np.uint8)
    best, score = langid.predict(p, langid.folded(p), data, np.array([0, 256]))
    e = p["emb"][data[:256]][None]
    pooled = np.concatenate([(langid._patches(e, k) @ p[f"w{k}"]).max(axis=1) for k in langid.WIDTHS], axis=1)
    z = (np.maximum(pooled + p["hidden"], 0) @ p["out"] + p["bias"])[0]
    assert best[0] == z.argmax() and score[0] == pytest.approx(np.exp(z.max()) / np.exp(z).sum(), rel=1e-4)


def test_windows_of_whole_texts_against_the_network():
    """Texts of several windows: the mean of the windows' logits, weighted by letters, over every byte n-gram once."""
    rng = np.random.default_rng(2)
    p = langid.train([("a", [b"abc abd" * 9]), ("b", [b"xyz xyw" * 9]), ("c", [b"lmn 123" * 9])])
    texts = [rng.integers(32, 123, n, dtype=np.uint8) for n in (0, 1, 3, 255, 256, 257, 509, 510, 2000)]
    best, score = langid.predict(p, langid.folded(p), np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]), chunk=5)
    for k, text in enumerate(texts):
        total, letters = np.zeros(3), 0
        for lo in range(0, max(1, len(text) - (langid.WINDOW - langid.STRIDE)), langid.STRIDE):
            x = np.zeros(langid.WINDOW, np.uint8)
            part = text[lo : lo + langid.WINDOW]
            x[: len(part)] = part
            e = p["emb"][x][None]
            pooled = np.concatenate([(langid._patches(e, w) @ p[f"w{w}"]).max(axis=1) for w in langid.WIDTHS], axis=1)
            weight = int(bytetext.LETTER_BYTES[x].sum())
            total += weight * (np.maximum(pooled + p["hidden"], 0) @ p["out"] + p["bias"])[0]
            letters += weight
        z = np.exp(total / max(1, letters) - (total / max(1, letters)).max())
        assert best[k] == z.argmax() and score[k] == pytest.approx(z.max() / z.sum(), rel=1e-3)


def test_language_of_many_languages(spark):
    """More languages than a cap would have: all of them are learned."""
    docs = spark.createDataFrame([(i, f"{chr(97 + i % 26)}{chr(97 + (i // 26) % 26)} " * 20, f"l{i % 300:03d}") for i in range(1500)], "doc_id long, text string, lang string")
    assert len({lang for lang, _ in langid.training_sample(docs)}) == 300


def test_quality_counts_documents_and_rejects_what_they_deplete(spark):
    """Of six copies in a host the first stays; a text that is half boilerplate stays, one that is mostly boilerplate goes."""
    words = lambda k, n: " ".join(f"{'abcdefgh'[k]}{'abcdefgh'[j % 8]}{'abcdefghij'[j // 8]}" for j in range(n))
    rows = [(k, words(0, 60), "s") for k in range(6)] + [(10 + k, "menu " + words(1, 59) + "\n" + words(2 + k, 70 if k < 5 else 20), "s") for k in range(6)]
    got = {r["doc_id"]: (r["removed_words"], r["kept"]) for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {0: (0, True)} | {k: (60, False) for k in range(1, 6)} | {10: (0, True)} | {k: (60, True) for k in range(11, 15)} | {15: (60, False)}


# 2


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(0, 1, (60, 64))
    x = np.concatenate([base, base[:30] + rng.normal(0, 0.15, (30, 64)), np.repeat(base[:1], 40, axis=0), base[1:2] * 3])
    rows = [(i, [float(v) for v in np.float32(r)]) for i, r in enumerate(x)]
    more = [(900, None), (901, []), (902, [0.0] * 64), (903, [float("nan")] * 64), (904, [1.0, None]), (905, [float("inf")] + [1.0] * 63), (906, [1.0, 2.0]), (907, [1.0, 2.0])]
    df = spark.createDataFrame(rows + more, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in neardup.near_duplicates(df).collect()}
    u = neardup.unit(np.float32(x).astype(float))
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    comp = np.arange(len(x))
    for _ in range(len(x)):
        comp = np.minimum(comp, np.where(link, comp[None], len(x)).min(axis=1))
    assert [got[i]["n_links"] for i in range(len(x))] == link.sum(axis=1).tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == comp.tolist()
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(900, 906)) and got[907]["component_id"] == 906
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def _links(got: list, x: np.ndarray) -> tuple[int, int]:
    """Links found and links there are."""
    u = neardup.unit(x)
    true = sum(int((u[i : i + 1000] @ u.T >= neardup.COSINE).sum()) for i in range(0, len(u), 1000)) - len(u)
    return sum(r["n_links"] for r in got), true


@pytest.mark.parametrize("probe", [neardup.PROBE, 0.25])
def test_recall_with_differences_that_point_at_centroids(spark, probe):
    """6,000 vectors in pairs whose differences lie along lines between clusters: all links at the default, nearly all below it."""
    rng = np.random.default_rng(7)
    centres = neardup.unit(rng.normal(0, 1, (50, 64)))
    base = neardup.unit(centres[rng.integers(0, 50, 3000)] + rng.normal(0, 0.12, (3000, 64)))
    towards = centres[rng.integers(0, 50, 3000)] - base
    x = np.float32(np.concatenate([base, base + towards * (0.29 / np.sqrt((towards**2).sum(axis=1)))[:, None]]))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found, true = _links(neardup.near_duplicates(df, probe=probe).collect(), x.astype(float))
    assert true > 3000 and (found == true if probe == 0.5 else 0.9 * true <= found <= true)


def test_vectors_with_null_and_repeated_ids(spark):
    rng = np.random.default_rng(3)
    a, b, c, d = (rng.normal(0, 1, 16) for _ in range(4))
    near = lambda v: v + rng.normal(0, 0.02, 16)
    rows = [(7, a), (7, near(a)), (8, near(a)), (8, b), (None, near(b)), (None, c), (9, d), (9, d), (None, c * 2)]
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in neardup.near_duplicates(df).collect())
    assert got == [(0, 1, 0, True), (0, 1, 0, True), (0, 1, 8, False), (7, 2, 7, True), (7, 2, 7, True), (8, 1, 8, True), (8, 2, 7, False), (9, 1, 9, True), (9, 1, 9, True)]


def test_vectors_that_share_a_hash(spark, monkeypatch):
    """Classes are told apart by their vectors where hashes are equal."""
    rng = np.random.default_rng(5)
    a, b, c = (rng.normal(0, 1, 16) for _ in range(3))
    rows = [(1, a), (2, a), (3, b), (4, c), (5, c + rng.normal(0, 0.01, 16)), (6, b), (7, rng.normal(0, 1, 16))]
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in rows], "vec_id long, embedding array<double>")
    monkeypatch.setattr(neardup.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in neardup.near_duplicates(df).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 4), (5, 1, 4), (6, 1, 3), (7, 0, 7)]


def test_groups_of_lists_pass_over_nothing_that_is_asked():
    rng = np.random.default_rng(11)
    centres = neardup.unit(rng.normal(0, 1, (30, 24)))
    x = neardup.unit(centres[rng.integers(0, 30, 2000)] + rng.normal(0, 0.05, (2000, 24)))
    m = neardup.train(x, 120)
    home, row, to = neardup.probes(m, x, 0.15)
    every = np.array([neardup._asks(m, x, home, np.full(len(x), k), 0.15) for k in range(len(m["coarse"]))]).T
    every[np.arange(len(x)), home] = False
    found = np.zeros_like(every)
    found[row, to] = True
    assert (found == every).all() and len(row) == found.sum() and len(m["middles"]) > 5
    looked = np.sqrt(neardup._squares(x, m["middles"])) - m["reach"] <= np.sqrt(((x - m["coarse"][home]) ** 2).sum(axis=1))[:, None] + 0.3
    assert looked.mean() < 0.7  # groups are passed over where vectors lie in clusters


def test_lookup_never_loses_a_partner():
    rng = np.random.default_rng(2)
    x = neardup.unit(rng.normal(0, 1, (400, 32)))
    y = neardup.unit(x + rng.normal(0, 0.03, x.shape))
    m = neardup.train(x, 8)
    home, _, _ = neardup.probes(m, x, 0.3)
    codes, error = neardup.encode(m, x, home)
    for k in range(8):
        here = np.flatnonzero(home == k)
        close = np.sqrt(((y[here][:, None] - x[here][None]) ** 2).sum(axis=2)) <= 0.3
        assert not (close & ~neardup._candidates(m, k, y[here], codes[here], error[here], 0.3).T).any()


# 3


def brute(texts: dict[int, str]) -> tuple[dict, dict]:
    sets = {}
    for i, t in texts.items():
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in texts}
    for _ in texts:
        for i in texts:
            for j in texts:
                a, b = sets[i], sets[j]
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
        if all(comp[comp[i]] == comp[i] for i in comp):
            break
    return {i: len(s) for i, s in sets.items()}, comp


def test_jaccard_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [f"p{k}" for k in range(60)]
    texts, i = {}, 0
    for size in (1, 2, 3, 4, 5, 7, 12, 30, 33, 70, 130, 300):
        base = rng.choice(vocabulary, size).tolist()
        for edits in (0, 0, 1, 2, max(1, size // 40), max(2, size // 25), size // 10):
            w = list(base)
            for k in rng.choice(size, min(size, edits), replace=False):
                w[k] = f"e{rng.integers(1e6)}"
            texts[i], i = " ".join(w), i + 1
    for k in range(40):  # a passage that many texts share, with more or less else
        texts[i], i = " ".join(passage + rng.choice(vocabulary, k).tolist()), i + 1
    texts |= {i: None, i + 1: "", i + 2: "  \n", i + 3: "The QUICK fox", i + 4: "the quick fox"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    size, comp = brute(texts)
    got = {r["doc_id"]: r for r in jaccard.near_duplicates(df).collect()}
    assert {k: r["n_shingles"] for k, r in got.items()} == size
    assert {k: r["component_id"] for k, r in got.items()} == comp
    kept = jaccard.deduplicated(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, c in comp.items() if k == c)


@pytest.mark.parametrize("hot", [0, 3])
def test_jaccard_keys_anew(spark, monkeypatch, hot):
    """Members of hot keys find their partners by seldom chunks; small blocks find what large ones do."""
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "FREQUENT", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "PAIRS", 5)
    test_jaccard_against_brute_force(spark)


def test_jaccard_labels_are_written(spark):
    """The driver holds each query's plan: what labels come from isn't in the plans that read them."""
    known = jaccard._Join(spark.createDataFrame([(k, f"a b c d e f g {k}") for k in range(4)], "doc_id long, text string"))
    known.add(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"))
    made = known.labelled(spark.createDataFrame([(3,), (9,)], "sig long"))
    assert sorted(map(tuple, made.select("sig", "component").collect())) == [(3, 1), (9, 9)]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("per_task", [50_000, 3])
def test_few_edges_take_few_tasks(spark, tmp_path, monkeypatch, per_task):
    """Components of few edges cost no task for every partition of the session; with fewer edges a task they are the same."""
    monkeypatch.setattr(common, "TASK_ROWS", per_task)
    edges = Stash(spark, "edges").put(spark.createDataFrame([(k, k + 1) for k in range(0, 8)] + [(20, 30), (30, 25)], "a long, b long").repartition(6))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    context = spark.sparkContext
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        context.setJobGroup(f"edges-{per_task}", "")
        got = dict(map(tuple, components.components(common.by_rows(edges, 10), Stash(spark, "components")).collect()))
    finally:
        context._jsc.clearJobGroup()
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {k: 0 for k in range(9)} | {20: 20, 25: 20, 30: 20}
    if per_task > 10:
        status = context.statusTracker()
        stages = {s for j in status.getJobIdsForGroup(f"edges-{per_task}") for s in status.getJobInfo(j).stageIds}
        tasks = [i.numTasks for i in map(status.getStageInfo, stages) if i]
        assert tasks and max(tasks) <= 4


def test_jaccard_long_texts_with_a_common_passage(spark):
    """Texts of 2,000 shingles that share a fifth; two pairs of them are near copies, on either side of the threshold."""
    rng = np.random.default_rng(8)
    passage = [f"p{k}" for k in range(400)]
    texts = {i: passage + [f"t{i}x{k}" for k in rng.integers(0, 10**6, 1600)] for i in range(30)}
    for to, of, edits in ((100, 0, 40), (101, 1, 90)):
        texts[to] = list(texts[of])
        for k in rng.choice(1600, edits, replace=False):
            texts[to][400 + k] = f"e{to}x{k}"
    texts = {i: " ".join(w) for i, w in texts.items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    size, comp = brute(texts)
    assert comp[100] == 0 and comp[101] == 101
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()} == {i: (size[i], comp[i]) for i in texts}


def test_sketches_bound_differences_from_below():
    rng = np.random.default_rng(9)
    for n, other in ((40, 50), (300, 340), (900, 1100), (3000, 3100)):
        x = rng.integers(0, 2**63, n, dtype=np.uint64)
        y = np.concatenate([x[: n // 2], rng.integers(0, 2**63, other - n // 2, dtype=np.uint64)])
        sizes, h = np.array([n, other]), np.concatenate([np.sort(x), np.sort(y)])
        longs, each = jaccard.dense_sketches(np.repeat([0, 1], sizes), h, sizes)
        a, b = longs[: each[0]].view(np.uint64), longs[each[0] :].view(np.uint64)
        fold = lambda s, k: s if len(s) == k else s[:k] ^ s[k:]
        k = min(len(a), len(b))
        apart, true = int(np.bitwise_count(fold(a, k) ^ fold(b, k)).sum()), n + other - 2 * (n // 2)
        assert 7 * apart > n + other and apart <= true  # told apart, at a third in common


def test_jaccard_null_and_repeated_ids(spark):
    text = [" ".join(f"w{j}" for j in range(k, k + 40)) for k in (0, 1, 500, 900)]
    rows = [(None, text[0]), (5, text[1]), (None, text[2]), (7, text[3]), (7, text[2]), (7, text[3]), (9, text[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in jaccard.near_duplicates(df).collect())
    assert got == [(0, 5), (0, 7), (5, 5), (7, 7), (7, 7), (7, 7), (9, 5)]
    alone = jaccard.near_duplicates(df.filter("doc_id is null")).collect()
    assert [r["component_id"] for r in alone] == [None, None]


def test_jaccard_odd(spark, odd, empty):
    got = jaccard.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and jaccard.near_duplicates(empty).count() == 0
    assert {r["doc_id"]: r["n_shingles"] for r in got if r["doc_id"] in (1, 2, 3, 5)} == {1: 0, 2: 0, 3: 0, 5: 1}
    assert jaccard.deduplicated(odd).columns == odd.columns


# 4


def _machine(spark, texts: list[str], y: list) -> dict:
    free = [i for i in range(8 * len(texts)) if zlib.crc32(str(i).encode()) % 4 != 2][: len(texts)]
    docs = spark.createDataFrame(list(zip(free, texts, strict=True)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(v)) for i, v in zip(free, y, strict=True)], "doc_id long, toxic int")
    return toxicity.train(*toxicity.training_sample(docs, labels))


def _logits(m: dict, texts: list[str]) -> np.ndarray:
    v = toxicity.Vocabulary(m["vocabulary"])
    return toxicity.logits(m, *v.distinct(*toxicity.terms(*bytetext.flat(pa.array(texts)))), len(texts))


def test_toxicity(spark, odd, empty):
    rng = np.random.default_rng(4)
    words = [f"tok{k}" for k in range(300)]
    text = lambda y: " ".join([*rng.choice(words, 40), *(["Stumpf" + str(rng.integers(1e5)), "nogood"] if y else [])])
    docs = [(i, text(i % 5 == 0)) for i in range(600)]
    docs[5] = (5, docs[5][1] + " filler" * 30_000)  # very long, and learned from
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)] + [(9999, 1), (1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(*toxicity.training_sample(df, labels))
    made = toxicity.with_toxicity(df, model).filter(is_held_out("doc_id")).collect()
    assert sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in made) >= 0.97 * len(made)
    scored = toxicity.with_toxicity(odd, model).collect()
    assert len(scored) == len(ODD) and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.with_toxicity(empty, model).count() == 0
    none = toxicity.training_sample(df, labels.limit(0))
    assert toxicity.train(*none) == {"constant": 0.0} and toxicity.train(*toxicity.training_sample(df, labels.filter("toxic = 1"))) == {"constant": 1.0}


def test_machine_is_the_sum_over_pairs(spark):
    rng = np.random.default_rng(6)
    m = {"vocabulary": np.unique(toxicity.terms(*bytetext.flat(pa.array([" ".join(f"word{chr(97 + k)}" for k in range(20))])))[1]), "w0": -0.7}
    k = len(m["vocabulary"])
    m |= {"w": rng.normal(0, 1, k), "v": rng.normal(0, 0.4, (k, toxicity.FACTORS))}
    texts = [" ".join(f"Word{chr(97 + x)}" for x in rng.integers(0, 26, n)) for n in (0, 1, 2, 9, 40)]
    got = toxicity.with_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), m).collect()
    index = {int(h): i for i, h in enumerate(m["vocabulary"])}
    for r in got:
        t = sorted({index[h] for h in toxicity.terms(*bytetext.flat(pa.array([texts[r["doc_id"]].lower()])))[1].tolist() if h in index})
        z = m["w0"] + sum(m["w"][i] for i in t) + sum(float(m["v"][i] @ m["v"][j]) for x, i in enumerate(t) for j in t[x + 1 :])
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-9) and r["predicted"] == int(r["score"] >= toxicity.THRESHOLD)


def test_machine_learns_an_interaction(spark):
    rng = np.random.default_rng(5)
    texts, y = [], []
    for _ in range(900):
        a, b = rng.random(2) < 0.5
        texts.append(" ".join([*rng.choice([f"f{k}" for k in "abcdefgh"], 3), *(["insultword"] if a else []), *(["groupword"] if b else [])]))
        y.append(a and b)
    z = _logits(_machine(spark, texts, y), [f"fa fb fc {x}" for x in ("insultword", "groupword", "insultword groupword")])
    assert z[2] > 0 > max(z[0], z[1])


def test_machine_keeps_a_seldom_group_term(spark):
    """Insults are in a fifth of texts; a group mention, in 6 %, depends on the label beside one alone."""
    rng = np.random.default_rng(9)
    texts, y = [], []
    for _ in range(3000):
        insult, group = rng.random() < 0.2, rng.random() < 0.06
        group = group or (insult and rng.random() < 0.25)
        toxic = insult and group
        texts.append(" ".join([*rng.choice([f"f{x}" for x in "abcdefghijkl"], 4), *(["slurword"] if insult else []), *(["folkname"] if group else [])]))
        y.append(toxic)
    m = _machine(spark, texts, y)
    z = _logits(m, ["fa fb slurword", "fa fb folkname", "fa fb slurword folkname"])
    assert z[2] > 0 > max(z[0], z[1])


def test_vocabulary_takes_terms_that_tell_beside_others(spark):
    """A term independent of the label over all texts, and not among those with a telling one."""
    rows, terms = [], []
    for k in range(1200):
        slur, group = k % 4 == 0, k % 12 in (0, 1, 5)
        toxic = (slur and (k % 12 == 0 or k % 5 == 0)) or (not slur and not group and k % 40 == 3)
        rows.append((k, int(toxic)))
        terms += [(k, h) for h, there in ((1, slur), (2, group), (3, k % 10 == 0)) if there]
    terms, rows = spark.createDataFrame(terms, "row long, h long"), spark.createDataFrame(rows, "row long, toxic int")
    assert {1, 2} <= {r["h"] for r in toxicity.vocabulary(terms, rows).collect()}


# 5


def test_preferences(spark):
    t = [(1, True, 0, "system", "s"), (1, True, 1, "user", "q"), (1, True, 2, "assistant", "good"), (1, False, 0, "system", "s"), (1, False, 1, "user", "q"), (1, False, 2, "assistant", "bad"), (1, False, 3, "user", "why")]
    t += [(2, True, 0, "user", "only"), (3, False, 0, None, None), (4, True, 0, "user", "x"), (4, False, 0, "user", "x"), (None, True, 0, "user", "lost")]
    got = {r["pair_id"]: r for r in chat.preferences(spark.createDataFrame(t, "pair_id long, chosen boolean, turn int, role string, text string")).collect()}
    assert {k: r["status"] for k, r in got.items()} == {1: "ok", 2: "no_rejected", 3: "no_chosen", 4: "same"}
    r = got[1]
    assert r["prompt_turns"] == 2 and r["prompt"] == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nq<|im_end|>\n"
    assert [r["chosen"][s["start"] : s["end"]] for s in r["chosen_spans"]] == ["good<|im_end|>"]
    assert [r["rejected"][s["start"] : s["end"]] for s in r["rejected_spans"]] == ["bad<|im_end|>"]
    assert got[4]["chosen"] == "" and got[2]["prompt"] == ""


def test_preferences_against_a_loop(spark):
    """Random conversations with shared beginnings, one of very many turns, null and clashing turns, and ids beyond 2**53."""
    rng = np.random.default_rng(1)
    roles, rows = ["system", "user", "assistant", None], []
    for k in range(60):
        pair = k if k < 50 else (1 << 54) + 2 * k + 1
        shared = [(roles[rng.integers(4)], f"s{rng.integers(3)}") for _ in range(rng.integers(0, 6) if k else 3000)]
        for side in (0, 1) if k % 9 else (k % 2,):
            turns = shared + [(roles[rng.integers(4)], None if rng.random() < 0.1 else f"x{rng.integers(2)}") for _ in range(rng.integers(0, 4))]
            rows += [(2 * pair + side, t, role, text) for t, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pairs = df.select(F.shiftright("conv_id", 1).alias("pair_id"), (F.col("conv_id") % 2 == 0).alias("chosen"), "turn", "role", "text")
    got = {r["pair_id"]: r for r in chat.preferences(pairs).collect()}
    by: dict = {}
    for c, t, role, text in rows:
        by.setdefault(c // 2, ([], []))[c % 2].append((t, role or "", text or ""))
    assert set(got) == set(by) and max(got) > 1 << 53
    render = lambda ts: "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for _, role, text in ts)
    for k, (c, j) in by.items():
        n = 0
        while n < min(len(c), len(j)) and c[n][1:] == j[n][1:]:
            n += 1
        r = got[k]
        assert (r["prompt_turns"], r["prompt"], r["chosen"], r["rejected"]) == (n, render(c[:n]), render(c[n:]), render(j[n:])), k
        want = [f"{text}<|im_end|>" for _, role, text in c[n:] if role == "assistant"]
        assert [r["chosen"][x["start"] : x["end"]] for x in r["chosen_spans"]] == want
    assert sum(r["prompt_turns"] > 0 and r["status"] == "ok" for r in got.values()) > 20
    assert chat.preferences(pairs.limit(0)).count() == 0


def test_other_ends(spark):
    t = [(2, 0, "user", "q"), (2, 1, "assistant", "a"), (2, 2, "user", "r"), (2, 3, "assistant", "good"), (2, 4, "user", "bye"), (3, 0, "assistant", "bad"), (4, 0, "user", "alone"), (None, 0, "assistant", "lost")]
    got = {r["pair_id"]: r for r in chat.preferences(chat.with_other_ends(spark.createDataFrame(t, "conv_id long, turn int, role string, text string"))).collect()}
    assert set(got) == {2, 3, 4} and (got[2]["prompt_turns"], got[3]["prompt_turns"], got[4]["status"]) == (3, 0, "no_rejected")
    assert "good" in got[2]["chosen"] and "bad" in got[2]["rejected"] and "good" not in got[2]["rejected"] and got[2]["rejected"].endswith("bye<|im_end|>\n")


# 6


def test_packing_round_trip(spark, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    texts = ["", None, " ", "hello<|endoftext|>  world   x　y  \n\n z", "é à", "don't  we'll 'tis\t\n a1b2  ", *("alpha beta gamma %d " % k * (k * 40) for k in range(12))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pack(df).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, text in enumerate(texts):
        want = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in pieces]).tolist() == want and all(r["doc_tokens"] == len(want) for r in pieces)
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r["offset"])
        n = sum(r["length"] for r in pieces)
        assert [r["offset"] for r in pieces] == np.cumsum([0, *(r["length"] for r in pieces)])[:-1].tolist() and n <= 2048 and n & (n - 1) == 0
    assert packing.pack(empty).count() == 0 and packing.pack(odd).agg(F.count_distinct("doc_id")).first()[0] == 5


def test_parts_with_one_hash_keep_their_ids(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing.bytetext, "mix", lambda h: h & np.uint64(7))  # every hash is that of many parts
    path = public_tokenizers.path(packing.TOKENIZER)
    text = "the quick brown fox jumps over the lazy dog and some other words of several lengths"
    for _ in range(2):
        ids, tokens = packing.Encoder(path)(*bytetext.flat(pa.array([text, text[::-1]])))
        want = [x for t in (text, text[::-1]) for x in (*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 1)]
        assert ids.tolist() == want and tokens.sum() == len(want)


def test_new_parts_are_learned_in_arrays():
    """Parts that come up once are most of what is encoded: few calls of Python each, and the ids of the tokenizer."""
    import cProfile

    import public_tokenizers
    from tokenizers import Tokenizer

    path, n = public_tokenizers.path(packing.TOKENIZER), 25_000
    text = " ".join(f"x{k * 7919 % 10**6}" for k in range(n))
    encode, profile = packing.Encoder(path), cProfile.Profile()
    ids, tokens = profile.runcall(encode, *bytetext.flat(pa.array([text])))
    assert sum(e.callcount for e in profile.getstats()) < 4 * n
    assert ids.tolist() == [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 1] and tokens.tolist() == [len(ids)]


def test_new_parts_are_encoded_many_to_a_text():
    """Few texts go to the tokenizer, and parts keep the ids that they have alone; bytes that are no text too."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path, n = public_tokenizers.path(packing.TOKENIZER), 5_000
    plain, rng = Tokenizer.from_file(path), np.random.default_rng(3)
    odd = ["é", "ß\u00a0", "\u2003", "\u0085", "日本", "🙂", "'s", "' s", "\t", "\n\n", "  ", " ", "a", "Zz", "12", "...", "<|endoftext|>", "\x00", "\u0301", " \u00a0x"]
    texts = [" ".join(f"y{k * 7919 % 10**6}" for k in range(n)), *("".join(rng.choice(odd, rng.integers(0, 40))) for _ in range(300)), None, " ", ""]
    encode, asked = packing.Encoder(path), []
    real = encode.encode
    encode.encode = lambda texts, **how: asked.append(len(texts)) or real(texts, **how)
    ids, tokens = encode(*bytetext.flat(pa.array(texts)))
    want = [[*plain.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert tokens.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]
    assert sum(asked) < n / 3
    broken = [b"one \xff two", b"three \xc3", b" four"]
    ids, _ = encode(*bytetext.flat(pa.array(broken)))
    assert ids.tolist() == [x for b in broken for x in (*plain.encode(b.decode("utf-8", "replace"), add_special_tokens=False).ids, 1)]


def test_ranges_hold_equal_bytes_and_neighbours(spark, monkeypatch):
    """Two topics, one in long documents, and a third of copies: ranges by bytes, and sequences of one topic."""
    monkeypatch.setattr(packing, "RANGE_BYTES", 1 << 15)
    monkeypatch.setattr(packing, "UNIT_BYTES", 1 << 7)
    rng = np.random.default_rng(0)
    words = [[f"{c}{k}" for k in range(60)] for c in "ab"]
    texts = [" ".join(rng.choice(words[k % 2], 60 if k % 2 else 900)) for k in range(300)] + [" ".join(words[0] * 3)] * 300
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def keyed(parts):
        for part in parts:
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(packing.curve_keys(*bytetext.flat(part.column("text"))))], [*part.schema.names, "_key"])

    placed = docs.mapInArrow(keyed, "doc_id long, text string, _key long").withColumns({"_place": F.shiftleft("_key", 20) + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)), "_bytes": F.octet_length("text")})
    sizes = [r["b"] for r in packing._in_ranges(placed).groupBy("_range").agg(F.sum("_bytes").alias("b")).collect()]
    assert len(sizes) > 20 and max(sizes) < 2.5 * np.mean(sizes)
    by_sequence: dict = {}
    for r in packing.pack(docs).filter("doc_id < 300").collect():
        by_sequence.setdefault(r["sequence_id"], []).append((r["doc_id"] % 2, r["length"]))
    one = [max(sum(n for t, n in pieces if t == k) for k in (0, 1)) / sum(n for _, n in pieces) for pieces in by_sequence.values()]
    assert np.mean(one) > 0.9


def test_hilbert_is_a_walk():
    g = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    h = packing.hilbert(g, 3)
    assert sorted(h) == list(range(512)) and (np.abs(np.diff(g[np.argsort(h)], axis=0)).sum(axis=1) == 1).all()


# 7


def test_licenses(spark, odd, empty):
    filler = [" ".join(np.random.default_rng(k).choice([f"lorem{j}" for j in range(90)], 25)) for k in range(300)]
    model = licenses.train(filler)
    docs = [(0, filler[0] + "\nReleased under the MIT License."), (1, filler[1]), (2, "Licensed under the Apache License, Version 2.0. " + filler[2]), (3, "This work is licensed under the GNU General Public License, version 3.")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    assert {k: (r["family"], r["confirmed"]) for k, r in got.items()} == {0: ("mit", True), 1: ("unknown", False), 2: ("apache-2.0", True), 3: ("gpl", True)}
    assert got[0]["n_paragraphs"] == 2 and got[0]["n_licensed"] == 1
    assert licenses.scan(odd, model).count() == len(ODD) and licenses.scan(empty, model).count() == 0


WRAPPED_NOTICES = {
    "mit": "MIT License\n\nCopyright (c) 2020 Some Body\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software.",
    "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice.",
}


def test_wrapped_licenses(spark):
    filler = [" ".join(np.random.default_rng(k).choice([f"lorem{j}" for j in range(90)], 25)) for k in range(300)]
    model = licenses.train(filler)
    docs = [(k, f"{filler[k]}\n\n{text}\n\n{filler[k + 9]}") for k, text in enumerate(WRAPPED_NOTICES.values())]
    docs += [(3, "\n\n".join(WRAPPED_NOTICES.values())), (4, WRAPPED_NOTICES["gpl"].replace("\n", "\n\n")), (5, "\n".join(filler[:20]))]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    assert [(got[k]["family"], got[k]["confirmed"], got[k]["n_licensed"]) for k in range(3)] == [(f, True, 1) for f in WRAPPED_NOTICES]
    assert got[3]["n_licensed"] == 3 and not got[4]["confirmed"] and (got[5]["family"], got[5]["n_licensed"]) == ("unknown", 0)


def test_a_phrase_in_a_sentence_is_no_license(spark):
    """Three words that a longer sentence holds as well confirm nothing; by themselves or in a notice they do."""
    filler = [f"the {a} met the {b} near the old mill and talked about {c}" for a in ("farmer", "baker", "driver") for b in ("teacher", "doctor", "singer") for c in ("bread", "rain", "trains")]
    texts = ["All rights reserved for the annual general meeting of the club were given.", "All rights reserved.", "Copyright 2020 Example Inc. All rights reserved.", "// SPDX-License-Identifier: MIT", "the farmer met the baker"]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), licenses.train(filler)).collect()}
    assert [got[k]["confirmed"] for k in range(5)] == [False, True, True, True, False]
    assert [got[k]["family"] for k in range(1, 4)] == ["proprietary", "proprietary", "mit"] and got[0]["n_licensed"] == 0


def test_license_scores_against_a_loop(spark):
    """Every line's score, family and similarity again in plain Python, and every confirmed window's."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    lines = licenses.training_lines(docs)
    model = licenses.train(lines)
    assert 0 < len(lines) <= licenses.SAMPLE_LINES and model["least"] >= 0.5 and any(0.0 in w for w in model["weights"].values())
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["text"]}
    classes = model["classes"]

    def score(grams: list[str]) -> tuple[float, str, float]:
        z = np.array(model["bias"]) + sum(np.array(model["weights"][g]) for g in grams if g in model["weights"])
        p = np.exp((z - z.max()) / model["temperature"])
        p /= p.sum()
        family = classes[int(p[:-1].argmax())] if p[:-1].max() >= model["least"] and p[:-1].max() >= p[-1] else licenses.UNKNOWN
        known = [set(licenses.grams(t)) for t in licenses.TEMPLATES.get(family, ())]
        return p[:-1].max(), family, max([len(t & set(grams)) / len(t) for t in known if len(t) >= licenses.EVIDENCE or 3 * len(t & set(grams)) >= len(set(grams))], default=0.0)

    rows = licenses.scan_paragraphs(docs, model).filter("last is null and pos is not null").collect()
    assert rows
    for r in rows:
        want = score(licenses.grams(texts[r["doc_id"]].split("\n")[r["pos"]]))
        assert (r["score"], r["similarity"]) == pytest.approx((want[0], want[2]), abs=1e-9) and r["family"] == want[1]
        assert r["licensed"] == (want[1] != licenses.UNKNOWN and want[2] >= licenses.CONFIRMED)


def test_planted_licenses_are_found_and_clean_texts_left_alone(spark):
    """License texts planted, as wrapped paragraphs, in documents that nothing was learned from."""
    docs = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("text").collect() if r["text"]]
    known, rest = docs[::2], [d for d in docs[1::2] if not re.search("(?i)licen|rights reserved|redistribut|permission is", d)]
    learned = spark.createDataFrame(list(enumerate(known)), "doc_id long, text string")
    model = licenses.train(licenses.training_lines(learned))
    planted = []
    for k, (family, ts) in enumerate(sorted(licenses.TEMPLATES.items())):
        for t in ts:
            w = t.split()
            planted.append((family, f"{rest[k]}\n\n" + "\n".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9)) + f"\n\n{rest[k + 20]}"))
    clean = rest[40:]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*[t for _, t in planted], *clean])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(df, model).collect()}
    right = [got[i]["confirmed"] and got[i]["family"] == f for i, (f, _) in enumerate(planted)]
    assert np.mean(right) >= 0.9, [(planted[i][0], got[i]["family"]) for i, ok in enumerate(right) if not ok]
    assert clean and not any(got[len(planted) + i]["confirmed"] for i in range(len(clean)))


# 8


def test_url_rules_and_links(spark):
    page = lambda i, url, html=None: (i, url, html)
    rows = [page(1, "http://A.com/x?q#f"), page(2, "https://www.example.com/en/1"), page(3, "https://example.com/en/1"), page(4, "https://x.example.com/en"), page(5, "http://b.net/es/1"), page(6, None), page(7, "nourl"), page(8, "http://c.com"), page(9, "http://notcom/")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlgraph.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {
        1: ("a.com", "/x", "com/", "allow"), 2: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 3: ("example.com", "/en/1", "example.com/en/", "block"), 4: ("x.example.com", "/en", "com/", "allow"),
        5: ("b.net", "/es/1", "net/es/", "block"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("c.com", "", None, "allow"), 9: ("notcom", "/", None, "allow"),
    }
    link = '<a href="http://bad.net/es/1">x</a>'
    rows = [page(1, "http://bad.net/es/1"), page(2, "http://farm.org/a", link * 3), page(3, "http://mixed.org/a", link + '<a href="//good.com/">' * 9), page(4, "http://good.com/", '<a href="http://mixed.org/">')]
    got = {r["host"]: r["verdict"] for r in urlgraph.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {"bad.net": "block", "farm.org": "block", "mixed.org": "allow", "good.com": "allow"}


def test_distrust_converges(spark):
    """A tenth of a densely linked farm is blocked: the others have 0.062 of distrust after 8 rounds and 0.0809 in the end."""
    hosts = [*(f"bad{k}.net" for k in range(2)), *(f"farm{k}.org" for k in range(18))]
    rows = [(k, f"http://{h}/es/1", "".join(f'<a href="http://{x}/">' for x in hosts)) for k, h in enumerate(hosts)]
    got = {r["host"]: r for r in urlgraph.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {r["verdict"] for r in got.values()} == {"block"}
    p = (np.ones((20, 20)) - np.eye(20)) / 19
    want = np.linalg.solve(np.eye(20) - 0.85 * p, 0.15 * np.array([1.0] * 2 + [0.0] * 18))
    assert [got[h]["distrust"] for h in hosts] == pytest.approx(want.tolist(), abs=1e-6)


def test_scores_against_dense_iteration(spark):
    """A random graph of hosts with a hub and hosts without links: trust and distrust as linear systems."""
    rng = np.random.default_rng(4)
    n = 40
    hosts = [f"good{k}.com" if k < 4 else f"bad{k}.net" if k < 7 else f"plain{k}.org" for k in range(n)]
    links = np.where(rng.random((n, n)) < 0.08, rng.integers(1, 4, (n, n)), 0)
    links[9, :] = 1  # a hub that links to all
    links[:, 10] += 2  # and one that all link to
    links[20:24, :] = 0
    np.fill_diagonal(links, 0)
    page = lambda k: "".join(f'<a href="{"//" if (k + j) % 2 else "https://"}{hosts[j]}/">' * int(links[k, j]) for j in range(n))
    rows = [(k, f"http://{hosts[k]}/es/1", page(k) + f'<a href="/own?u=http://{hosts[5]}/es/1"><a href="x.html">') for k in range(n)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["host"]: r for r in urlgraph.judge(df).collect()}
    d = urlgraph.DAMPING
    forth, back = (x / np.maximum(x.sum(axis=1, keepdims=True), 1) for x in (links, links.T))
    for kind, step, seeds in (("trust", forth, [h.endswith(".com") for h in hosts]), ("distrust", back, [h.endswith(".net") for h in hosts])):
        want = np.linalg.solve(np.eye(n) - d * step.T, (1 - d) * np.array(seeds, float))
        assert [got[h][kind] or 0.0 for h in hosts] == pytest.approx(want.tolist(), abs=2e-6)
    assert got[hosts[5]]["verdict"] == "block" and all(got[h]["verdict"] == "allow" for h in hosts[:4])


def test_url_sql_follows_links_as_far(spark):
    """Many hosts linked to each other, some of them blocked by rules: what distrust comes to after many rounds decides the rest, in SQL too."""
    n, blocked = 40, 4
    hosts = [f"bad{k}.net" if k < blocked else f"plain{k}.org" for k in range(n)]
    rows = [(k, f"http://{hosts[k]}/es/1", "".join(f'<a href="//{hosts[j]}/">' for j in range(n) if j != k)) for k in range(n)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in urlgraph.judge(df).collect()}
    con = duckdb.connect()
    con.register("pages", pa.table({"page_id": [r[0] for r in rows], "url": [r[1] for r in rows], "html": [r[2] for r in rows]}))
    assert {r[0]: r[4] for r in con.execute(urlgraph.SQL).fetchall()} == got and set(got.values()) == {"block"}


def test_urls_odd(spark):
    """An address in a relative link's query is no link; clashing columns; repeated rows and null ids; an empty table."""
    rows = [(1, "http://bad.net/es/1", None, "x"), (2, "http://good.org/a", '<a href="/go?u=http://bad.net/es/1">', "y"), (2, "http://good.org/a", '<a href="/go?u=http://bad.net/es/1">', "y"), (None, "http://good.org/b", "", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")
    got = urlgraph.judge(df).collect()
    assert sorted((r["page_id"] or 0, r["verdict"]) for r in got) == [(0, "allow"), (1, "block"), (2, "allow"), (2, "allow")]
    assert urlgraph.judge(df.limit(0)).count() == 0


# 9


def _taken(made) -> dict:
    total = F.sum(F.col("copies") * F.col("size"))
    return {r["source"]: r for r in made.groupBy("source").agg(F.first("source_size").alias("size"), F.first("target").alias("target"), total.alias("taken"), F.max("copies").alias("most"), F.max("size").alias("longest")).collect()}


def test_mixing(spark, odd, empty):
    rows = [(i, "w " * (1 + i % 9), s) for s, n in (("a", 20), ("b", 300), (None, 500)) for i in range(n)]
    df = spark.createDataFrame([(k, t, s) for k, (_, t, s) in enumerate(rows)], "doc_id long, text string, source string")
    made = mixing.with_copies(df)
    per = _taken(made)
    total = sum(r["size"] for r in per.values())
    assert per["a"]["target"] == 3 * per["a"]["size"] and sum(r["target"] for r in per.values()) == pytest.approx(total)
    assert per["b"]["target"] == pytest.approx(2 * per[None]["target"])
    assert all(abs(r["taken"] - r["target"]) <= r["longest"] and r["most"] <= 3 for r in per.values())
    assert mixing.mix(df).count() == made.agg(F.sum("copies")).first()[0] and mixing.mix(odd).columns == odd.columns
    assert mixing.mix(empty).count() == 0 and mixing.with_copies(odd).count() == len(ODD) and mixing.with_copies(empty).count() == 0


def test_mixing_draws_by_the_fraction(spark):
    """Over seeds, a document is emitted as often as its source's rate says; small sources come near their targets."""
    df = spark.createDataFrame([(i, "w " * (1 + (7 * i) % 30), "ab"[i >= 15]) for i in range(60)], "doc_id long, text string, source string")
    copies = np.zeros(60)
    for k in range(12):
        made = mixing.with_copies(df, seed=f"seed{k}").collect()
        for r in made:
            copies[r["doc_id"]] += r["copies"] / 12
        rate = {r["source"]: r["target"] / r["source_size"] for r in made}
    assert np.abs(copies[:15].mean() - rate["a"]) < 0.1 and np.abs(copies[15:].mean() - rate["b"]) < 0.1
    assert len(set(copies[15:].round(6).tolist())) > 2


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_mixing_comes_near_its_targets(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    assert all(abs(r["taken"] - r["target"]) <= max(0.02 * r["target"], r["longest"]) for r in _taken(mixing.with_copies(docs)).values())


def test_mixing_never_repeats_beyond_the_cap(spark):
    """Source a is at its cap; its empty documents get no fourth copy."""
    rows = [(k, "w " * 10 if k % 2 else "", "en", "a", 1) for k in range(40)] + [(100 + k, "w " * 400, "en", "b", 1) for k in range(40)]
    copies = mixing.with_copies(spark.createDataFrame(rows, DOC)).collect()
    assert {r["copies"] for r in copies if r["source"] == "a"} == {3}
    assert mixing.mix(spark.createDataFrame(rows, DOC)).filter("source = 'a'").count() == 120


def test_mixing_leaves_columns_alone(spark):
    df = spark.createDataFrame([(1, "a b", "s", 100, 2.5, 7), (2, "c", None, 101, None, 8)], "doc_id long, text string, source string, size int, target double, copies int")
    assert {(r["size"], r["target"], r["copies"]) for r in mixing.mix(df).collect()} <= {(100, 2.5, 7), (101, None, 8)}


# 10


def test_quality(spark, odd, empty):
    body = lambda k: " ".join(f"{'abcdefgh'[k]}{'abcdefgh'[j % 8]}{'abcdefghij'[j // 8]}" for j in range(80))
    rows = [(k, "Shared footer line 12\n" + body(k), "s") for k in range(8)] + [(50, "a b c a b c z", "s"), (51, "x #y\nx #y\n\nx #y", "s"), (52, "Shared footer  LINE 7\n" * 30 + "u v w", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality.judge(df, max_docs=5).collect()}
    assert (got[50]["n_words"], got[50]["n_repeat_words"], got[50]["word_chars"]) == (7, 6, 7)
    assert (got[51]["n_dup_lines"], got[51]["n_symbols"], got[51]["n_repeat_words"]) == (2, 3, 6)
    assert [got[k]["removed_words"] for k in (0, 1, 7)] == [0, 4, 4] and all(got[k]["kept"] for k in range(8))
    assert got[52]["base_failed"] and got[52]["removed_words"] == 120
    texts = {r["doc_id"]: r["text"] for r in quality.clean(df, max_docs=5).collect()}
    assert texts[0].startswith("Shared") and texts[1] == body(1) and 50 not in texts
    assert len(quality.judge(odd).collect()) == len(ODD) and quality.judge(empty).count() == 0 and quality.clean(odd).columns == odd.columns


def test_quality_finds_boilerplate_in_hosts_of_any_size(spark, tmp_path):
    """By the registered query, with its own limits."""
    letters = lambda k: "".join("abcdefghij"[int(x)] for x in str(k))
    body = lambda k: " ".join(f"w{letters(k)}x{letters(j)}" for j in range(60))
    rows = [(k, "footer of all 1\n" + body(k), "ten") for k in range(10)] + [(100 + k, ("seldom line\n" if k < 12 else "often here\n" if k < 112 else "") + body(k), "many") for k in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in registry.queries()["op10_quality"](spark, str(tmp_path)).collect()}
    assert [got[k]["removed_words"] for k in range(10)] == [0] + [4] * 9
    assert {k - 100 for k, r in got.items() if k >= 100 and r["removed_words"]} == set(range(13, 112))
    assert all(r["kept"] for r in got.values())


def test_repeated_words_against_brute_force(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(list("abcdefg"), n)) for n in (0, 1, 2, 3, 4, 9, 40, 300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.with_counts(df).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        wins = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        assert got[i] == len({k + d for k, x in enumerate(wins) if wins.count(x) > 1 for d in range(3)})


# 13


def test_plain_changes_visit_every_order_by_one_swap():
    for n in range(1, 6):
        made = list(audit.plain_changes(n))
        assert {tuple(o) for o, _ in made} == set(itertools.permutations(range(n)))
        assert len(made) == math.factorial(n) and made[0][1] is None
        for (a, _), (b, i) in itertools.pairwise(made):
            assert b == [*a[:i], a[i + 1], a[i], *a[i + 2 :]]


def _audited(rows: list[tuple], labels: dict) -> dict:
    """Every filter of every order applied to a list of documents."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    fails = [
        (len(w) < 200) * "A" + (100 * len(set(w)) < 50 * len(w)) * "B" + (100 * len(re.findall("[A-Z]", t or "")) > 2 * len(t or "")) * "C" + bool(re.search(r"[#$%&*|]", t or "")) * "D"
        + any(o is not None and d is not None and o < d and (u or "") == (t or "") for o, u, *_ in rows) * "E"
        for w, (d, t, *_) in zip(words, rows, strict=True)
    ]
    out = {}
    for part in {r[3] or "" for r in rows}:
        mine = [(f, labels.get(r[0], (0, 0))) for f, r in zip(fails, rows, strict=True) if (r[3] or "") == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                out[part, order, step] = [len(left), len(gone), sum(f in x[0] for x in mine) - len(gone), sum(f == x[0] for x in mine), sum(x[1][0] == 1 for x in gone), sum(x[1][1] == 1 for x in gone)]
    for part in {k[0] for k in out}:
        for f in "ABCDE":
            at = [k for k in out if k[0] == part and k[1][k[2] - 1] == f]
            total = sum(out[k][1] for k in at)
            for k in at:
                out[k].append(total)
    return out


def _rows_13(spark, rows: list[tuple], labels: list[tuple]) -> dict:
    made = audit.interactions(audit.cells(spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    got = {(r["part"], r["filter_order"], r["step"]): [r[m] for m in audit.MEASURES] for r in made}
    assert len(got) == len(made)
    return got


def test_filters_against_a_loop(spark):
    long = " ".join(f"w{k}" for k in range(210))
    texts = [long, long, long, long + " #", "A B C", "one two", long.upper(), "same " * 300, "same & " * 300, None, ""]
    rows = [(k, t, "en", s, 1) for k, (t, s) in enumerate(itertools.product(texts, ["a", None, ""]))] + ODD
    labels = [(k, k % 3, (k // 3) % 2) for k in range(0, 33, 2)] + [(2, 1, 0), (4, None, 1), (None, 1, 1)]
    most = {}
    for d, q, t in labels:
        if d is not None:
            most[d] = tuple(max(x or 0, y or 0) for x, y in zip(most.get(d, (0, 0)), (q, t), strict=True))
    assert _rows_13(spark, rows, labels) == _audited(rows, most)


def test_filters_odd(spark, odd, empty):
    assert _rows_13(spark, ODD, []) == _audited(ODD, {})
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(audit.cells(empty, labels)).count() == 0
    clash = spark.createDataFrame([r + ("x",) * 3 for r in ODD], DOC + ", mask string, digest string, part string")
    assert audit.interactions(audit.cells(clash, labels)).count() == 3 * 600
    # A hot part and many parts.
    many = spark.range(3000).selectExpr("id doc_id", "if(id % 3 = 0, 'hot', concat('p', id)) source", "concat('text ', id % 7) text")
    made = audit.interactions(audit.cells(many, labels)).filter("filter_order = 'EABCD' and step = 1").collect()
    assert len(made) == 2001 and sum(r["removed"] for r in made) == 2993 and sum(r["kept"] for r in made) == 7


# 11


def _key_11(line: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\f\r"))


def _lines_11(rows: list[tuple]) -> list[tuple]:
    """(doc_id, lines, dropped, text) by a dictionary of keys; a null id is one below all."""
    holds = {}
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            holds.setdefault(_key_11(line), set()).add(-(1 << 63) if d is None else d)
    out = []
    for d, t, *_ in rows:
        lines, me = (t or "").split("\n"), -(1 << 63) if d is None else d
        stay = [x for x in lines if len(k := _key_11(x)) < 40 or len(holds[k]) < 5 or me == max(holds[k])]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def _got_11(df, **how) -> list[tuple]:
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in linedup.dedup(df, **how).collect()), key=str)


def test_lines_against_a_dictionary(spark, odd, empty):
    rng = random.Random(1)
    pool = [x * 3 for x in ("Footer of ÉCOLE pages, Straße 12; ", "All İstanbul ΣΑΣ lines ARE kept. ", "plain Words over and Over again ", "\U0001f600 emoji line with forty points or so ")]
    pool += ["x" * 39, "Y" * 40, " \t" + "y" * 40 + "\r", "\xa0" + "y" * 40, "é" * 40, "É" * 40, "", "short"]
    rows = [(d, "\n".join(rng.choices(pool, k=rng.randrange(0, 9)) + [f"line of its own {d} " * 3] * rng.randrange(2)), None, None, 1) for d in [*range(40), *range(40), None, None, -7]]
    rows += [(99, "\n".join(["Y" * 40, "a"] * 20_000), None, None, 1), (98, "\n".join(["y" * 40] * 3), None, None, 1)]
    rows += [r if r[1] is None or len(r[1]) < 1000 else (5, r[1], None, None, 1) for r in ODD]
    df = spark.createDataFrame(rows, DOC)
    want = _lines_11(rows)
    assert any(r[2] for r in want) and _got_11(df) == want
    assert _got_11(df, batches=1) == want and _got_11(df, batches=9) == want
    made = linedup.dedup(odd)
    assert made.columns == [*odd.columns, "n_lines", "n_dropped"] and linedup.dedup(empty).count() == 0
    clash = df.selectExpr("*", "'a' as _gone", "1 as n_lines", "'b' as _text", "0 as `a.b`")
    got = linedup.dedup(clash)
    assert got.columns == [*df.columns, "_gone", "_text", "a.b", "n_lines", "n_dropped"]
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in got.collect()), key=str) == want


@pytest.mark.parametrize("order", [[0, 1, 2, 3, 4], [4, 2, 0, 1, 3]])
def test_runs_of_lines_in_any_order_of_batches(spark, order):
    rng = random.Random(2)
    lines = [(d, bytes([rng.randrange(12)])) for d in range(50) for _ in range(2)] + [(d, b"hot") for d in range(50)] + [(d, bytes([100 + d])) for d in range(50)]
    runs = linedup.LineRuns(spark, 5, 2, 3)
    for k in order:
        runs.add(spark.createDataFrame([x for x in lines if x[0] // 10 == k], "_id long, line binary"))
        assert all(len(level) < 2 for level in runs.levels)
    rows = [spark.table(name).count() for name in runs.runs()]
    holds = {}
    for d, line in lines:
        holds.setdefault(line, set()).add(d)
    assert {(bytes(r["line"]), r["largest"]) for r in runs.frequent().collect()} == {(k, max(v)) for k, v in holds.items() if len(v) >= 5}
    assert sum(rows) < len(lines) and b"hot" in {bytes(r[0]) for r in runs.hot().collect()}
    names = runs.runs()
    runs.close()
    assert not any(spark.catalog.tableExists(n) for n in names)


# 12


def _words_12(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _buckets_12(text: str | None) -> list[int]:
    w = _words_12(text)
    return [zlib.crc32(x.encode()) % 10000 for x in w + [f"{a} {b}" for a, b in itertools.pairwise(w)]]


def _resampled(rows: list[tuple], target: list[str]) -> list[tuple]:
    found = [_buckets_12(r[1]) for r in rows]
    s, t = collections.Counter(itertools.chain(*found)), collections.Counter(itertools.chain(*map(_buckets_12, target)))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + 10000.0) / ((s[b] + 1.0) * (t.total() + 10000.0))))
    out = []
    for r, f in zip(rows, found, strict=True):
        h = int(hashlib.sha256(f"7:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f)) // len(f) if f else 0
        out.append([r[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(_words_12(r[1])) >= 20])
    able = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[2]))
    for k, x in enumerate(able):
        x[4] = k + 1 if k < 25 * len(able) // 100 else None
    return sorted((tuple(x[:4]) + (x[4] or None,) for x in out), key=str)


def _got_12(spark, rows: list[tuple], target: list[str | None]) -> list[tuple]:
    made = resample.ranked(spark.createDataFrame(rows, DOC), spark.createDataFrame([(t,) for t in target], "text string"))
    return sorted((tuple(r) for r in made.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_sums_of_spans():
    rng = random.Random(0)
    words = ["".join(rng.choices("abcé日z09", k=n)) for n in [*range(1, 70), 500, 1, 3]]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    size = np.array([len(w.encode()) for w in words])
    begin = np.cumsum(size + 1) - size - 1
    got = resample.crcs(data, begin, size)
    assert got.tolist() == [zlib.crc32(w.encode()) for w in words]
    at = np.flatnonzero(size[1:] <= resample.SHORT) + 1
    assert resample.joined(got[at - 1], got[at], size[at]).tolist() == [zlib.crc32(f"{words[k - 1]} {words[k]}".encode()) for k in at]


def test_features_of_texts_longer_than_a_slab(monkeypatch):
    monkeypatch.setattr(bytetext, "SLAB", 50)
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("aBcÉ-日9", k=rng.choice([1, 3, 9, 70]))) for _ in range(n)) + " " * (n % 7) for n in (0, 1, 40, 3, 0, 60, 2)] + [None, " - " * 60, "x" * 120, "a " + "-" * 130 + " b"]
    got = collections.defaultdict(list)
    n_words = collections.Counter()
    for doc, at, words in resample.features(*bytetext.flat(pa.array(texts))):
        n_words.update(words.tolist())
        for d, b in zip(doc.tolist(), at.tolist(), strict=True):
            got[d].append(b)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(b) for k, t in enumerate(texts) if (b := _buckets_12(t))}
    assert n_words == {k: len(w) for k, t in enumerate(texts) if (w := _words_12(t))}


def test_resampling_against_brute_force(spark, odd, empty):
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "gamma", "Ünder", "x1", "delta-epsilon", "日本"]
    texts = [" ".join(rng.choices(vocabulary[k % 3 :], k=rng.randrange(5, 60))) for k in range(60)]
    rows = [(k, texts[k % 60 if k % 3 else 0], "en", "a", 1) for k in range(150)] + [(7, texts[3], None, None, 1), (7, texts[3], None, None, 1), (7, texts[4], None, None, 1), (None, texts[5], None, None, 1)] + ODD
    target = [" ".join(rng.choices(vocabulary[4:], k=50)) for _ in range(9)] + [None, "", texts[2], texts[2]]
    want = _resampled(rows, target)
    assert _got_12(spark, rows, target) == want and sum(r[4] is not None for r in want) > 20
    assert _got_12(spark, rows, []) == _resampled(rows, [])
    assert _got_12(spark, ODD, target) == _resampled(ODD, target)
    assert resample.ranked(empty, odd).count() == 0
    # Whole documents, columns with names of the operator's own.
    docs, aim = spark.createDataFrame(rows, DOC).selectExpr("*", "1 as key", "'r' as rank", "2 as score", "3 as `a.b`"), spark.createDataFrame([(t,) for t in target], "text string")
    made = resample.drawn(docs, aim)
    assert made.columns == docs.columns
    picked = {r[0] for r in want if r[4]}
    assert {r["doc_id"] for r in made.collect()} == picked
    # The draw leans to the target: its words are more frequent than in all documents.
    share = lambda ts: sum(_words_12(t).count("x1") for t in ts) / max(1, sum(len(_words_12(t)) for t in ts))
    assert share([r["text"] for r in made.collect()]) > share([r[1] for r in rows])
