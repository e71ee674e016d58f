"""Toxicity by a factorization machine over hashed terms.

Terms are the 64-bit hashes of a text's lower-cased words and of their first bytes (4, 5
and 6, which carry inflected or compounded insults). A bounded labelled sample gives the
vocabulary, three kinds of terms: those that depend on the label (chi-square); those that
are frequent; and those that depend on it among the texts that have a term of the first kind
which speaks for label 1. The last keeps a seldom group mention that tells nothing by itself
and much beside an insult. The machine is trained in numpy; a text's logit is w0 + sum w_i +
half of sum_f ((sum v_if)**2 - sum v_if**2) over its distinct terms, so an insult counts for
more next to a group mention than the two alone. Terms outside the vocabulary have weight
zero by definition. Whole texts are learned from and scored; terms of the sample are counted
in Spark, and only those of the vocabulary reach the driver.

Defined cases: null and empty texts have no terms and score the machine's constant part;
labels other than 0 and 1 and labels without a document are not learned from; if a
document has several labels the largest counts; rows that repeat a document are scored each
(of their texts the first in order is learned from); rows with a null id are scored and
never learned from; with one class or no labelled rows every score is the share of toxic
rows (0 without any); extra columns pass through, those named like a result are replaced by
it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytetext
from .common import Stash, is_held_out, table

#: Bound of the training sample: labelled rows.
SAMPLE_ROWS = 6_000
PREFIXES = (4, 5, 6)
FACTORS, EPOCHS, BATCH, SEED = 8, 12, 64, 11
CHI_SQUARE, FREQUENT = 15.0, 0.2
THRESHOLD = 0.3


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text index and hash of the terms of all texts, with repetitions."""
    docs, hashes = [], []
    for doc, word, prefixes in bytetext.words(data, offsets, inside=bytetext.LETTER_BYTES, lower=True, prefixes=PREFIXES):
        docs.append(doc)
        hashes.append(word)
        for h in prefixes:
            there = h != 0
            docs.append(doc[there])
            hashes.append(h[there])
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(hashes)


class Vocabulary:
    """Index of a hash among the sorted hashes; a table over 22 bits turns most others away at once."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.hashes >> np.uint64(42)] = True

    def distinct(self, doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, term index) without repetitions, sorted."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        there = np.flatnonzero(self.maybe[h >> np.uint64(42)])
        doc, h = doc[there], h[there]
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        there = self.hashes[at] == h
        key = np.unique(doc[there] * np.int64(len(self.hashes)) + at[there])
        return key // len(self.hashes), key % len(self.hashes)


def _rows(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by row, rows sorted."""
    sums = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    bounds = np.searchsorted(rows, np.arange(n + 1))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def logits(m: dict, doc: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    v = m["v"][at]
    s = _rows(v, doc, n)
    return m["w0"] + _rows(m["w"][at], doc, n) + 0.5 * (s**2 - _rows(v**2, doc, n)).sum(axis=1)


def train(rows: np.ndarray, hashes: np.ndarray, y: np.ndarray, seed: int = SEED) -> dict:
    """The machine over the terms (row, hash) of len(y) rows; a constant one if there is a single class or nothing."""
    base = float(np.mean(y)) if len(y) else 0.0
    if base in (0.0, 1.0):
        return {"constant": base}
    n, vocabulary = len(y), Vocabulary(np.unique(hashes))
    doc, at = vocabulary.distinct(rows, hashes)
    rng = np.random.default_rng(seed)
    k = len(vocabulary.hashes)
    m = {"vocabulary": vocabulary.hashes, "w0": float(np.log(base / (1 - base))), "w": np.zeros(k), "v": rng.normal(0, 0.05, (k, FACTORS))}
    gw, gv, g0 = np.full(k, 1e-8), np.full((k, FACTORS), 1e-8), 1e-8
    bounds = np.searchsorted(doc, np.arange(n + 1))
    for _ in range(EPOCHS):
        shuffled = rng.permutation(n)
        for lo in range(0, n, BATCH):
            rows = shuffled[lo : lo + BATCH]
            size = bounds[rows + 1] - bounds[rows]
            r = np.repeat(np.arange(len(rows)), size)
            a = at[np.repeat(bounds[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            v = m["v"][a]
            s = _rows(v, r, len(rows))
            z = m["w0"] + _rows(m["w"][a], r, len(rows)) + 0.5 * (s**2 - _rows(v**2, r, len(rows))).sum(axis=1)
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            u, back = np.unique(a, return_inverse=True)
            dw = np.bincount(back, weights=d[r], minlength=len(u)) + 1e-5 * m["w"][u]
            each = d[r][:, None] * (s[r] - v)
            dv = np.stack([np.bincount(back, weights=each[:, f], minlength=len(u)) for f in range(FACTORS)], axis=1) + 1e-4 * m["v"][u]
            gw[u] += dw**2
            gv[u] += dv**2
            g0 += d.sum() ** 2
            m["w"][u] -= 0.1 * dw / np.sqrt(gw[u])
            m["v"][u] -= 0.05 * dv / np.sqrt(gv[u])
            m["w0"] -= 0.05 * d.sum() / np.sqrt(g0)
    return m


def _chi_square(df, hit, n, p):
    """Of a term in df of n rows, hit of them among the p with label 1."""
    expected = df * p / n
    variance = F.greatest(df * (p / n) * (1 - p / n) * (1 - df / n), F.lit(1e-9))
    return F.pow(F.greatest(F.abs(hit - expected) - 0.5, F.lit(0.0)), 2) / variance


def vocabulary(terms: DataFrame, rows: DataFrame) -> DataFrame:
    """(h) of the terms to learn: terms are (row, h), rows are (row, toxic)."""
    total = lambda t: t.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("p"))
    counted = lambda t, r: t.join(F.broadcast(r), "row").groupBy("h").agg(F.count("*").alias("df"), F.sum("toxic").alias("hit")).filter("df > 1").join(F.broadcast(total(r)))  # noqa: E731  SAMPLE_ROWS rows at most
    chi = _chi_square(F.col("df"), F.col("hit"), F.col("n"), F.col("p"))
    every = counted(terms, rows).withColumn("chi", chi)
    alone = every.filter((F.col("chi") > CHI_SQUARE) | (F.col("df") >= FREQUENT * F.col("n")))
    speaks = every.filter((F.col("chi") > CHI_SQUARE) & (F.col("hit") * F.col("n") > F.col("df") * F.col("p"))).select("h")
    beside = rows.join(terms.join(speaks, "h", "left_semi").select("row").distinct(), "row", "left_semi")
    return alone.select("h").unionAll(counted(terms, beside).filter(chi > CHI_SQUARE).select("h")).distinct()


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of the vocabulary's terms in at most `rows` labelled rows outside the held-out fold, and the rows' labels."""
    stash = Stash(docs.sparkSession, "toxicity")
    known = labels.filter(F.col("toxic").isin(0, 1) & ~is_held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Half as many again, since rows whose document is missing or empty go.
    known = known.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(rows + rows // 2)
    picked = docs.select("doc_id", F.lower("text").alias("text")).filter(F.length("text") > 0).join(F.broadcast(known), "doc_id")

    def run(parts):
        for whole in parts:
            for part in bytetext.batches(whole, "text"):
                doc, h = terms(*bytetext.flat(part.column("text")))
                key = np.unique(np.stack([doc.astype(np.uint64), h], axis=1), axis=0) if len(h) else np.zeros((0, 2), np.uint64)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(key[:, 0], np.arange(part.num_rows + 1)).astype(np.int32)), pa.array(np.ascontiguousarray(key[:, 1]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), part.column("text_hash"), lists], ["doc_id", "toxic", "text_hash", "terms"])

    made = picked.withColumn("text_hash", F.xxhash64("text")).select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text_hash", "text")
    made = stash.put(made.mapInArrow(run, "doc_id long, toxic int, text_hash long, terms array<long>"))
    chosen = made.groupBy("doc_id", "toxic").agg(F.min("text_hash").alias("text_hash")).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(rows)
    order = chosen.toArrow()  # SAMPLE_ROWS rows
    if not order.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    number = made.sparkSession.createDataFrame(order.append_column("row", pa.array(np.arange(order.num_rows))))
    each = made.join(F.broadcast(number.drop("toxic")), ["doc_id", "text_hash"]).dropDuplicates(["row"]).select("row", "toxic", "terms")
    each = stash.put(each)
    long = each.select("row", F.explode("terms").alias("h"))
    got = long.join(vocabulary(long, each.select("row", "toxic")), "h").select("row", "h").toArrow()
    return got.column("row").to_numpy(), got.column("h").to_numpy().view(np.uint64), order.column("toxic").to_numpy().astype(float)


def with_toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """docs plus score, the probability that the text is toxic, and predicted."""
    docs = docs.drop("score", "predicted").withColumn("_lower", F.lower("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != "_lower"]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(parts):
        m = held.value
        vocabulary = None if "constant" in m else Vocabulary(m["vocabulary"])
        for whole in parts:
            for part in bytetext.batches(whole, "_lower"):
                if vocabulary is None:
                    score = np.full(part.num_rows, m["constant"])
                else:
                    doc, at = vocabulary.distinct(*terms(*bytetext.flat(part.column("_lower"))))
                    score = 1 / (1 + np.exp(-np.clip(logits(m, doc, at, part.num_rows), -30, 30)))
                arrays = [part.column(c) for c in names] + [pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, [*names, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(*training_sample(docs, table(spark, sf_dir, "labels")))
    return with_toxicity(docs, model).select("doc_id", is_held_out("doc_id").alias("held_out"), "score", "predicted")
