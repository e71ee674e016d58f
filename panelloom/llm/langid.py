"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over fixed-length windows, each
filter's maximum over the window goes through a ReLU to a softmax. Training is plain numpy
on a bounded sample of labelled rows; prediction runs in Arrow batches. Windows overlap by
the widest filter less one byte, so every byte n-gram of the whole text is seen once. A
document's logits are the mean of its windows', weighted by their letters.

For prediction the embedding and the filters fold into tables over byte pairs: a filter's
response is a sum of two table rows.

Defined cases: a text that is null or has no letter is `und` with score 0, as is every
text if there is nothing to learn from; labels are used only where lang is not null; of
equal logits the first language by name counts; rows that repeat a document get one and the
same prediction each; a row with a null id is predicted, and held out of learning; an empty
table gives an empty result; extra columns pass through, those named like a result are
replaced by it (what else is needed on the way has names of its own).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytetext
from .common import is_held_out, small, table

WINDOW, WIDTHS, DIM, FILTERS = 256, (2, 3, 4), 8, 12
STRIDE = WINDOW - max(WIDTHS) + 1
#: Bounds of the training sample: labelled rows in all, windows a row.
SAMPLE_ROWS, WINDOWS_A_ROW = 3000, 3
EPOCHS, BATCH, SEED = 6, 64, 7
UNKNOWN = "und"


def training_sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, list[bytes]]]:
    """(lang, windows) of at most `rows` labelled rows outside the held-out fold, languages evenly."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~is_held_out("doc_id"))
    counts = known.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("_rows"))
    langs = counts.count()
    if not langs:
        return []
    known = known.join(small(counts), F.col("lang") == F.col("_lang"))
    rate = F.least(F.lit(1.0), F.lit(1.5 * rows / langs) / F.col("_rows"))
    order = F.xxhash64(F.lit(SEED), "doc_id")
    picked = known.filter(F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(1_000_000)) < rate * 1_000_000)
    at = lambda k: F.substring(F.col("text"), (F.length("text") * (k / WINDOWS_A_ROW)).cast("int") + 1, F.lit(WINDOW))
    picked = picked.select(order.alias("order"), "lang", F.array(*[at(k) for k in range(WINDOWS_A_ROW)]).alias("windows"))
    return [(r["lang"], [w.encode()[:WINDOW] for w in r["windows"] if w]) for r in picked.orderBy("order", "lang").limit(rows).collect()]


def _patches(x: np.ndarray, width: int) -> np.ndarray:
    n = WINDOW - max(WIDTHS) + 1
    return np.concatenate([x[:, k : k + n] for k in range(width)], axis=2)


def train(sample: list[tuple[str, list[bytes]]], seed: int = SEED) -> dict | None:
    """The network as arrays; None without a sample."""
    rows = [(lang, w) for lang, windows in sample for w in windows]
    if not rows:
        return None
    langs = sorted({lang for lang, _ in rows})
    y = np.array([langs.index(lang) for lang, _ in rows])
    x = np.zeros((len(rows), WINDOW), np.uint8)
    for i, (_, w) in enumerate(rows):
        x[i, : len(w)] = np.frombuffer(w, np.uint8)
    rng = np.random.default_rng(seed)
    p = {"emb": rng.normal(0, 0.3, (256, DIM)), "out": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))), "bias": np.zeros(len(langs)), "hidden": np.zeros(FILTERS * len(WIDTHS))}
    p |= {f"w{k}": rng.normal(0, 1 / np.sqrt(k * DIM), (k * DIM, FILTERS)) for k in WIDTHS}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first, second, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    weight = np.bincount(y, minlength=len(langs)).astype(np.float32)
    weight = weight.sum() / (len(langs) * np.maximum(weight, 1))
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), BATCH):
            xb, yb = x[order[lo : lo + BATCH]], y[order[lo : lo + BATCH]]
            b, e, g = len(xb), p["emb"][xb], {k: np.zeros_like(v) for k, v in p.items()}
            pooled, where, patches = [], [], []
            for k in WIDTHS:
                q = _patches(e, k)
                r = q @ p[f"w{k}"]
                m = r.argmax(axis=1)
                pooled.append(np.take_along_axis(r, m[:, None], 1)[:, 0])
                where.append(m)
                patches.append(q)
            h = np.concatenate(pooled, axis=1) + p["hidden"]
            a = np.maximum(h, 0)
            z = a @ p["out"] + p["bias"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(b), yb] -= 1
            z *= (weight[yb] / b)[:, None]
            g["out"], g["bias"] = a.T @ z, z.sum(axis=0)
            dh = (z @ p["out"].T) * (h > 0)
            g["hidden"] = dh.sum(axis=0)
            for i, k in enumerate(WIDTHS):
                d = dh[:, i * FILTERS : (i + 1) * FILTERS]
                best = np.take_along_axis(patches[i], where[i][:, :, None], 1)  # b, filters, k * DIM
                g[f"w{k}"] = np.einsum("bfd,bf->df", best, d)
                back = (d[:, :, None] * p[f"w{k}"].T[None]).reshape(b, FILTERS, k, DIM)
                at = where[i][:, :, None] + np.arange(k)
                np.add.at(g["emb"], xb[np.arange(b)[:, None, None], at].ravel(), back.reshape(-1, DIM))
            t += 1
            for k in p:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                p[k] -= 0.01 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return {"langs": langs, **p}


def folded(p: dict) -> tuple[np.ndarray, np.ndarray]:
    """Tables over byte pairs: responses at t are first[pair at t] + second[pair at t + 2] (second for widths 3 and 4)."""
    one = {k: [p["emb"] @ p[f"w{k}"][i * DIM : (i + 1) * DIM] for i in range(k)] for k in WIDTHS}
    pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
    none = np.zeros((256, FILTERS), np.float32)
    first = np.concatenate([pair(one[2][0], one[2][1]), pair(one[3][0], one[3][1]), pair(one[4][0], one[4][1])], axis=1)
    second = np.concatenate([pair(one[3][2], none), pair(one[4][2], one[4][3])], axis=1)
    return np.ascontiguousarray(first, np.float32), np.ascontiguousarray(second, np.float32)


def predict(p: dict, tables: tuple[np.ndarray, np.ndarray], data: np.ndarray, offsets: np.ndarray, chunk: int = 96) -> tuple[np.ndarray, np.ndarray]:
    """Class index and probability of every text; texts without bytes get class 0."""
    first, second = tables
    n, size = len(offsets) - 1, np.diff(offsets)
    count = np.maximum(1, -(-(size - (WINDOW - STRIDE)) // STRIDE))
    doc = np.repeat(np.arange(n), count)
    start = offsets[:-1][doc] + STRIDE * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
    stop = offsets[1:][doc]
    total, letters = np.zeros((n, len(p["langs"]))), np.zeros(n)
    span = np.arange(WINDOW)
    for lo in range(0, len(doc), chunk):
        at, end = start[lo : lo + chunk, None] + span, stop[lo : lo + chunk, None]
        x = np.where(at < end, data[np.minimum(at, len(data) - 1)], 0).astype(np.int32) if len(data) else np.zeros(at.shape, np.int32)
        pairs = (x[:, :-1] << 8) | x[:, 1:]
        r = first[pairs[:, :STRIDE]]
        r[:, :, FILTERS:] += second[pairs[:, 2 : STRIDE + 2]]
        z = np.maximum(r.max(axis=1) + p["hidden"], 0) @ p["out"] + p["bias"]
        weight = bytetext.LETTER_BYTES[x].sum(axis=1)
        rows = doc[lo : lo + chunk]
        np.add.at(total, rows, z * weight[:, None])
        np.add.at(letters, rows, weight)
    z = total / np.maximum(letters, 1)[:, None]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    z /= z.sum(axis=1, keepdims=True)
    best = z.argmax(axis=1)
    return best, z[np.arange(n), best]


def with_language(docs: DataFrame, model: dict | None, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs plus the language and its probability, under the names given."""
    spark = docs.sparkSession
    docs = docs.drop(pred, score).withColumn("_letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    if model is None:
        return docs.drop("_letter").withColumns({pred: F.lit(UNKNOWN), score: F.lit(0.0)})
    held = spark.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != "_letter"]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(parts):
        p = held.value
        tables = folded(p)
        for whole in parts:
            for part in bytetext.batches(whole, "text"):
                best, likely = predict(p, tables, *bytetext.flat(part.column("text")))
                letter = part.column("_letter").to_numpy(zero_copy_only=False).astype(bool)
                langs = np.where(letter, np.array(p["langs"], object)[best], UNKNOWN)
                arrays = [part.column(c) for c in names] + [pa.array(langs, pa.string()), pa.array(np.where(letter, likely, 0.0))]
                yield pa.RecordBatch.from_arrays(arrays, [*names, pred, score])

    return docs.mapInArrow(run, schema)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(training_sample(docs.select("doc_id", "text", "lang")))
    made = with_language(docs.select("doc_id", "text"), model)
    return made.select("doc_id", is_held_out("doc_id").alias("held_out"), "lang_pred", "score")
