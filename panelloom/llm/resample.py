"""Target-distribution importance resampling.

Documents are drawn so that their words are spread as in a target text collection: a text's
features are its runs of one and two words, each in one of `buckets` buckets by CRC-32. The
logarithm of how much more often a bucket occurs in the target than in the source is its
gain, a text's weight is the mean gain of its features, and the highest sums of weight and
Gumbel noise are drawn, which samples without replacement by weight.

Identical texts are collapsed first, by grouping on the full text: features are found once a
text and written as their buckets, two bytes each; a text's counts are multiplied by its
number of copies; its weight is worked out once and joined back to its copies by the text's
SHA-256, before each document gets the noise of its own doc_id. Texts with a large share of
all documents, few by that, are joined by broadcast. Scores are whole numbers in a range that
the logarithms bound (some 100,000 of them), so ranks follow from the number of documents a
score and from places among documents of one score; no window spans the table.

Defined cases: null and empty texts, and those without a word, have no features and weight
0; a null doc_id has the noise of the word null, and comes after others in ties; rows that
repeat a doc_id are drawn each on its own, ties among them going to fewer features, then to
lesser weight; empty tables of documents or of the target are counted as 0 features; other
columns are left aside by ranked and kept by drawn. Memory follows the longest text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bytetext
from .common import Stash, arrow_limits, join_by_share, large_shares, table

BUCKETS, PERCENT, MIN_WORDS, SEED = 10_000, 25, 20, "7"
#: Bytes of the words: digits, letters and whatever isn't ASCII.
INSIDE = np.zeros(256, bool)
INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Words of more bytes are summed one by one.
SHORT = 64


def _step(c: np.ndarray) -> np.ndarray:
    """CRC-32 states after a zero byte."""
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ np.where(c & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return c


BYTE = _step(np.arange(256, dtype=np.uint32))
#: States after n zero bytes, by n and each of their four bytes: SHIFT[n, k, v] is that of v << 8k.
SHIFT = np.zeros((SHORT + 1, 4, 256), np.uint32)
SHIFT[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
for _n in range(SHORT):
    SHIFT[_n + 1] = BYTE[SHIFT[_n] & 255] ^ (SHIFT[_n] >> np.uint32(8))
SPACE = np.uint32(zlib.crc32(b" "))


def crcs(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of the data."""
    order = np.argsort(-size, kind="stable")
    at, n = begin[order], size[order]
    state = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for k in range(min(int(n[0]), SHORT) if len(n) else 0):
        m = int(np.searchsorted(-n, -k, "left"))  # spans of more than k bytes
        state[:m] = BYTE[(state[:m] ^ data[at[:m] + k]) & np.uint32(255)] ^ (state[:m] >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(size > SHORT).tolist():
        out[k] = zlib.crc32(data[begin[k] + SHORT : begin[k] + size[k]].tobytes(), int(out[k]))
    return out


def joined(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of one span, a space and another, from theirs; no second span has more than SHORT bytes."""
    head = SHIFT[1, 0, first & 255] ^ (first >> np.uint32(8)) ^ SPACE
    out = second.copy()
    for k in range(4):
        out ^= SHIFT[size, k, (head >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By slab: the text of each feature and its bucket, and the text of each word."""
    last = None
    for lo, hi, i, j in bytetext._slabs(data, offsets, INSIDE):
        part, starts = bytetext.LOWER[data[lo:hi]], offsets[i : j + 1] - lo
        word = np.zeros(len(part) + 2, bool)
        word[1:-1] = INSIDE[part]
        first = np.zeros(len(part) + 1, bool)
        first[starts[(starts >= 0) & (starts <= len(part))]] = True
        begin = np.flatnonzero(word[1:-1] & (~word[:-2] | first[:-1]))
        size = np.flatnonzero(word[1:-1] & (~word[2:] | first[1:])) + 1 - begin
        doc, crc = np.searchsorted(starts, begin, "right") - 1 + i, crcs(part, begin, size)
        if not len(doc):
            last = last if lo > offsets[i] else None
            continue
        before = np.concatenate([[last if last is not None and lo > offsets[i] else 0], crc[:-1]]).astype(np.uint32)
        follows = np.concatenate([[last is not None and lo > offsets[i]], doc[1:] == doc[:-1]])
        last = crc[-1] if hi < offsets[j] else None  # the text goes on in the next slab
        pair = np.flatnonzero(follows)
        both = joined(before[pair], crc[pair], np.minimum(size[pair], SHORT))
        for k in np.flatnonzero(size[pair] > SHORT).tolist():
            a, n = int(begin[pair[k]]), int(size[pair[k]])
            both[k] = zlib.crc32(part[a : a + n].tobytes(), zlib.crc32(b" ", int(before[pair[k]])))
        yield np.concatenate([doc, doc[pair]]), (np.concatenate([crc, both]) % np.uint32(buckets)).astype("<u2"), doc


def collapsed(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(text) -> (key, copies, n_words, features), a row a different text; features holds 16-bit buckets."""

    def found(batches):
        for whole in batches:
            for part in bytetext.batches(whole, "text", 2 * bytetext.SLAB):
                made = list(features(*bytetext.flat(part.column("text")), buckets))
                doc, at, words = (np.concatenate([m[k] for m in made]) if made else np.zeros(0, t) for k, t in enumerate((np.int64, "<u2", np.int64)))
                at = at[np.argsort(doc, kind="stable")]
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=part.num_rows))]) * 2
                held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(at)]).cast(pa.binary())
                n = pa.array(np.bincount(words, minlength=part.num_rows))
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("copies"), n, held], ["key", "copies", "n_words", "features"])

    arrow_limits(texts.sparkSession)
    per = texts.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.count("*").alias("copies"))
    return per.select(F.unhex(F.sha2("text", 256)).alias("key"), "copies", "text").mapInArrow(found, "key binary, copies long, n_words long, features binary")


def _buckets_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a batch, and where each text's begin and end."""
    data, offsets = bytetext.flat(batch.column("features"))
    return data[offsets[0] : offsets[-1]].view("<u2"), (offsets - offsets[0]) // 2


def histogram(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all copies by bucket."""

    def counted(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            at, ends = _buckets_of(batch)
            total += np.bincount(at, np.repeat(batch.column("copies").to_numpy(), np.diff(ends)), buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("copies", "features").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of the smoothed ratio, by bucket."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    ratio = (target + 1.0) * float(s + n) / ((source + 1.0) * float(t + n))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def weighed(texts: DataFrame, gain: np.ndarray) -> DataFrame:
    """(key, copies, n_words, n_features, weight): the mean gain of each text's features."""

    def mean(batches):
        for batch in batches:
            at, ends = _buckets_of(batch)
            sums, n = np.concatenate([[0], np.cumsum(gain[at])]), np.diff(ends)
            weight = (sums[ends[1:]] - sums[ends[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("key", "copies", "n_words")), pa.array(n), pa.array(weight)], ["key", "copies", "n_words", "n_features", "weight"])

    return texts.mapInArrow(mean, "key binary, copies long, n_words long, n_features long, weight long")


def _noise(seed: str):
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, text), (text) -> doc_id, key, n_words, n_features, weight, score and the rank of those drawn."""
    stash = Stash(docs.sparkSession, "resample")
    texts = stash.put(collapsed(docs.select("text"), buckets))
    gain = gains(histogram(texts, buckets), histogram(collapsed(target.select("text"), buckets), buckets))
    weights = stash.put(weighed(texts, gain))
    stash.drop(texts)
    keys = stash.put(docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("key")))
    scored = join_by_share(keys, weights, "key", large_shares(weights, "key", "copies"))
    scored = stash.put(scored.select("doc_id", "key", "n_words", "n_features", "weight", (F.col("weight") + _noise(seed)).alias("score")))
    long_enough = F.col("n_words") >= min_words
    per = stash.put(scored.filter(long_enough).groupBy("score").agg(F.count("*").alias("n")))
    most = percent * (per.agg(F.sum("n")).first()[0] or 0) // 100
    before = F.sum("n").over(W.partitionBy(F.lit(0)).orderBy(F.desc("score"))) - F.col("n")  # a row a score
    top = per.select("score", before.alias("before")).filter(F.col("before") < most)
    at = scored.join(F.broadcast(top), "score", "left").withColumn("before", F.when(long_enough, F.col("before")))  # some 100,000 rows at most
    place = F.row_number().over(W.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight"))
    drawn = at.filter("before is not null").withColumn("rank", F.col("before") + place)
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    rest = at.filter("before is null").withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(*scored.columns, "rank")


def drawn(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The documents that are drawn, with their own columns; rows that repeat a doc_id and text come together."""
    picked = ranked(docs, target, **how).filter("rank is not null").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    on = F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.unhex(F.sha2(F.coalesce("_row.text", F.lit("")), 256)) == F.col("_key"))
    return rows.join(picked, on, "left_semi").select("_row.*")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return made.select("doc_id", "n_features", "weight", "score", "rank")


SQL = r"""
WITH RECURSIVE byte AS (
  SELECT CAST(b AS BIGINT) AS b, CAST(b AS BIGINT) AS v, 0 AS i FROM range(256) r(b)
  UNION ALL SELECT b, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i + 1 FROM byte WHERE i < 8
), t0 AS (
  SELECT b, v FROM byte WHERE i = 8
), both_tables AS (
  SELECT 'd' AS kind, doc_id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark
), d AS (
  SELECT row_number() OVER () AS rid, kind, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM both_tables
), w AS (
  SELECT rid, ws[i] AS a, ws[i + 1] AS b FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)
), f AS (
  SELECT rid, a AS f FROM w UNION ALL SELECT rid, a || ' ' || b FROM w WHERE b IS NOT NULL
), u AS (
  SELECT f, hex(f) AS h, CAST(strlen(f) AS BIGINT) AS n FROM (SELECT DISTINCT f FROM f)
), shift AS (
  SELECT CAST(0 AS BIGINT) AS far, b, v FROM t0
  UNION ALL SELECT far + 1, s.b, xor(t0.v, s.v >> 8) FROM shift s JOIN t0 ON s.v & 255 = t0.b WHERE far + 1 < (SELECT max(n) FROM u)
), zero AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST(4294967295 AS BIGINT) AS v
  UNION ALL SELECT n + 1, xor(t0.v, z.v >> 8) FROM zero z JOIN t0 ON z.v & 255 = t0.b WHERE n < (SELECT max(n) FROM u)
), x AS (
  SELECT f, n, n - 1 - i AS far, CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) AS b FROM (SELECT f, h, n, unnest(range(n)) AS i FROM u)
), c AS (
  SELECT f, xor(xor(bit_xor(shift.v), any_value(zero.v)), 4294967295) % 10000 AS bucket
  FROM x JOIN shift ON x.far = shift.far AND x.b = shift.b JOIN zero ON x.n = zero.n GROUP BY f
), k AS (
  SELECT f.rid, kind, bucket, count(*) AS n FROM f JOIN c ON f.f = c.f JOIN d ON f.rid = d.rid GROUP BY f.rid, kind, bucket
), per AS (
  SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0) AS s, coalesce(sum(n) FILTER (kind = 'b'), 0) AS t FROM k GROUP BY bucket
), g AS (
  SELECT bucket, CAST(floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain FROM per
), m AS (
  SELECT rid, sum(k.n) AS n, CAST(floor(sum(k.n * gain)::DOUBLE / sum(k.n)::DOUBLE) AS BIGINT) AS weight FROM k JOIN g ON k.bucket = g.bucket GROUP BY rid
), e AS (
  SELECT doc_id, len(ws) AS n_words, CAST(coalesce(m.n, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN m ON d.rid = m.rid WHERE kind = 'd'
), o AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS r, count(*) FILTER (n_words >= 20) OVER () AS eligible FROM e
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 25 * eligible // 100 THEN r END AS rank FROM o
"""
