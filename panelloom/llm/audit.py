"""Filter interaction audit: what each filter of a chain removes, in every order of the filters.

A document fails some of the filters; which ones is its mask. Documents are counted by part
and mask, and all else follows from these cells, however many documents there are. Orders
are visited by adjacent transpositions ("plain changes"): each order differs from the one
before by a swap of two neighbours, so that only the two steps at the swap are counted anew,
from the cells. Each filter's Shapley sum gathers what it removes along the walk.

Documents with the same text are found by its SHA-256: the smallest doc_id of each digest is
a small aggregate, and a document is a copy unless (digest, doc_id) is in it, a join without
a hot key. Labels are joined by doc_id.

Defined cases: a null text is empty; a null part is the empty one; a null doc_id is neither
smaller nor larger than another, so it is no copy and makes none; rows that repeat a doc_id
count each, and aren't copies of each other; of labels that repeat a doc_id the largest
value counts, null labels are 0; a part without documents has no rows, so an empty table
gives none; other columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Stash, table

MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT, SYMBOLS = 200, 50, 2, r"[#$%&*|]"
#: Parts that one step of the walk holds; each has a row for every order and step.
PARTS_AT_ONCE = 128
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def plain_changes(n: int) -> Iterator[tuple[list[int], int | None]]:
    """All orders of n things, each with the place of the swap that made it from the one before."""
    order, step = list(range(n)), [-1] * n
    yield order.copy(), None
    while True:
        movable = [(x, i) for i, x in enumerate(order) if 0 <= i + step[x] < n and order[i + step[x]] < x]
        if not movable:
            return
        x, i = max(movable)
        j = i + step[x]
        order[i], order[j] = order[j], x
        for larger in range(x + 1, n):
            step[larger] = -step[larger]
        yield order.copy(), min(i, j)


def walk(docs: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of parts by mask, (parts, 2**n), to each measure by order and step, (parts, n!, n).

    Orders come as plain_changes gives them, under `order`, (n!, n).
    """
    n = docs.shape[1].bit_length() - 1
    masks = np.arange(1 << n)
    fails = [masks >> f & 1 == 1 for f in range(n)]
    total = docs.sum(axis=1)
    failing = np.stack([docs[:, fails[f]].sum(axis=1) for f in range(n)], axis=1)
    only = np.stack([docs[:, 1 << f] for f in range(n)], axis=1)
    removed, lost = (np.zeros((len(docs), n), np.int64) for _ in range(2))
    toxic_lost, shapley = np.zeros_like(removed), np.zeros_like(removed)

    def count(order: list[int], step: int) -> None:
        before = sum(1 << f for f in order[:step])
        at = fails[order[step]] & (masks & before == 0)
        removed[:, step], lost[:, step], toxic_lost[:, step] = docs[:, at].sum(axis=1), good[:, at].sum(axis=1), toxic[:, at].sum(axis=1)

    orders, found = [], {m: [] for m in MEASURES}
    for order, swap in plain_changes(n):
        for step in range(n) if swap is None else (swap, swap + 1):
            count(order, step)
        shapley[:, order] += removed
        orders.append(order)
        found["kept"].append(total[:, None] - np.cumsum(removed, axis=1))
        found["removed"].append(removed.copy())
        found["redundant"].append(failing[:, order] - removed)
        found["unique_fails"].append(only[:, order])
        found["good_lost"].append(lost.copy())
        found["toxic_lost"].append(toxic_lost.copy())
    found["shapley"] = [shapley[:, order] for order in orders]
    return {"order": np.array(orders)} | {m: np.stack(v, axis=1) for m, v in found.items()}


def with_mask(docs: DataFrame) -> DataFrame:
    """(doc_id, text, source) -> doc_id, part, digest and the mask of the filters A to D that look at one document."""
    out = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("_text"))
    out = out.withColumn("_words", F.expr(f"regexp_extract_all(_text, r'{WORD}', 0)"))
    fails: list[Column] = [
        F.size("_words") < MIN_WORDS,
        100 * F.size(F.array_distinct("_words")).cast("long") < MIN_DISTINCT_PERCENT * F.size("_words").cast("long"),
        100 * F.regexp_count("_text", F.lit("[A-Z]")).cast("long") > MAX_UPPER_PERCENT * F.length("_text").cast("long"),
        F.col("_text").rlike(SYMBOLS),
    ]
    mask = sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))
    return out.select("doc_id", "part", F.unhex(F.sha2("_text", 256)).alias("digest"), mask.alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, docs, good, toxic): documents by part and the filters A to E that they fail, E being copies."""
    rows = Stash(docs.sparkSession, "audit").put(with_mask(docs))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("_quality"), F.max("toxic").alias("_toxic"))
    copy = F.col("_first").isNull() & F.col("doc_id").isNotNull()
    marked = rows.join(first, ["digest", "doc_id"], "left").withColumn("mask", F.col("mask") + copy.cast("int") * 16)
    one = lambda c: F.coalesce((F.col(c) == 1).cast("long"), F.lit(0))
    return marked.join(known, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("docs"), F.sum(one("_quality")).alias("good"), F.sum(one("_toxic")).alias("toxic"))


def interactions(cells: DataFrame, names: str = "ABCDE") -> DataFrame:
    """(part, mask, docs, good, toxic) -> a row a part, order and step of the filters, bit i of a mask being names[i]."""
    n = len(names)

    def rows(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, PARTS_AT_ONCE):
                batch = whole.slice(lo, PARTS_AT_ONCE)
                counts = np.zeros((3, batch.num_rows, 1 << n), np.int64)
                for k, held in enumerate(batch.column("cells").to_pylist()):  # 2**n at most
                    for c in held:
                        counts[:, k, c["mask"]] = c["docs"], c["good"], c["toxic"]
                made = walk(*counts)
                orders = ["".join(names[f] for f in order) for order in made["order"]]
                parts = np.repeat(np.arange(batch.num_rows), len(orders) * n)
                columns = {"part": batch.column("part").take(pa.array(parts)), "filter_order": pa.array(np.tile(np.repeat(orders, n), batch.num_rows).tolist())}
                columns["step"] = pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), batch.num_rows * len(orders)))
                yield pa.RecordBatch.from_pydict(columns | {m: pa.array(made[m].ravel()) for m in MEASURES})

    per = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("cells"))
    return per.mapInArrow(rows, "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES))


def op13_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return interactions(cells(docs.select("doc_id", "text", "source"), labels))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(CAST(source AS VARCHAR), '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d
), lab AS (
  SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS good, CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS toxic,
         CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN first_id < w.doc_id THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN lab ON w.doc_id = lab.doc_id
), cell AS (
  SELECT part, fails, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, fails
), f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
  WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f
), s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)
), x AS (
  SELECT part, filter_order, step, f, docs, good, toxic, contains(fails, f) AS failing, fails = f AS only_this,
         before <> '' AND translate(fails, before, '') <> fails AS gone FROM cell, s
), r AS (
  SELECT part, filter_order, step, f, coalesce(sum(docs) FILTER (NOT gone AND NOT failing), 0) AS kept, coalesce(sum(docs) FILTER (failing AND NOT gone), 0) AS removed,
         coalesce(sum(docs) FILTER (failing AND gone), 0) AS redundant, coalesce(sum(docs) FILTER (only_this), 0) AS unique_fails,
         coalesce(sum(good) FILTER (failing AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (failing AND NOT gone), 0) AS toxic_lost
  FROM x GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""
