"""Mixing sources to target weights.

Words are counted per source, targets are filled up to a cap on repetition, and every
document is emitted floor(rate) times plus once more by a seeded coin: a hash of the seed
and its id, below its source's limit. A hash is below the limit with the probability that is
the fraction of the rate, and among the hashes near it the limit is set where the words of
the documents below it come nearest to what the target lacks, so a source's taken words are
within half a document of its target. Limits come from sums of words by slices of the hash,
and from single documents in the one slice of a source that holds its limit; no source is
sorted as a whole. Reruns and retried tasks agree.

Defined cases: a null text has size 0; a null source is a source of its own, the last;
sources whose texts are all empty get target 0; rows that repeat a doc_id, and all rows with
a null one, share one coin and are taken together; an empty table gives an empty result; mix
returns the columns of docs as they are, whatever their names; with_copies replaces columns
that are named like its results. Targets are worked out in one task over one row a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Stash, small, table

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
SEED = "mix-1"
#: Bits of a coin, and of the slices of it that words are summed by.
COIN_BITS, SLICE_BITS = 52, 12


def n_words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, size) -> (source, source_size, target), one row per source.

    Targets are min(cap, level * weight) at the level where they sum to the total. Sources
    sorted by cap / weight fill up in that order, so the level follows from running sums.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.lit(float(max_repeats)) * F.col("source_size"))
    fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = W.partitionBy(F.lit(1))
    per = (
        per.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(fill.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("level_here", (F.col("total") - F.col("cap_before")) / F.col("weight_left"))
    )
    # Past the first source whose cap the level does not reach, levels only fall: the largest is that one's.
    level = F.max(F.when(F.col("level_here") * F.col("weight") <= F.col("cap"), F.col("level_here"))).over(everything)
    per = per.withColumn("level", level)
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return per.select("source", "source_size", target.alias("target"))


def coin(doc_id: Column | str, seed: str = SEED) -> Column:
    """A number of COIN_BITS bits fixed by the seed and the id."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, COIN_BITS // 4), 16, 10).cast("long")


def source_limits(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, size, coin) -> (source, source_size, target, whole, limit): whole copies of every document and one more up to the limit."""
    slices = sizes.groupBy("source", F.shiftright("coin", COIN_BITS - SLICE_BITS).alias("slice")).agg(F.sum("size").alias("size"))
    rate = F.least(F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)), F.lit(float(max_repeats)))
    per = source_targets(slices, weights, max_repeats).withColumn("whole", F.floor(rate)).withColumn("lacks", F.col("target") - F.col("whole") * F.col("source_size"))
    per = per.withColumnRenamed("source", "of")
    before = F.sum("size").over(W.partitionBy("source").orderBy("slice")) - F.col("size")
    at = slices.withColumn("before", before).join(small(per.select("of", "lacks")), F.col("source").eqNullSafe(F.col("of")))
    at = at.filter(F.col("before") + F.col("size") > F.col("lacks")).groupBy("of").agg(F.min(F.struct("slice", "before", "lacks")).alias("at")).select("of", "at.*")
    coins = sizes.join(small(at), F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("coin", COIN_BITS - SLICE_BITS) == F.col("slice")))
    coins = coins.groupBy("of", "slice", "before", "lacks", "coin").agg(F.sum("size").alias("size"))
    before = F.col("before") + F.sum("size").over(W.partitionBy("of").orderBy("coin")) - F.col("size")
    last = coins.withColumn("before", before).filter(F.col("lacks") - F.col("before") >= F.col("size") / 2).groupBy("of").agg(F.max("coin").alias("last"))
    limits = at.join(last.withColumnRenamed("of", "of_last"), F.col("of").eqNullSafe(F.col("of_last")), "left")
    limits = limits.select(F.col("of").alias("of_limit"), F.coalesce("last", F.shiftleft("slice", COIN_BITS - SLICE_BITS) - 1).alias("limit"))
    per = per.join(limits, F.col("of").eqNullSafe(F.col("of_limit")), "left")
    none = (F.col("lacks") <= 0) | (F.col("whole") >= max_repeats)  # whole copies reach the target, or the cap
    return per.select(F.col("of").alias("source"), "source_size", "target", "whole", F.when(none, F.lit(-1)).otherwise(F.coalesce("limit", F.lit(1 << COIN_BITS))).alias("limit"))


def _sizes(docs: DataFrame, seed: str) -> DataFrame:
    return docs.select("doc_id", "source", n_words("text").alias("size"), coin("doc_id", seed).alias("coin"))


def _limits(sizes: DataFrame, stash: Stash, weights: tuple[float, ...], max_repeats: int) -> DataFrame:
    per = stash.put(source_limits(sizes, weights, max_repeats))
    return small(per.select(F.col("source").alias("_source"), F.struct("source_size", "target", "whole", "limit").alias("_per")))


def _copies(coins: Column) -> Column:
    return (F.col("_per.whole") + (coins <= F.col("_per.limit")).cast("int")).cast("int")


def with_copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, text) -> doc_id, source, size, source_size, target, copies."""
    stash = Stash(docs.sparkSession, "mixing")
    sizes = stash.put(_sizes(docs, seed))
    made = sizes.join(_limits(sizes, stash, weights, max_repeats), F.col("source").eqNullSafe(F.col("_source")))
    return made.select("doc_id", "source", "size", "_per.source_size", "_per.target", _copies(F.col("coin")).alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """The mixed corpus: every document as often as its copies say, with docs' own columns."""
    stash = Stash(docs.sparkSession, "mixing")
    limits = _limits(stash.put(_sizes(docs, seed)), stash, weights, max_repeats)
    rows = docs.withColumn("_row", F.struct(*docs.columns)).select("_row").join(limits, F.col("_row.source").eqNullSafe(F.col("_source")))
    copies = _copies(coin("_row.doc_id", seed))
    rows = rows.withColumn("_copies", copies).select("_row", F.explode(F.expr("if(_copies > 0, sequence(1, _copies), array())")).alias("_copy"))
    return rows.select("_row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = with_copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return made.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS k FROM d GROUP BY source
), w AS (
  SELECT source, source_size, CASE k WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3.0::DOUBLE * source_size AS cap,
         CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s
), r AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here FROM w
), l AS (
  SELECT *, max(CASE WHEN here * weight <= cap THEN here END) OVER () AS lev FROM r
), t AS (
  SELECT source, source_size, CASE WHEN lev IS NULL THEN cap ELSE least(cap, lev * weight) END AS target FROM l
), c AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, floor(least(coalesce(t.target / nullif(t.source_size, 0), 0.0), 3.0::DOUBLE)) AS whole,
         CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) AS coin
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), u AS (
  SELECT source, coin, sum(size) AS size, any_value(target - whole * source_size) AS lacks FROM c GROUP BY source, coin
), k AS (
  SELECT source, max(coin) AS last FROM (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY coin) - size AS before FROM u) WHERE lacks - before >= size / 2 GROUP BY source
)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN coin <= last THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM c LEFT JOIN k ON c.source IS NOT DISTINCT FROM k.source
"""
