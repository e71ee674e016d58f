"""Means over all symbols, kept up to date by a stream of daily bars.

Each mean is held as a sum and a count, by week for the market and by industry and month for
momentum. A batch's bars change what its symbols contributed: what these contributed before
is taken out again and what they contribute now is put in, so late bars and corrections
count as if they had been there from the start. A symbol's bars, its contributions and the
sums are tables of Upserts, each of which takes a batch once; what a symbol contributed before
is read from the version before the batch, so a batch that is run again after a crash, in
whatever table it was lost, changes nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import bars, features
from ..sources.upsert import Upserts


def market(spark: SparkSession, store: str) -> DataFrame:
    """(week, market): the mean weekly return of all symbols."""
    return _mean(Upserts(spark, f"{store}/market", ("week",)).read(), ["week"], "market")


def industries(spark: SparkSession, store: str) -> DataFrame:
    """(sic2, month, indmom): the mean momentum of an industry's symbols."""
    return _mean(Upserts(spark, f"{store}/industry", ("sic2", "month")).read(), ["sic2", "month"], "indmom")


def _mean(sums: DataFrame, keys: list[str], name: str) -> DataFrame:
    return sums.select(*keys, F.try_divide(F.when(F.col("n") > 0, F.col("total")), F.col("n")).alias(name))


def maintain(stream: DataFrame, store: str, checkpoint: str, static: DataFrame, momentum: str = "mom12m", once: bool = True) -> StreamingQuery:
    """Keep the market's weekly returns and the industries' momentum up to date with a stream of (symbol, date, price, volume).

    Of a symbol and date the last batch's bar counts. static has (symbol, sic2); symbols
    without an industry count for the market alone.
    """
    of = lambda daily: features.with_momentum(bars.monthly_summary(bars.daily_returns(daily))).join(static.select("symbol", "sic2"), "symbol")
    writer = stream.writeStream.foreachBatch(lambda batch, number: _update(batch, number, store, of, momentum)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _update(batch: DataFrame, number: int, store: str, monthly: Callable[[DataFrame], DataFrame], momentum: str) -> None:
    spark = batch.sparkSession
    held = Upserts(spark, f"{store}/bars", ("symbol", "date"))
    version = held.upsert(batch, number)
    own = held.read_like(batch, version)
    if own is None:  # a batch without rows
        return
    _contribute(spark, store, "market", number, bars.weekly_returns(own).select("symbol", "week", F.col("ret").alias("value")), batch, ("week",))
    _contribute(spark, store, "industry", number, monthly(own).select("symbol", "month", "sic2", F.col(momentum).alias("value")), batch, ("sic2", "month"))


def _contribute(spark: SparkSession, store: str, name: str, number: int, now: DataFrame, batch: DataFrame, keys: tuple[str, ...]) -> None:
    """Put what the batch's symbols contribute now in place of what they did before the batch."""
    parts, sums = Upserts(spark, f"{store}/{name}_parts", ("symbol", *keys)), Upserts(spark, f"{store}/{name}", keys)
    old = parts.read_like(batch, parts.before(number))
    taken = parts.upsert(now, number)
    new = parts.read_like(batch, taken)
    signed = new.select(*keys, "value", F.lit(1).alias("sign"))
    if old is not None:
        signed = signed.unionByName(old.select(*keys, "value", F.lit(-1).alias("sign")))
    count = F.sum(F.when(F.col("value").isNotNull(), F.col("sign"))).cast("long")
    change = signed.groupBy(*keys).agg(F.coalesce(F.sum(F.col("value") * F.col("sign")), F.lit(0.0)).alias("total"), F.coalesce(count, F.lit(0)).alias("n"))
    add(sums, change, number)


def add(sums: Upserts, change: DataFrame, number: int) -> int:
    """The version of sums (keys, total, n) that has a batch's change added to what was held before it."""
    before, keys = sums.before(number), sums.keys
    if before:
        base = sums.read(before).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("total").alias("_total"), F.col("n").alias("_n"))
        on = [change[k].eqNullSafe(base[f"_{k}"]) for k in keys]
        change = change.join(base, on, "left").select(*keys, (F.col("total") + F.coalesce("_total", F.lit(0.0))).alias("total"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"))
    return sums.upsert(change, number)
