"""Rolling risk (mean return, beta, idiosyncratic volatility) kept up to date by a stream of daily bars.

A symbol's row in the store has its latest weeks, a window and some more, and the number of
older ones. A batch reads these rows rather than histories: bars change weekly returns, these
the market's sums, and from the first week that changed on every symbol's windows are made
anew. What a window ending at a week holds doesn't depend on later weeks, so earlier ones
stand. Bars that are later than a row reaches, and windows that begin before it, are served
from the log of weeks, for the symbols concerned alone.

Weeks, months and windows are logs with a folder a batch, symbols' rows and the market's sums
are Upserts; a batch that is run again, wherever it was lost, starts from what was held before
it and writes over its own folders.

Of a symbol and date the last batch's price counts, and in one batch the largest. Bars
without a symbol or a date count for nothing.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.periods import month_key, percent_return, week_start
from ..operators import features
from ..sources.upsert import Upserts
from . import aggregates
from .incremental import BUCKETS

#: Weeks of a window for beta, of one for the others, and those that a symbol's row has beyond the latter.
SHORT, LONG, SPARE = 52, 156, 26


def maintain(stream: DataFrame, store: str, checkpoint: str, long: int = LONG, short: int = SHORT, spare: int = SPARE, once: bool = True) -> StreamingQuery:
    """Keep the windows of every symbol's weeks up to date with a stream of (symbol, date, price)."""
    writer = stream.writeStream.foreachBatch(lambda batch, number: _update(batch, number, store, long, short, spare)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def risk(spark: SparkSession, store: str, stride: int = 4) -> DataFrame:
    """features.rolling_risk of all bars so far."""
    rolled = spark.read.parquet(f"{store}/rolled")
    # A batch has every week from its first on of each symbol that has one, so a batch's rows stand before the firsts of later ones.
    later = W.partitionBy(F.lit(0)).orderBy(F.desc("batch")).rowsBetween(W.unboundedPreceding, -1)  # a row a batch
    ends = rolled.groupBy("batch").agg(F.min("week").alias("_first")).select("batch", F.min("_first").over(later).alias("_end"))
    rolled = rolled.join(F.broadcast(ends), "batch").filter("_end is null or week < _end").select("symbol", "week", "mean", "beta", "idio")
    # A week's bars lie in the months of its first and last.
    ends = F.explode(F.array_distinct(F.array(F.trunc("first", "month"), F.trunc("date", "month"))))
    months = spark.read.parquet(f"{store}/weeks").select("symbol", "week", ends.alias("month")).groupBy("symbol", "month").agg(F.max("week").alias("latest_week"))
    return features.monthly_risk(months, rolled, stride).withColumn("month", month_key("month"))


def _bucket() -> Column:
    return F.pmod(F.xxhash64("symbol"), F.lit(BUCKETS)).cast("int")


def _week(w: Column, **more: Column) -> Column:
    return F.struct(*[w[k].alias(k) for k in ("week", "date", "close")], *[v.alias(k) for k, v in more.items()])


def _return(weeks: str, w: Column, i: Column) -> Column:
    """The return of the i-th of a symbol's weeks against the one before."""
    return percent_return(w["close"], F.get(weeks, i - 1)["close"])


def _history(spark: SparkSession, store: str, symbols: DataFrame, upto: int) -> DataFrame:
    """(symbol, older, weeks: of week, date, close, ret) of all weeks of some symbols, from the log."""
    there = [r[0] for r in symbols.select(_bucket()).distinct().collect()]  # BUCKETS at most
    log = spark.read.parquet(f"{store}/weeks").filter(F.col("bucket").isin(there) & (F.col("batch") <= upto)).join(symbols, "symbol", "left_semi")
    rows = log.groupBy("symbol", "week").agg(F.max(F.struct("date", "batch", "close")).alias("b")).select("symbol", F.struct("week", "b.date", "b.close").alias("w"))
    lists = rows.groupBy("symbol").agg(F.sort_array(F.collect_list("w")).alias("_w"))  # weeks are bounded by the calendar
    return lists.select("symbol", F.lit(0).alias("older"), F.transform("_w", lambda w, i: _week(w, ret=_return("_w", w, i))).alias("weeks"))


def _update(batch: DataFrame, number: int, store: str, long: int, short: int, spare: int) -> None:
    spark, log = batch.sparkSession, lambda name: f"{store}/{name}/batch={number}"
    bars = batch.filter("symbol is not null and date is not null").select(_bucket().alias("bucket"), "symbol", "date", "price").repartition("bucket")
    days = bars.groupBy("bucket", "symbol", "date").agg(F.max("price").alias("price"))
    news = days.groupBy("bucket", "symbol", week_start("date").alias("week")).agg(F.min("date").alias("first"), F.max("date").alias("date"), F.max_by("price", "date").alias("close"))
    news.write.mode("overwrite").partitionBy("bucket").parquet(log("weeks"))
    news = spark.read.schema(news.drop("bucket").schema).parquet(log("weeks"))
    if news.isEmpty():
        return
    held, sums = Upserts(spark, f"{store}/symbols", ("symbol",)), Upserts(spark, f"{store}/market", ("week",), buckets=1)  # a row a week
    _weeks_with(spark, news, number, store, held).write.mode("overwrite").parquet(f"{store}/changed")
    weeks = spark.read.parquet(f"{store}/changed")
    own = weeks.select("symbol", "older", F.transform("weeks", lambda w: _week(w, ret=w["ret"])).alias("weeks"), F.lit(number).alias("at"))
    extra = F.greatest(F.size("weeks") - (long + spare), F.lit(0))
    taken = held.upsert(own.withColumns({"older": F.col("older") + extra, "weeks": F.slice("weeks", extra + 1, F.size("weeks"))}), number)
    changed = weeks.select(F.inline("weeks")).filter(~F.col("known") | ~F.col("ret").eqNullSafe(F.col("before")))
    total = F.sum(F.coalesce("ret", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))
    n = F.sum(F.col("ret").isNotNull().cast("long") - F.col("before").isNotNull().cast("long"))
    changed.groupBy("week").agg(total.alias("total"), n.alias("n")).write.mode("overwrite").parquet(f"{store}/change")
    change = spark.read.parquet(f"{store}/change")
    version = aggregates.add(sums, change, number)
    first = change.agg(F.min("week")).first()[0]
    if first is not None:
        market = sums.read(version).select("week", F.try_divide(F.when(F.col("n") > 0, F.col("total")), F.col("n")).alias("market"))
        rows = own.unionByName(held.read(taken).filter(F.col("at") != number).select(*own.columns))
        rolled = features.rolled_histories(_weeks_from(spark, first, number, store, rows, long), market, long, short)
        rolled.filter(F.col("week") >= first).write.mode("overwrite").parquet(log("rolled"))


def _weeks_with(spark: SparkSession, news: DataFrame, number: int, store: str, held: Upserts) -> DataFrame:
    """(symbol, older, weeks) that news' symbols have in their rows (in the log where news reach beyond these), with news: also ret, known and before, its return before the batch."""
    lists = news.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("week", "date", "close"))).alias("_news"))  # weeks are bounded by the calendar
    fresh = F.transform("_news", lambda w: F.struct(w["week"].alias("week"), w["date"].alias("date"), F.lit(True).alias("new"), w["close"].alias("close"), F.lit(None).cast("double").alias("before")))
    own = held.read_near(news, held.before(number))
    if own is None:
        made = lists.select("symbol", F.lit(0).alias("older"), fresh.alias("_all"))
    else:
        own = own.select("symbol", "older", "weeks")
        earliest = own.filter("older > 0").join(news.groupBy("symbol").agg(F.min("week").alias("first")), "symbol")
        beyond = earliest.filter(F.col("first") <= F.col("weeks")[0]["week"]).select("symbol")
        if not beyond.isEmpty():
            own = own.join(beyond, "symbol", "left_anti").unionByName(_history(spark, store, beyond, number - 1))
        known = F.transform("weeks", lambda w: F.struct(w["week"].alias("week"), w["date"].alias("date"), F.lit(False).alias("new"), w["close"].alias("close"), w["ret"].alias("before")))
        both = F.when(F.col("weeks").isNull(), fresh).otherwise(F.sort_array(F.concat(known, fresh)))
        made = lists.join(own, "symbol", "left").select("symbol", F.coalesce("older", F.lit(0)).alias("older"), both.alias("_all"))

    def merged(w: Column, i: Column) -> Column:
        """A week as the last of its entries, one held or new or one of each, has it."""
        earlier, later = F.get("_all", i - 1), F.get("_all", i + 1)
        twice = F.coalesce(earlier["week"] == w["week"], F.lit(False))
        before = F.when(~w["new"], w["before"]).when(twice, earlier["before"])
        return _week(w, known=~w["new"] | twice, before=before, last=F.coalesce(later["week"] != w["week"], F.lit(True)))

    made = made.select("symbol", "older", F.filter(F.transform("_all", merged), lambda w: w["last"]).alias("_w"))
    # The first week of a row that has older ones keeps its return: it isn't news, or the log would have been read.
    ret = lambda w, i: F.when((i == 0) & (F.col("older") > 0), w["before"]).otherwise(_return("_w", w, i))
    return made.select("symbol", "older", F.transform("_w", lambda w, i: _week(w, ret=ret(w, i), known=w["known"], before=w["before"])).alias("weeks"))


def _weeks_from(spark: SparkSession, first: date, number: int, store: str, rows: DataFrame, long: int) -> DataFrame:
    """(symbol, older, weeks) of every symbol with a week from first on: these and the long - 1 weeks before."""
    rows = rows.filter(F.element_at("weeks", -1)["week"] >= first).withColumn("_before", F.size(F.filter("weeks", lambda w: w["week"] < first)))
    short = (F.col("older") > 0) & (F.col("_before") < long - 1)
    skip = F.greatest(F.col("_before") - (long - 1), F.lit(0))
    made = rows.filter(~short).select("symbol", (F.col("older") + skip).alias("older"), F.slice("weeks", skip + 1, F.size("weeks")).alias("weeks"))
    lacking = rows.filter(short).select("symbol")
    if not lacking.isEmpty():
        made = made.unionByName(_history(spark, store, lacking, number))
    return made
