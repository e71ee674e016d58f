"""Daily bars to months and weeks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.periods import month_key, percent_return, week_key, week_start
from ..functions.windows import by_days, by_weeks



def daily_returns(bars: DataFrame) -> DataFrame:
    """bars plus month, week and ret, the percent change from the symbol's last bar."""
    return bars.withColumns({"month": month_key("date"), "week": week_key("date"), "ret": percent_return(F.col("price"), F.lag("price").over(by_days()))})


def monthly_summary(daily: DataFrame, week: Callable[[str], Column] = week_key) -> DataFrame:
    """A row for each symbol and month with a bar. One aggregation; shares and market caps join it where daily has them.

    Groups and latest weeks are dates until bars have become months: text in either costs a sort of all bars.
    latest_week is of the kind that `week` gives.
    """
    money = F.col("price") * F.col("volume")
    out = {
        "close": F.max_by("price", "date"), "dollar_volume": F.sum(money), "volume": F.sum("volume"), "days": F.count("*"), "zero_days": F.count_if(F.col("volume") == 0),
        "max_ret": F.max("ret"), "latest_week": F.max("date"), "ret_std": F.stddev_pop("ret"), "illiquidity": F.avg(F.abs("ret") / F.nullif(money, F.lit(0.0))),
    }
    if "shares" in daily.columns:
        turnover = F.when(F.col("shares") != 0, F.col("volume") / F.nullif("shares", F.lit(0.0)))
        out |= {"shares": F.max_by("shares", "date"), "turnover_std": F.stddev_samp(turnover)}
    if "market_cap" in daily.columns:
        out["market_cap"] = F.max_by("market_cap", "date")
    made = daily.groupBy("symbol", F.trunc("date", "month").alias("_month")).agg(*[v.alias(k) for k, v in out.items()])
    return made.select("symbol", month_key("_month").alias("month"), *[week(k).alias(k) if k == "latest_week" else k for k in out])


def monthly_return_list(daily: DataFrame) -> DataFrame:
    """(symbol, month, returns): the month's daily returns by date, possibly none."""
    pairs = F.array_sort(F.collect_list(F.when(F.col("ret").isNotNull(), F.struct("date", "ret"))))
    return daily.groupBy("symbol", "month").agg(F.transform(pairs, lambda x: x["ret"]).alias("returns"))


def weekly_returns(bars: DataFrame, week: Callable[[str], Column] = week_key) -> DataFrame:
    """(symbol, week, close, first, last, ret): ret against the symbol's last week with a bar; first and last are the week's dates with one."""
    weeks = bars.groupBy("symbol", week_start("date").alias("week")).agg(F.max_by("price", "date").alias("close"), F.min("date").alias("first"), F.max("date").alias("last"))
    made = weeks.withColumn("ret", percent_return(F.col("close"), F.lag("close").over(by_weeks())))
    return made if week is week_start else made.withColumn("week", week("week"))


def latest_weeks(weekly: DataFrame) -> DataFrame:
    """(symbol, month, latest_week) from weekly returns: a week's bars lie in the months of its first and last."""
    months = weekly.select("symbol", "week", F.explode(F.array(F.trunc("first", "month"), F.trunc("last", "month"))).alias("_month"))
    return months.groupBy("symbol", "_month").agg(F.max("week").alias("latest_week")).select("symbol", month_key("_month").alias("month"), "latest_week")


def indexed(rows: DataFrame, period: str, index: str, size: str | None = None) -> DataFrame:
    """rows plus their 0-based place in the symbol's periods, latest first, and their number."""
    by = W.partitionBy("symbol")
    out = rows.withColumn(index, F.row_number().over(by.orderBy(F.desc(period))) - 1)
    return out if size is None else out.withColumn(size, F.count("*").over(by))
