"""Characteristics of a symbol's months: momentum, liquidity, aggregates, risk and ratios.

Lags and frames count the months that are there, not calendar months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.periods import month_key, percent_return
from ..functions.windows import by_months
from .rolling import rolled


def _lag(c: str, n: int) -> Column:
    return F.col(c) if n == 0 else F.lag(c, n).over(by_months())


def momentum(start: int, end: int, price: str = "close") -> Column:
    """Percent change from `end` months back to `start` months back."""
    return percent_return(_lag(price, start), _lag(price, end))


def with_momentum(monthly: DataFrame) -> DataFrame:
    return monthly.withColumns(
        {
            "mom1m": momentum(0, 1), "mom12m": momentum(1, 12), "mom12m_current": momentum(0, 12), "mom36m": momentum(12, 36),
            "chmom": momentum(1, 6) - momentum(7, 12), "chmom_current": momentum(0, 6) - momentum(6, 12),
            "maxret": _lag("max_ret", 1), "maxret_current": F.col("max_ret"),
        }
    )


def _log(c: Column) -> Column:
    return F.ln(F.when(c > 0, c))


def with_liquidity(monthly: DataFrame) -> DataFrame:
    three = by_months().rowsBetween(-2, 0)
    turnover = F.col("volume") / F.nullif("shares", F.lit(0.0))
    first = F.row_number().over(by_months()) == 1
    adjusted = F.when(turnover == 0, F.col("zero_days").cast("double")).otherwise((F.col("zero_days") + 1 / F.nullif(turnover, F.lit(0.0))) * (21 / F.col("days")))
    return monthly.withColumns(
        {
            "turn": F.when(F.count("*").over(three) == 3, F.avg("volume").over(three)) / F.nullif("shares", F.lit(0.0)),
            "std_turn": F.col("turnover_std"),
            "mve": _log(_lag("market_cap", 1)), "mve_current": _log(F.col("market_cap")),
            "dolvol": F.when(_lag("dollar_volume", 2) == 0, F.lit(0.0)).otherwise(_log(_lag("dollar_volume", 2))),
            "dolvol_current": F.when(F.col("dollar_volume") == 0, F.lit(0.0)).otherwise(_log(F.col("dollar_volume"))),
            "ill": F.col("illiquidity"), "retvol": F.col("ret_std"), "zerotrade": F.when(~first, adjusted),
        }
    )


def market_returns(weekly: DataFrame) -> DataFrame:
    """(week, market): the mean return of all symbols."""
    return weekly.groupBy("week").agg(F.avg("ret").alias("market"))


def valid_weeks(weekly: DataFrame, valid_months: DataFrame, month_weeks: DataFrame) -> DataFrame:
    """weekly with ret null in weeks that touch no valid month of the symbol."""
    valid = valid_months.select("symbol", "month").distinct().join(F.broadcast(month_weeks), "month").select("symbol", "week").distinct().withColumn("_valid", F.lit(True))
    return weekly.join(valid, ["symbol", "week"], "left").withColumn("ret", F.when(F.col("_valid"), F.col("ret"))).drop("_valid")


def industry_momentum(monthly: DataFrame, static: DataFrame, of: str = "mom12m_current", name: str = "indmom") -> DataFrame:
    """(sic2, month, indmom): the mean momentum of the industry's symbols."""
    return monthly.join(static.select("symbol", "sic2"), "symbol").groupBy("sic2", "month").agg(F.avg(of).alias(name))


def _rolled_lists(weekly: DataFrame, market: DataFrame, long: int, short: int) -> DataFrame:
    """(symbol, weeks): a symbol's weeks in order, each with mean, beta and idio; weeks are bounded by the calendar.

    A frame in SQL goes over its window anew at each row, one value at a time, so windows are laid out in arrays.
    """
    older = F.col("older") if "older" in weekly.columns else F.lit(0)
    base = weekly.select("symbol", "week", "ret", older.cast("long").alias("older")).join(F.broadcast(market), "week", "left")  # a row a week
    lists = base.groupBy("symbol").agg(F.max("older").alias("older"), F.sort_array(F.collect_list(F.struct("week", "ret", "market"))).alias("w"))
    return _rolled(lists, weekly.schema["week"].dataType.simpleString(), long, short)


def _rolled(lists: DataFrame, kind: str, long: int, short: int) -> DataFrame:
    return lists.mapInArrow(lambda batches: rolled(batches, long, short), f"symbol string, weeks array<struct<week: {kind}, mean: double, beta: double, idio: double>>")


def rolled_weeks(weekly: DataFrame, market: DataFrame, long: int = 156, short: int = 52) -> DataFrame:
    """(symbol, week, mean, beta, idio) over the weeks up to each week; null unless the symbol has a week before the window.

    Beta is the sample covariance over the population variance, of short weeks that all have
    both returns; idio is the deviation of the residuals of a regression over long weeks that
    all have both returns, null where the market doesn't move. Where weekly has older, so many
    of the symbol's weeks come before its rows; windows that reach beyond the rows are null.
    """
    return _rolled_lists(weekly, market, long, short).select("symbol", F.inline("weeks"))


def rolled_histories(rows: DataFrame, market: DataFrame, long: int = 156, short: int = 52) -> DataFrame:
    """rolled_weeks of (symbol, older, weeks: in order, with week and ret), weeks being Mondays: the market is looked up by the calendar, no week is a row."""
    span = market.agg(F.min("week").alias("lo"), F.max("week").alias("hi"))
    calendar = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 7 days"))).alias("week")).join(market, "week", "left")
    calendar = calendar.agg(F.min("week").alias("_monday"), F.sort_array(F.collect_list(F.struct("week", "market"))).alias("_market"))  # one row
    at = lambda w: F.get("_market", (F.datediff(w["week"], F.col("_monday")) / 7).cast("int"))["market"]
    lists = F.transform("weeks", lambda w: F.struct(w["week"].alias("week"), w["ret"].alias("ret"), at(w).alias("market")))
    lists = rows.crossJoin(F.broadcast(calendar)).select("symbol", F.col("older").cast("long").alias("older"), lists.alias("w"))
    return _rolled(lists, "date", long, short).select("symbol", F.inline("weeks"))


def monthly_risk(months: DataFrame, rolled: DataFrame, stride: int = 4) -> DataFrame:
    """(symbol, month) with rolling_return, beta, betasq and idiovol, lagged and current, from months (symbol, month, latest_week) and rolled_weeks.

    Month i, latest first, has the window that ends stride * i weeks before w0, w0 being the
    latest week of the month before the latest (of the latest itself if current).
    """
    weeks = rolled.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("week", "mean", "beta", "idio")), asc=False).alias("_weeks"))
    return _of_months(months, weeks, stride)


def _of_months(months: DataFrame, weeks: DataFrame, stride: int, along: tuple[str, ...] = ()) -> DataFrame:
    # A symbol's weeks and months are bounded by the calendar; both lie in one row, latest first, so a month's week is a place.
    held = months.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("month", "latest_week", *along)), asc=False).alias("_months"))
    place = lambda k: F.nullif(F.array_position("_weeks.week", F.get("_months", F.lit(k))["latest_week"]), F.lit(0)) - 1
    both = held.join(weeks, "symbol", "left").withColumns({"_lagged": place(1).cast("int"), "_current": place(0).cast("int")})
    at = lambda c, i: F.get("_weeks", F.col(c) + stride * i)
    out = both.select("symbol", F.explode(F.transform("_months", lambda x, i: F.struct(x.alias("own"), at("_lagged", i).alias("lag"), at("_current", i).alias("now")))).alias("r"))
    out = out.select("symbol", *[F.col(f"r.own.{c}") for c in ("month", *along)], *[F.col(f"r.{k}.{c}").alias(name + end) for k, end in (("lag", ""), ("now", "_current")) for c, name in (("mean", "rolling_return"), ("beta", "beta"), ("idio", "idiovol"))])
    return out.withColumns({"betasq": F.col("beta") * F.col("beta"), "betasq_current": F.col("beta_current") * F.col("beta_current")})


def rolling_risk(monthly: DataFrame, weekly: DataFrame, market: DataFrame, long: int = 156, short: int = 52, stride: int = 4, along: tuple[str, ...] = ()) -> DataFrame:
    """monthly_risk of the rolled weeks of whole histories; columns of the months that go along needn't be joined again."""
    weeks = _rolled_lists(weekly, market, long, short).select("symbol", F.reverse("weeks").alias("_weeks"))
    return _of_months(monthly, weeks, stride, along)


def as_of_cap(statements: DataFrame, caps: DataFrame) -> DataFrame:
    """statements plus cap: the market cap of the date, else the mean of the nearest before and after, else the nearest before; 0 is null.

    caps has one row for each symbol and date.
    """
    # Between two dates on which any symbol has a statement only a symbol's first and last cap can be nearest, so no caps are sorted but these.
    ends = statements.select("date").filter("date is not null").distinct()
    days = ends.select("date", F.date_add(F.lag("date").over(W.orderBy("date")), 1).alias("_from")).filter("_from is not null")  # bounded by the calendar, as is what comes of it
    days = F.broadcast(days.select(F.explode(F.sequence("_from", "date")).alias("date"), F.col("date").alias("_end")))
    after = caps.select("symbol", "date", "market_cap").join(F.broadcast(ends.agg(F.min("date").alias("_first")))).join(days, "date", "left")  # one row, a row a day
    spans = after.filter("date is not null").groupBy("symbol", F.when(F.col("date") <= F.col("_first"), F.col("_first")).otherwise(F.col("_end")).alias("_end")).agg(
        F.min("date").alias("_from"), F.min_by("market_cap", "date").alias("_early"), F.max("date").alias("_at"), F.max_by("market_cap", "date").alias("market_cap")
    )
    by = W.partitionBy("symbol")
    later = F.lead(F.struct(F.col("_from").alias("_at"), F.col("_early").alias("market_cap"))).over(by.orderBy("_at"))
    caps = spans.select("symbol", F.col("_at").alias("date"), F.lit(0).alias("_kind"), F.struct(F.struct("_at", "market_cap").alias("lo"), later.alias("hi")).alias("_cap"))
    rows = statements.select("symbol", "date", F.lit(1).alias("_kind"), F.struct(*statements.columns).alias("_s")).unionByName(caps, allowMissingColumns=True)
    rows = rows.withColumn("_near", F.last("_cap", ignorenulls=True).over(by.orderBy("date", "_kind")))
    lo, hi = F.col("_near.lo.market_cap"), F.col("_near.hi.market_cap")
    value = F.when(F.col("_near").isNull(), F.lit(None)).when(F.col("_near.lo._at") == F.col("date"), lo).when(F.col("_near.hi").isNull(), lo).otherwise((lo + hi) / 2)
    return rows.filter("_kind = 1").select("_s.*", F.nullif(value, F.lit(0.0)).alias("cap"))


def _by_filing(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each symbol, freq and filing month: the statement with the latest date. Statements without a filing date have no month and go."""
    latest = F.row_number().over(W.partitionBy("symbol", "freq", "month").orderBy(F.desc("date")))
    return rows.withColumn("month", month_key("filing_date")).filter("month is not null").withColumn("_n", latest).filter("_n = 1").select("symbol", "freq", "month", *columns)


def earnings_and_sales(statements: DataFrame, caps: DataFrame) -> DataFrame:
    rows = as_of_cap(statements.select("symbol", "freq", "date", "filing_date", "revenue", "net_income"), caps)
    return _by_filing(rows.withColumns({"ep": F.col("net_income") / F.col("cap"), "sp": F.col("revenue") / F.col("cap")}), ["ep", "sp"])


def _with_growth(statements: DataFrame) -> DataFrame:
    by = W.partitionBy("symbol", "freq")
    rows = statements.withColumn("agr", percent_return(F.col("total_assets"), F.lag("total_assets").over(by.orderBy("date"))))
    oldest = F.first("filing_date").over(by.orderBy("date"))
    return rows.withColumn("agr", F.when(~month_key("filing_date").eqNullSafe(month_key(oldest)), F.col("agr")))


def asset_growth(statements: DataFrame) -> DataFrame:
    """agr by filing month; null in the month in which the oldest statement was filed."""
    return _by_filing(_with_growth(statements), ["agr"])


def filed_ratios(statements: DataFrame, caps: DataFrame) -> DataFrame:
    """earnings_and_sales with asset_growth, of the same statements in one pass."""
    rows = as_of_cap(_with_growth(statements).select("symbol", "freq", "date", "filing_date", "revenue", "net_income", "agr"), caps)
    return _by_filing(rows.withColumns({"ep": F.col("net_income") / F.col("cap"), "sp": F.col("revenue") / F.col("cap")}), ["ep", "sp", "agr"])
