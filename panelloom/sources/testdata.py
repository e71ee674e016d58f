"""The order tables seen as market data: suppliers are symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, key: str = "l_suppkey") -> DataFrame:
    """Daily price (mean price of a unit) and volume (units); key l_partkey gives sparse series."""
    rows = read(spark, sf_dir, "lineitem").select(F.col(key).cast("string").alias("symbol"), F.to_date("l_shipdate").alias("date"), "l_quantity", "l_extendedprice")
    # Lines are dealt by symbol once, which serves sums by date and what follows by month, week or symbol.
    sums = rows.repartition("symbol").groupBy("symbol", "date").agg(F.sum("l_extendedprice").alias("p"), F.sum("l_quantity").alias("volume"))
    return sums.select("symbol", "date", (F.col("p") / F.col("volume")).alias("price"), "volume")


def with_shares(bars: DataFrame) -> DataFrame:
    """bars plus shares (units so far) and market_cap."""
    run = W.partitionBy("symbol").orderBy("date").rowsBetween(W.unboundedPreceding, W.currentRow)
    return bars.withColumn("shares", F.sum("volume").over(run)).withColumn("market_cap", F.col("price") * F.col("shares"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, freq, date, filing_date, revenue, net_income, total_assets) by quarter and year."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("symbol"), F.trunc(F.to_date("l_shipdate"), "quarter").alias("d"), F.col("l_extendedprice").alias("gross"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    rows = rows.groupBy("symbol", "d").agg(F.sum("net").alias("net"), F.sum("gross").alias("gross")).repartition("symbol")  # years are sums of quarters
    ends = {"quarter": F.last_day(F.add_months("d", 2)), "year": F.last_day(F.add_months(F.trunc("d", "year"), 11))}
    freq = F.explode(F.array(*[F.struct(F.lit(k).alias("freq"), v.alias("date")) for k, v in ends.items()]))
    sums = rows.withColumn("f", freq).groupBy("symbol", "f.freq", "f.date").agg(F.sum("net").alias("revenue"), F.sum("gross").alias("gross"))
    run = W.partitionBy("symbol", "freq").orderBy("date").rowsBetween(W.unboundedPreceding, W.currentRow)
    return sums.select("symbol", "freq", "date", F.date_add("date", 40).alias("filing_date"), "revenue", (F.col("revenue") - 0.9 * F.col("gross")).alias("net_income"), F.sum("revenue").over(run).alias("total_assets"))


def static_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, sic2, exchange)."""
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    rows = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return rows.select(F.col("s_suppkey").cast("string").alias("symbol"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0").alias("sic2"), F.col("r_name").alias("exchange"))


MACRO = ("m_mean", "m_sum", "m_count", "m_open", "m_done")


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(month, m_mean, m_sum, m_count, m_open, m_done): a row a month."""
    rows = read(spark, sf_dir, "orders")
    share = lambda s: F.avg((F.col("o_orderstatus") == s).cast("double"))
    return rows.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.avg("o_totalprice").alias("m_mean"), F.sum("o_totalprice").alias("m_sum"), F.count("*").cast("double").alias("m_count"), share("O").alias("m_open"), share("F").alias("m_done")
    )


def raw_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly series as a CSV of macro data has them: yyyymm, Index with commas, csp with gaps (months without a pending order), tbl."""
    rows = read(spark, sf_dir, "orders")
    return rows.groupBy(F.date_format("o_orderdate", "yyyyMM").alias("yyyymm")).agg(
        F.format_number(F.sum("o_totalprice"), 2).alias("Index"), F.avg(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice"))).alias("csp"), F.count("*").cast("double").alias("CRSP_SPvw"), F.avg("o_custkey").alias("tbl")
    )


def stock_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, body): JSON documents of the parts. Lists hold the lines of some kinds only, so some symbols lack some."""
    kinds = ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", *kinds).repartition("l_partkey")  # lines are smaller than the lists that they are in
    rows = lines.select("l_partkey", F.col("l_partkey").cast("string").alias("symbol"), F.to_date("l_shipdate").cast("string").alias("date"), F.date_add(F.to_date("l_shipdate"), 40).cast("string").alias("fillingDate"), *kinds)
    listed = lambda keep, **fields: F.transform(
        F.array_sort(F.collect_list(F.when(keep, F.struct("l_orderkey", "l_linenumber", F.struct("symbol", "date", *[v.alias(k) for k, v in fields.items()]).alias("row"))))), lambda x: x["row"]
    )
    price, flag = F.col("l_extendedprice"), F.col("l_returnflag")
    income = lambda keep: listed(keep, fillingDate=F.col("fillingDate"), netIncome=price * (1 - F.col("l_discount")), revenue=price)
    balance = lambda keep: listed(keep, fillingDate=F.col("fillingDate"), totalAssets=price * F.col("l_quantity"))
    made = rows.groupBy("l_partkey", "symbol").agg(
        listed(F.lit(True), price=price / F.col("l_quantity"), volume=F.col("l_quantity")).alias("eod"), listed(flag != "R", adjClose=price / F.col("l_quantity")).alias("eod_unadj"),
        listed(flag != "A", marketCap=price).alias("market_cap"), income(F.col("l_linestatus") == "F").alias("ai"), balance(F.col("l_linestatus") == "O").alias("ab"), income(flag == "N").alias("qi"), balance(flag == "R").alias("qb"),
    )
    finance = lambda i, b: F.struct(F.col(i).alias("income_statement"), F.col(b).alias("balance_sheet"))
    return made.select("symbol", F.to_json(F.struct("symbol", "eod", "eod_unadj", "market_cap", finance("ai", "ab").alias("financials_annual"), finance("qi", "qb").alias("financials_quarterly"))).alias("body"))


def endpoint_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, endpoint, page, body): the parts' lines as endpoints answer, market caps in pages of a year, newest first."""
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("symbol"), F.to_date("l_shipdate").alias("_day"), F.to_date("l_shipdate").cast("string").alias("date"), F.struct("l_orderkey", "l_linenumber").alias("at"), "l_quantity", "l_extendedprice", "l_returnflag",
    )
    body = lambda *fields: F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("at", F.struct("symbol", "date", *fields).alias("row")))), lambda x: x["row"])).alias("body")
    eod = rows.groupBy("symbol").agg(body((F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"))).select("symbol", F.lit("eod").alias("endpoint"), F.lit(0).alias("page"), "body")
    caps = rows.filter("l_returnflag <> 'A'").groupBy("symbol", (2000 - F.year("_day")).alias("page")).agg(body(F.col("l_extendedprice").alias("marketCap"))).select("symbol", F.lit("market_cap").alias("endpoint"), "page", "body")
    return eod.unionByName(caps)
