"""Stock documents (one JSON file a symbol) and CSV tables to normalised tables, and back.

Order matters only where a list's first row wins; its position is kept for that. NaN
becomes null at this boundary.
"""

from __future__ import annotations

import json
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BAR = "struct<symbol:string,date:string,price:double,volume:double>"
STATEMENTS = "struct<income_statement:array<struct<date:string,fillingDate:string,filingDate:string,netIncome:double,revenue:double>>,balance_sheet:array<struct<date:string,fillingDate:string,filingDate:string,totalAssets:double>>>"
DOCUMENT = f"""symbol string, sicCode string, sicCode_2 string, sicIndustry string, sicDivision string, exchange string, exchangeShortName string, type string,
 eod array<{BAR}>, eod_unadj array<struct<symbol:string,date:string,adjClose:double,volume:double>>, market_cap array<struct<symbol:string,date:string,marketCap:double>>,
 outstanding_shares map<string,bigint>, financials_annual {STATEMENTS}, financials_quarterly {STATEMENTS}, _corrupt_record string"""


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def parse_documents(rows: DataFrame, body: str = "body", fields: tuple[str, ...] = ()) -> DataFrame:
    """Documents from a column of JSON text; of their fields only those named, if any are: the others are skipped in the text."""
    schema = DOCUMENT if not fields else StructType([f for f in StructType.fromDDL(DOCUMENT) if f.name in fields])
    return rows.select(F.from_json(body, schema, {"mode": "PERMISSIVE"}).alias("d")).select("d.*")


def write_documents(df: DataFrame, path: str, by: tuple[str, ...] = ("symbol",), pretty: bool = False) -> None:
    """JSON documents in folders by the named columns, `symbol` itself staying in the document; one line each, or indented."""
    keys = [f"_{c}" for c in by]
    text = F.to_json(F.struct(*df.columns), {"pretty": str(pretty).lower(), "ignoreNullFields": "false"})
    df.select(text.alias("value"), *[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]).write.mode("overwrite").partitionBy(*keys).text(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return clean_nan(spark.read.schema(schema).option("header", True).csv(path))


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """A panel of (month, symbol, text and number columns) from CSV; what isn't named here is a number."""
    rows = spark.read.option("header", True).csv(path)
    text = ("month", "symbol", "sic2", "industry", "division", "exchange", "latest_week")
    rows = rows.select(*[F.col(f"`{c}`") if c in text else F.col(f"`{c}`").try_cast("double").alias(c) for c in rows.columns])
    return clean_nan(rows.withColumn("symbol", true_symbol(F.col("symbol"))))


def write_frames(panel: DataFrame, path: str, months: tuple[str, str] | None = None, replace: bool = True) -> DataFrame:
    """One folder a symbol, months in order, of the months from the first to before the second if given; returns (symbol, rows) of what is written.

    Symbols whose rows all lie outside have 0 rows in what is returned and no folder. What the
    path holds is replaced, or else only the folders of the symbols that are written.
    """
    inside = F.lit(True) if months is None else F.col("month").between(*months) & (F.col("month") < months[1])
    panel.filter(inside).repartition("symbol").sortWithinPartitions("symbol", "month").write.mode("overwrite").option("partitionOverwriteMode", "static" if replace else "dynamic").partitionBy("symbol").option("header", True).csv(path)
    return panel.groupBy("symbol").agg(F.count_if(inside).alias("rows"))


def clean_nan(df: DataFrame) -> DataFrame:
    """Null for NaN in every float column."""
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def first_by_date(rows: DataFrame, order: str = "pos", keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """The first row in arrival order of each symbol and date."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n", order)


def daily_bars(docs: DataFrame) -> DataFrame:
    # By symbol once: the first of a date, returns and months all follow in that.
    rows = docs.select("symbol", F.posexplode("eod").alias("pos", "r")).repartition("symbol")
    return clean_nan(first_by_date(rows.select("symbol", F.to_date("r.date").alias("date"), "r.price", "r.volume", "pos")))


def unadjusted_bars(docs: DataFrame) -> DataFrame:
    rows = docs.select("symbol", F.posexplode("eod_unadj").alias("pos", "r"))
    return first_by_date(rows.select("symbol", F.to_date("r.date").alias("date"), F.col("r.adjClose").alias("adj_close"), "pos"))


def market_caps(docs: DataFrame) -> DataFrame:
    rows = docs.select("symbol", F.posexplode("market_cap").alias("pos", "r"))
    return first_by_date(rows.select("symbol", F.to_date("r.date").alias("date"), F.col("r.marketCap").alias("market_cap"), "pos"))


def shares(docs: DataFrame) -> DataFrame:
    return docs.select("symbol", F.explode("outstanding_shares").alias("date", "shares")).withColumn("date", F.to_date("date"))


def derive_shares(bars: DataFrame, caps: DataFrame) -> DataFrame:
    """Shares = market cap over price, rounded half to even, by date."""
    rows = bars.join(caps, ["symbol", "date"])
    return rows.select("symbol", "date", F.bround(F.col("market_cap") / F.nullif("price", F.lit(0.0))).cast("long").alias("shares"))


def _statements(docs: DataFrame, kind: str, fields: dict[str, str]) -> DataFrame:
    out = None
    for freq in ("annual", "quarterly"):
        rows = docs.select("symbol", F.lit("year" if freq == "annual" else "quarter").alias("freq"), F.explode(f"financials_{freq}.{kind}").alias("r"))
        rows = rows.select("symbol", "freq", F.to_date("r.date").alias("date"), F.to_date(F.coalesce("r.fillingDate", "r.filingDate")).alias("filing_date"), *[F.col(f"r.{a}").alias(b) for a, b in fields.items()])
        out = rows if out is None else out.unionByName(rows)
    return out


def income_statements(docs: DataFrame) -> DataFrame:
    return _statements(docs, "income_statement", {"netIncome": "net_income", "revenue": "revenue"})


def balance_sheets(docs: DataFrame) -> DataFrame:
    return _statements(docs, "balance_sheet", {"totalAssets": "total_assets"})


def universe(sic: DataFrame, stocks: DataFrame, dim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profiles, rejects) from (symbol, sicCode) and (symbol, exchange, type, pos).

    Of a symbol listed twice the last listing counts; a symbol with two codes is dropped
    from both results.
    """
    listed = stocks.groupBy("symbol").agg(F.max_by(F.struct("exchange", "type"), "pos").alias("s")).select("symbol", "s.*")
    rows = sic.withColumn("sic2", F.substring("sicCode", 1, 2)).join(listed, "symbol", "left").join(F.broadcast(dim), "sic2", "left")
    rows = rows.withColumn("_fit", F.coalesce((F.col("type") == "stock") & F.col("industry").isNotNull() & ~F.col("symbol").contains("."), F.lit(False)))
    fit = rows.filter("_fit").withColumn("_n", F.count("*").over(W.partitionBy("symbol")))
    return fit.filter("_n = 1").select("symbol", "sicCode", "sic2", "industry", "division", "exchange"), rows.filter("not _fit").select("symbol", "sicCode")


def true_symbol(symbol: Column) -> Column:
    """CSV readers may take the ticker TRUE for a boolean."""
    return F.when(F.lower(symbol.cast("string")) == "true", F.lit("TRUE")).otherwise(symbol.cast("string"))


def enrich(docs: DataFrame, extra: DataFrame, name: str) -> DataFrame:
    """docs plus a column of structs from extra, by symbol, in extra's order of date."""
    rows = extra.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct(*[c for c in extra.columns if c != "symbol"])), asc=False).alias(name))
    return docs.drop(name).join(rows, "symbol", "left")


def page_windows(first: str, last: str, years: int = 19) -> list[tuple[str, str]]:
    """Date ranges of at most `years`, newest first, for sources that page by date."""
    lo, hi, out = date.fromisoformat(first), date.fromisoformat(last), []
    while hi >= lo:
        a = max(lo, hi - timedelta(days=365 * years))
        out.append((a.isoformat(), hi.isoformat()))
        hi = a - timedelta(days=1)
    return out


def oldest_date(body: str | None) -> date | None:
    """The least date of a JSON list of dated rows; null of none, or of what isn't such a list."""
    try:
        rows = json.loads(body or "[]")
        return min((date.fromisoformat(r["date"][:10]) for r in rows), default=None)
    except (ValueError, TypeError, KeyError):
        return None


def union_of_pages(pages: DataFrame, keys: tuple[str, ...] = ("symbol", "date"), page: str = "page") -> DataFrame:
    """Rows of several pages as one table: of what two pages both have, the newest page's (the lowest number) counts."""
    return pages.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(page))).filter("_n = 1").drop("_n", page)


def more_pages(pages: DataFrame, page: str = "page", slack_days: int = 10) -> DataFrame:
    """(symbol, oldest, more): whether a symbol's last page reaches back to its window's start, so that an older one may exist.

    pages has the window's start as `from`; a first row more than slack_days after it ends the history.
    """
    last = pages.groupBy("symbol", page).agg(F.min("date").alias("oldest"), F.min("from").alias("_from"))
    last = last.groupBy("symbol").agg(F.max_by(F.struct("oldest", "_from"), page).alias("x"))
    return last.select("symbol", "x.oldest", (F.datediff("x.oldest", "x._from") <= slack_days).alias("more"))


def refreshed(held: DataFrame, news: DataFrame, keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """What is held with newer rows in place of those of the same keys."""
    return held.join(news.select(*keys), list(keys), "left_anti").unionByName(news)


#: What is taken from the endpoints' answers.
ANSWERS = {
    "eod": f"array<{BAR}>", "market_cap": "array<struct<symbol:string,date:string,marketCap:double>>",
    "earnings": "array<struct<symbol:string,date:string,epsActual:double,epsEstimated:double,revenueActual:double,revenueEstimated:double,lastUpdated:string>>",
    "income_statement": "array<struct<date:string,fillingDate:string,filingDate:string,netIncome:double,revenue:double>>",
    "balance_sheet": "array<struct<date:string,fillingDate:string,filingDate:string,totalAssets:double>>",
}


def assembled(answers: DataFrame) -> DataFrame:
    """Stock documents from endpoints' answers (symbol, endpoint, page, body), of statements by their period.

    Lists are latest first, one row a date: of what two pages both have the newest page's
    counts, and on one page the row that comes first. Shares are market cap over price by
    date; a symbol without market caps has neither. Statements keep their order.
    """
    parsed = lambda kind: F.from_json(F.col("body"), ANSWERS[kind])

    def dated(kind: str) -> DataFrame:
        rows = answers.filter(F.col("endpoint") == kind).select("symbol", "page", F.posexplode(parsed(kind)).alias("_pos", "r")).select("symbol", F.col("r.date").alias("date"), F.struct("page", "_pos").alias("_at"), "r")
        return rows.filter("date is not null").groupBy("symbol", "date").agg(F.min_by("r", "_at").alias("r"))

    out = answers.select("symbol").distinct()
    for kind in ("eod", "earnings", "market_cap"):
        latest = F.sort_array(F.collect_list(F.struct("date", "r")), asc=False)
        out = out.join(dated(kind).groupBy("symbol").agg(F.transform(latest, lambda x: x["r"]).alias(kind)), "symbol", "left")
    prices, caps = (dated(kind).select("symbol", "date", f"r.{c}") for kind, c in (("eod", "price"), ("market_cap", "marketCap")))
    number = derive_shares(prices, caps.withColumnRenamed("marketCap", "market_cap")).filter("shares is not null")
    number = number.groupBy("symbol").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("date", "shares")), asc=False)).alias("outstanding_shares"))
    whole = answers.groupBy("symbol").agg(*[F.max(F.when(F.col("endpoint") == f"{kind}:{q}", parsed(kind))).alias(f"_{kind}_{q}") for q in ("annual", "quarterly") for kind in ("income_statement", "balance_sheet")])
    finance = {f"financials_{q}": F.struct(*[F.col(f"_{kind}_{q}").alias(kind) for kind in ("income_statement", "balance_sheet")]) for q in ("annual", "quarterly")}
    out = out.join(whole, "symbol", "left").withColumns(finance)
    out = out.join(number, "symbol", "left")
    return out.select("symbol", "eod", "earnings", "market_cap", "outstanding_shares", *finance)


def fetch_report(answers: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol, status, requests, refused) of every symbol asked for: success, failed if an answer is missing or none came."""
    per = answers.groupBy("symbol").agg(F.count("*").alias("requests"), F.count_if(F.col("status") != 200).alias("refused"))
    out = symbols.select("symbol").distinct().join(per, "symbol", "left")
    return out.select("symbol", F.when(F.col("refused") == 0, "success").otherwise("failed").alias("status"), F.coalesce("requests", F.lit(0)).alias("requests"), F.coalesce("refused", F.lit(0)).alias("refused"))
