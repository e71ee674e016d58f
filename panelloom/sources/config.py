"""Paths and switches of a run over stock documents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import month_key
from ..functions.windows import positioned
from ..operators import bars, features, panel
from . import documents


@dataclass(frozen=True)
class EngineConfig:
    """root holds raw, processed and frames; nothing is written over what is read.

    strict drops symbols that have an undefined feature in a month with bars.
    """

    root: str = "data"
    strict: bool = False

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    @property
    def raw(self) -> str:
        return self.path("raw")

    @property
    def frames(self) -> str:
        return self.path("frames")


def features_of(stocks: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Every characteristic of stock documents, by symbol and month. `keep` may persist what is read several times."""
    daily = keep(documents.daily_bars(stocks))
    caps, shares = documents.market_caps(stocks), documents.shares(stocks).withColumn("shares", F.col("shares").cast("double"))
    month_end = lambda rows, c: rows.groupBy("symbol", month_key("date").alias("month")).agg(F.max_by(c, "date").alias(c))
    months = bars.monthly_summary(bars.daily_returns(daily.join(shares, ["symbol", "date"], "left"))).drop("shares")
    months = keep(months.join(month_end(shares, "shares"), ["symbol", "month"], "left").join(month_end(caps, "market_cap"), ["symbol", "month"], "left"))
    made, weekly = features.with_liquidity(features.with_momentum(months)), keep(bars.weekly_returns(daily))
    risk = features.rolling_risk(months, weekly, features.market_returns(weekly))
    filed = features.earnings_and_sales(documents.income_statements(stocks), caps.dropna()).join(features.asset_growth(documents.balance_sheets(stocks)), ["symbol", "freq", "month"], "full")
    static = stocks.select("symbol", F.col("sicCode_2").alias("sic2"), F.col("sicIndustry").alias("industry"), F.col("sicDivision").alias("division"), "exchange")
    industry = features.industry_momentum(made, static).join(features.industry_momentum(made, static, "mom12m", "indmom_lagged"), ["sic2", "month"])
    wide = panel.assemble(made.join(risk, ["symbol", "month"], "left"), panel.by_frequency(filed), static=static)
    return wide.join(industry, ["sic2", "month"], "left")


def run(spark: SparkSession, config: EngineConfig, required: tuple[str, ...] = ("mom1m",), start: int | None = None, end: int | None = None) -> tuple[DataFrame, DataFrame]:
    """From documents in raw to the panel, written to frames by symbol: (panel, report of every document).

    With start or end only symbols in these places of the alphabet are written and reported,
    others' frames stay; markets and industries are those of all documents.
    """
    stocks = documents.read_documents(spark, f"{config.raw}/*.json")
    valid = panel.validity(stocks)
    made = features_of(stocks.join(valid.filter("valid"), "symbol", "left_semi"))
    part = (start, end) != (None, None)
    if part:
        place = F.col("_i") >= (start or 0) if end is None else F.col("_i").between(start or 0, end - 1)
        asked = positioned(valid.select("symbol").distinct(), ["symbol"]).filter(place).select("symbol")
        made, valid = made.join(asked, "symbol", "left_semi"), valid.join(asked, "symbol", "left_semi")
    if config.strict:
        made = panel.strict(made, required)
    documents.write_frames(made, config.frames, replace=not part)
    return made, panel.report(valid, made)


def run_slices(spark: SparkSession, config: EngineConfig, size: int, **how) -> DataFrame:
    """Runs of `size` symbols each, whose reports are written once their frames are; those that have a report aren't run again.

    Gives all reports; a run that was cut off is resumed by calling this again.
    """
    n = documents.read_documents(spark, f"{config.raw}/*.json").select("symbol").distinct().count()
    for start in range(0, n, size):
        path = f"{config.path('reports')}/start={start}"
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            run(spark, config, start=start, end=start + size, **how)[1].write.mode("overwrite").parquet(path)
    return spark.read.parquet(config.path("reports"))
