"""Monthly macroeconomic series from CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import month_of_number, plain_number
from ..operators.panel import ewm_fill

#: Columns that get other names; fixed values of the source's format.
RENAMED = {"CRSP_SPvwx": "SPvwx", "CRSP_SPvw": "SPvw"}
#: The first day of the price history. Months are compared with it as text, so the month it lies in is left out.
FIRST_DAY = "1962-01-02"


def parse_macro(raw: DataFrame, first: str = FIRST_DAY, half_life: float = 5.0) -> DataFrame:
    """Rows as the CSV has them -> month and numbers: yyyymm becomes month, commas leave Index, csp is filled by its weighted mean so far.

    Months before `first` go. Further columns pass as doubles; rows without a valid yyyymm are dropped.
    """
    numbers = [c for c in raw.columns if c != "yyyymm"]
    rows = raw.select(month_of_number("yyyymm").alias("month"), *[plain_number(F.col(f"`{c}`")).alias(c) for c in numbers]).filter(F.col("month") >= first)
    rows = rows.select("month", *[F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")).alias(c) for c in numbers])
    if "csp" in numbers:
        rows = ewm_fill(rows.withColumn("_all", F.lit(0)), ("csp",), half_life, lead=False, key="_all").drop("_all")  # a row a month
    return rows.withColumnsRenamed(RENAMED)


def read_macro(spark: SparkSession, path: str, **how) -> DataFrame:
    return parse_macro(spark.read.option("header", True).csv(path), **how)
