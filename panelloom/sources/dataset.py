"""From files to windows for a model, and the same scaling again when the model is used.

build reads the panel and the macro series, fills, picks columns, scales on the training
months, stores the scalers, and cuts windows inside each split, with the static columns of
their symbol. latest reads the stored scalers and cuts the window that a forecast of each
symbol's next month starts from; unscaled takes forecasts back to their own units.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audits, mlprep, panel
from . import documents
from .macro import read_macro


@dataclass(frozen=True)
class Dataset:
    """panel and macro are CSV, a formatted panel being one that is filled; scalers is where they are stored.

    sample is a number of symbols, or null for all; splits are the ends of train, val and test.
    """

    panel: str
    macro: str
    scalers: str
    splits: tuple[str, str, str] = ("2019-06", "2022-07", "2025-01")
    steps: int = 12
    macro_steps: int = 12
    target: str = "mom1m"
    sample: int | None = None
    kind: str = "standard"
    correlation: float = 0.9
    formatted: bool = False


STATIC = ("symbol", "sic2", "exchange")


def _rows(spark: SparkSession, c: Dataset, macro: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list[str]]:
    """The final panel, and its features."""
    rows = documents.read_panel(spark, c.panel)
    if c.sample is not None:
        rows = mlprep.sampled_symbols(rows, c.sample)
    there = tuple(f for f in mlprep.FEATURES if f in rows.columns)
    if not c.formatted:
        own = [f for f in dict.fromkeys((*STATIC, "month", *there, *panel.FUNDAMENTALS)) if f in rows.columns]
        rows = panel.format_panel(rows.select(*own), macro.select("month"), there, keep)
    return keep(mlprep.final_columns(rows)), [mlprep.RENAMED.get(f, f) for f in there]


def _windows_of(rows: DataFrame) -> DataFrame:
    """(symbol, sic2, exchange): a row a symbol."""
    return panel.static_values(rows, tuple(s for s in STATIC[1:] if s in rows.columns))


def build(spark: SparkSession, c: Dataset, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(split, symbol, time, x, macro_x, y, sic, exchange). Macro columns that follow an earlier one are left out; `keep` may persist the rows."""
    macro = read_macro(spark, c.macro)
    rows, firm = _rows(spark, c, macro, keep)
    macro = audits.without_correlated(macro, [m for m in macro.columns if m != "month"], c.correlation)
    kept = [m for m in macro.columns if m != "month"]
    rows = rows.withColumn("split", mlprep.date_split(*c.splits)).filter("split is not null")
    train = F.col("month") < c.splits[0]
    for name, fitted in {"firm": mlprep.scaler(rows, firm, train, c.kind), "macro": mlprep.scaler(macro, kept, train, c.kind), "codes": mlprep.code_map(_windows_of(rows), "sic2")}.items():
        fitted.write.mode("overwrite").parquet(f"{c.scalers}/{name}")
    scaled, names = _scaled(spark, c, rows, macro, firm)
    windows = mlprep.joint_sequences(scaled, firm, names, c.target, c.steps, c.macro_steps)
    return _with_static(spark, c, windows, rows)


def _scaled(spark: SparkSession, c: Dataset, rows: DataFrame, macro: DataFrame, firm: list[str]) -> tuple[DataFrame, list[str]]:
    """rows with firm and macro columns by the stored scalers, and the macro columns' names, which are prefixed."""
    fitted = spark.read.parquet(f"{c.scalers}/macro")
    kept = [x.removeprefix("_").removesuffix("_centre") for x in fitted.columns if x.endswith("_centre")]
    macro = mlprep.scaled_by(macro.select("month", *kept), fitted, kept).withColumnsRenamed({m: f"macro_{m}" for m in kept})
    return panel.join_macro(mlprep.scaled_by(rows, spark.read.parquet(f"{c.scalers}/firm"), firm), macro), [f"macro_{m}" for m in kept]


def _with_static(spark: SparkSession, c: Dataset, windows: DataFrame, rows: DataFrame) -> DataFrame:
    """windows plus their symbol's industry code, null if the training table had none such, and exchange."""
    static = _windows_of(rows).join(F.broadcast(spark.read.parquet(f"{c.scalers}/codes").withColumnRenamed("code", "sic")), "sic2", "left").drop("sic2")  # a row an industry
    return windows.join(static, "symbol", "left")


def latest(spark: SparkSession, c: Dataset, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(symbol, time, x, macro_x, sic, exchange): the window of each symbol's last rows, scaled as build did; time is its last month. Symbols with fewer rows have none."""
    macro = read_macro(spark, c.macro)
    rows, firm = _rows(spark, c, macro, keep)
    scaled, names = _scaled(spark, c, rows, macro, firm)
    n = max(c.steps, c.macro_steps)
    last = scaled.withColumn("_n", F.row_number().over(mlprep.W.partitionBy("symbol").orderBy(F.desc("month")))).filter(F.col("_n") <= n)
    vector = lambda cs: F.array(*[F.col(f"`{x}`").cast("double") for x in cs])
    held = F.array_sort(F.collect_list(F.struct("month", vector(firm).alias("x"), vector(names).alias("macro_x"))))
    per = last.groupBy("symbol").agg(held.alias("_rows")).filter(F.size("_rows") == n)
    tail = lambda k, steps: F.transform(F.slice("_rows", n - steps + 1, steps), lambda q: q[k])
    windows = per.select("symbol", F.element_at("_rows", -1)["month"].alias("time"), tail("x", c.steps).alias("x"), tail("macro_x", c.macro_steps).alias("macro_x"))
    return _with_static(spark, c, windows, rows)


def unscaled(spark: SparkSession, c: Dataset, forecasts: DataFrame, column: str) -> DataFrame:
    """forecasts with a scaled target in its own units."""
    fitted = spark.read.parquet(f"{c.scalers}/firm").select(*[F.col(f"_{c.target}_{k}").alias(f"_{column}_{k}") for k in ("centre", "divisor")])
    return mlprep.scaled_by(forecasts, fitted, [column], inverse=True)
