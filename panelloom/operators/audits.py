"""Checks and statistics of panels: gaps, runs, null audits, quantile bins, correlations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.periods import close_enough, month_gap, months_between
from ..functions.windows import average_ranks, by_months
from ..streaming.incremental import scratch
from .ranks import kendall, quantiles


def month_gaps(rows: DataFrame) -> DataFrame:
    """(month): months of the calendar from first to last that no row has."""
    calendar = rows.agg(F.min("month").alias("lo"), F.max("month").alias("hi")).select(F.explode(months_between(F.col("lo"), F.col("hi"))).alias("month"))
    return calendar.join(rows.select("month").distinct(), "month", "left_anti")


def months_missing(rows: DataFrame) -> DataFrame:
    """(symbol, month): months of each symbol's calendar, from its first to its last, that it has no row for."""
    bounds = rows.groupBy("symbol").agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    calendar = bounds.select("symbol", F.explode(months_between(F.col("lo"), F.col("hi"))).alias("month"))
    return calendar.join(rows.select("symbol", "month").distinct(), ["symbol", "month"], "left_anti")


def symbol_gaps(rows: DataFrame) -> DataFrame:
    """(symbol, prev, next, gap) for every gap of at least a month."""
    pairs = rows.select("symbol", F.col("month").alias("prev"), F.lead("month").over(by_months()).alias("next"))
    return pairs.withColumn("gap", month_gap("prev", "next")).filter("gap > 0")


def symbol_gap_lists(rows: DataFrame) -> DataFrame:
    """(symbol, count, gaps)."""
    gaps = symbol_gaps(rows).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("prev", "next", "gap"))).alias("gaps"))
    return gaps.select("symbol", F.size("gaps").cast("long").alias("count"), "gaps")


def run_lengths(rows: DataFrame, max_gap: int = 6, least: int = 12) -> DataFrame:
    """rows plus keep: whether the row's run, of months at most max_gap apart, has at least `least` rows."""
    far = F.coalesce(month_gap(F.lag("month").over(by_months()), "month") > max_gap, F.lit(False)).cast("int")
    runs = rows.withColumn("_far", far).withColumn("_run", F.sum("_far").over(by_months().rowsBetween(W.unboundedPreceding, W.currentRow)))
    return runs.withColumn("keep", F.count("*").over(W.partitionBy("symbol", "_run")) >= least).drop("_far", "_run")


def nulls_after_first(rows: DataFrame, columns: list[str], strict: bool = False) -> DataFrame:
    """(column, symbol, month): nulls after a column's first value; strict leaves out columns valid from their first row."""
    run = by_months().rowsBetween(W.unboundedPreceding, W.currentRow)
    out = rows.select("symbol", "month", *columns, *[F.count(c).over(run).alias(f"_{c}") for c in columns], *[F.first(c).over(run).isNull().alias(f"_{c}_late") for c in columns])
    bad = [F.when(F.col(c).isNull() & (F.col(f"_{c}") > 0) & (F.col(f"_{c}_late") if strict else F.lit(True)), F.lit(c)) for c in columns]
    return out.select(F.explode(F.array_compact(F.array(*bad))).alias("column"), "symbol", "month")


def quantile_bins(rows: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """(column, bin, low, high, count): counts between distinct linear quantiles, right-closed, the lowest value included.

    A column with a single distinct edge has no bins.
    """
    limits = quantiles(rows, columns, [i / bins for i in range(bins + 1)]).groupBy("column").agg(F.array_sort(F.collect_set("value")).alias("edges")).filter("size(edges) > 1")
    longs = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("r")).select("r.*").filter("value is not null")
    at = F.greatest(F.lit(1), F.expr("size(filter(edges, e -> e < value))"))
    placed = longs.join(F.broadcast(limits), "column").withColumn("bin", at)  # a row a column
    return placed.groupBy("column", "bin").agg(F.get(F.first("edges"), F.col("bin") - 1).alias("low"), F.get(F.first("edges"), F.col("bin")).alias("high"), F.count("*").alias("count"))


def _pearson(a: Column, b: Column) -> Column:
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    spread = F.var_pop(x) * F.var_pop(y)
    return F.covar_pop(x, y) / F.sqrt(F.when(spread > 0, spread))


def _once(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as they come out of one run, written: sums of doubles differ in their last digits from run to run."""
    path = scratch(rows.sparkSession, "once")
    rows.select(*[F.col(f"`{c}`") for c in dict.fromkeys(columns)]).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def ranked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Average ranks of each column, nulls apart. Ranks are joined by value, so rows have to be the same whenever they are read."""
    base = rows
    for c in columns:
        ranks = average_ranks(base, c).select(F.col("value").alias("_value"), F.col("rank").alias(f"_{c}"))
        rows = rows.join(ranks, F.col(c) == F.col("_value"), "left").drop("_value")
    return rows.select(*[F.col(f"_{c}").alias(c) for c in columns])


def correlations(rows: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """(a, b, r) for every pair in column order; of kendall, tau-b."""
    return _correlations(rows if method == "pearson" else _once(rows, columns), columns, method)


def _correlations(rows: DataFrame, columns: list[str], method: str) -> DataFrame:
    pairs = list(combinations(columns, 2))
    if method == "kendall":
        return kendall(rows, pairs)
    one = (ranked(rows, columns) if method == "spearman" else rows).agg(*[_pearson(F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{i}`").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")


def mean_correlations(rows: DataFrame, columns: list[str], methods: tuple[str, ...] = ("pearson", "kendall", "spearman")) -> DataFrame:
    rows, out = _once(rows, columns), None
    for m in methods:
        one = _correlations(rows, columns, m)
        out = one if out is None else out.unionAll(one)
    return out.groupBy("a", "b").agg(F.avg("r").alias("r"))


def correlated(rows: DataFrame, columns: list[str], threshold: float = 0.9, method: str = "pearson") -> DataFrame:
    """(column): columns whose absolute correlation with any earlier one, dropped or not, exceeds the threshold."""
    return correlations(rows, columns, method).filter(F.abs("r") > threshold).select(F.col("b").alias("column")).distinct()


def without_correlated(rows: DataFrame, columns: list[str], threshold: float = 0.9, method: str = "pearson") -> DataFrame:
    return rows.drop(*[r["column"] for r in correlated(rows, columns, threshold, method).collect()])  # a row a column at most


def profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, nulls, distinct, mean, std, low, q25, median, q75, high)."""
    stat = lambda c: F.struct(
        F.lit(c).alias("column"), F.count(c).alias("n"), F.count_if(F.col(c).isNull()).alias("nulls"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"),
    )
    one = rows.agg(F.array(*map(stat, columns)).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    named = {0.25: "q25", 0.5: "median", 0.75: "q75"}
    middle = quantiles(rows, columns, list(named)).groupBy("column").agg(*[F.max(F.when(F.col("point") == p, F.col("value"))).alias(c) for p, c in named.items()])
    return one.join(F.broadcast(middle), "column", "left").select("column", "n", "nulls", "mean", "std", "low", *named.values(), "high")  # a row a column


def histogram(rows: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """(column, bin, low, high, count) over equal widths from a column's least to its largest value, the last bin closed; empty bins have no row.

    A column of one value has one bin, half a unit to either side.
    """
    ends = rows.agg(*[F.struct(F.min(F.col(c).cast("double")).alias("lo"), F.max(F.col(c).cast("double")).alias("hi")).alias(c) for c in columns])
    ends = ends.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("e")) for c in columns])).alias("x")).select("x.column", "x.e.*")
    flat = F.col("lo") == F.col("hi")
    ends = ends.select("column", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.lit(1.0)).otherwise(F.col("hi") - F.col("lo")).alias("span"), F.when(flat, 1).otherwise(bins).alias("bins"))
    longs = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("r")).select("r.*").filter("value is not null")
    at = F.least(F.col("bins") - 1, F.floor((F.col("value") - F.col("lo")) * F.col("bins") / F.col("span")))
    counts = longs.join(F.broadcast(ends), "column").groupBy("column", at.cast("int").alias("bin"), "lo", "span", "bins").agg(F.count("*").alias("count"))  # a row a column
    edge = lambda k: F.col("lo") + F.col("span") * k / F.col("bins")
    return counts.select("column", "bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), "count")


def overview(rows: DataFrame) -> DataFrame:
    """(column, type, rows, nulls): the shape of a table."""
    nulls = rows.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_{i}") for i, c in enumerate(rows.columns)])
    each = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("_rows").alias("rows"), F.col(f"_{i}").alias("nulls")) for i, (c, t) in enumerate(rows.dtypes)]
    return nulls.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def duplicate_rows(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def category_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).withColumn("column", F.lit(column))


def compare_features(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, feature, left, right) where two panels differ, missing rows included."""
    x, y = (t.select(*keys, *[F.col(c).alias(f"{s}_{c}") for c in columns]) for t, s in ((a, "l"), (b, "r")))
    both = x.join(y, keys, "full")
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"l_{c}").cast("double").alias("left"), F.col(f"r_{c}").cast("double").alias("right")) for c in columns])
    return both.select(*keys, F.explode(each).alias("d")).select(*keys, "d.*").filter(~close_enough(F.col("left"), F.col("right")))
