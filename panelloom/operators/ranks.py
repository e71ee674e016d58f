"""Exact quantiles and Kendall's tau of tables that no task holds.

Quantiles: a mergeable sketch of each column brackets every quantile between two values;
what lies below a bracket is counted, what lies inside, a small part of the column, is
counted by value, and the values at the quantile's two places follow.

Kendall: a pair of rows is discordant if it is in one order by x and in the other by y. Rows
are cut into slices by x and by y. Pairs of one slice of x are counted there, pairs of one
slice of y but two of x there, and pairs of two slices of both are those of the table of
(slice of x, slice of y) with the number of rows as weight, which is counted in the same way.
A value with many rows is a slice of its own, in which nothing is discordant.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranks of a sketch are off by a row in so many.
ACCURACY = 10_000
#: Different rows that a task counts discordant pairs of; beyond SLICE_ROWS**2 / 16 of them, four times their root.
SLICE_ROWS = 250_000
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # what runs in workers needs no package there


def quantiles(rows: DataFrame, columns: list[str], points: list[float]) -> DataFrame:
    """(column, point, value): linear quantiles of each column that has values, exact; nulls apart."""
    spark, double = rows.sparkSession, {c: F.col(f"`{c}`").cast("double") for c in columns}
    near = [min(1.0, max(0.0, p + d)) for p in points for d in (-2 / ACCURACY, 2 / ACCURACY)]
    sketch = [F.struct(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.percentile_approx(v, near, ACCURACY).alias("near")).alias(f"_{i}") for i, v in enumerate(double.values())]
    found = rows.agg(*sketch).first()
    brackets = []
    for i, c in enumerate(columns):
        s = found[f"_{i}"]
        for t, p in enumerate(points if s["n"] else []):
            at = p * (s["n"] - 1)
            # At the ends, and where a sketch of few rows may be off by one, brackets are open.
            lo = s["low"] if p <= 2 / ACCURACY or s["n"] <= ACCURACY else s["near"][2 * t]
            hi = s["high"] if p >= 1 - 2 / ACCURACY or s["n"] <= ACCURACY else s["near"][2 * t + 1]
            brackets.append((c, p, lo, hi, math.floor(at), at - math.floor(at)))
    if not brackets:
        return spark.createDataFrame([], "column string, point double, value double")
    below = rows.agg(*[F.count_if(double[c] < lo).alias(f"_{i}") for i, (c, _, lo, *_) in enumerate(brackets)]).first()
    held = [(*b, below[f"_{i}"]) for i, b in enumerate(brackets)]
    of = F.broadcast(spark.createDataFrame(held, "column string, point double, lo double, hi double, place long, rest double, below long"))  # a row a column and point
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), v.alias("value")) for c, v in double.items()])).alias("r")).select("r.*")
    inside = long.join(of, "column").filter(F.col("value").between(F.col("lo"), F.col("hi"))).groupBy("column", "point", "place", "rest", "below", "value").agg(F.count("*").alias("n"))
    upto = F.col("below") + F.sum("n").over(W.partitionBy("column", "point").orderBy("value"))
    ends = inside.withColumn("_upto", upto).groupBy("column", "point", "rest").agg(F.min(F.when(F.col("_upto") > F.col("place"), F.col("value"))).alias("a"), F.min(F.when(F.col("_upto") > F.col("place") + 1, F.col("value"))).alias("b"))
    value = F.when((F.col("rest") == 0) | (F.col("a") == F.col("b")), F.col("a")).otherwise((1 - F.col("rest")) * F.col("a") + F.col("rest") * F.col("b"))
    return ends.select("column", "point", value.alias("value"))


def discordant(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Weighted pairs with the smaller x and the larger y, by merging runs of doubling width."""
    order = np.lexsort((y, x))
    y, w = np.unique(y, return_inverse=True)[1][order].astype(np.int64), w[order].astype(float)
    n, most, total, width = len(y), int(y.max(initial=0)) + 1, 0.0, 1
    place = np.arange(n)
    while width < n:
        run = place // width
        key = run * most + y  # sorted within each run, so over all
        upto = np.concatenate([[0.0], np.cumsum(w)])
        right = np.flatnonzero(run % 2 == 1)
        above = upto[run[right] * width] - upto[np.searchsorted(key, (run[right] - 1) * most + y[right], "right")]
        total += float(w[right] @ above)
        order = np.lexsort((y, place // (2 * width)))
        y, w = y[order], w[order]
        width *= 2
    return total


def _counted(rows: DataFrame, by: str | None, x: str, y: str) -> DataFrame:
    """(a, b, v): discordant pairs of rows of one pair of columns and one value of `by`."""

    def count(key: tuple, group: pa.Table) -> pa.Table:
        v = discordant(*(group.column(c).to_numpy() for c in (x, y, "w")))
        return pa.table({"a": [key[0].as_py()], "b": [key[1].as_py()], "v": pa.array([v], pa.float64())})

    return rows.groupBy("a", "b", *([by] if by else [])).applyInArrow(count, "a string, b string, v double")


def _discordant(points: DataFrame) -> DataFrame:
    """(a, b, x, y, w), different rows of each pair of columns with their number -> (a, b, v), whose sums are its discordant pairs."""
    sizes = points.groupBy("a", "b").count()
    most = sizes.agg(F.max("count")).first()[0] or 0
    if most <= SLICE_ROWS:
        return _counted(points, None, "x", "y")
    n = int(min(math.ceil(most / SLICE_ROWS), max(2.0, math.sqrt(most) / 4)))
    cuts = [k / n for k in range(1, n)]
    at = lambda c: F.percentile_approx(F.col(c).cast("double"), cuts, max(ACCURACY, 10 * n)).alias(c)
    bounds = {(r["a"], r["b"]): (np.unique(r["x"]), np.unique(r["y"])) for r in points.groupBy("a", "b").agg(at("x"), at("y")).collect()}  # 2 n numbers a pair of columns

    def cut(batches):
        for batch in batches:
            a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in "ab")
            out = {"x": np.zeros(batch.num_rows, np.int64), "y": np.zeros(batch.num_rows, np.int64)}
            for pair, both in bounds.items():
                mine = np.flatnonzero((a == pair[0]) & (b == pair[1]))
                for c, edges in zip("xy", both, strict=True):
                    v = batch.column(c).to_numpy()[mine].astype(float)
                    i = np.searchsorted(edges, v, "left")  # odd where v is an edge
                    out[c][mine] = 2 * i + (edges[np.minimum(i, len(edges) - 1)] == v)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out["x"]), pa.array(out["y"])], [*batch.schema.names, "sx", "sy"])

    kind = dict(points.dtypes)
    sliced = points.mapInArrow(cut, f"a string, b string, x {kind['x']}, y {kind['y']}, w double, sx long, sy long")
    within = _counted(sliced.filter("sx % 2 = 0"), "sx", "x", "y")
    across = _counted(sliced.filter("sy % 2 = 0"), "sy", "sx", "y")
    grid = sliced.groupBy("a", "b", F.col("sx").alias("x"), F.col("sy").alias("y")).agg(F.sum("w").alias("w"))
    return within.unionAll(across).unionAll(_discordant(grid))


def kendall(rows: DataFrame, pairs: list[tuple[str, str]], keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(a, b, r): tau-b of each pair of columns over rows with both; null without two different values on either side.

    `keep` may persist the different rows, which are read several times.
    """
    each = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}`").cast("double").alias("x"), F.col(f"`{b}`").cast("double").alias("y")) for a, b in pairs])
    long = rows.select(F.explode(each).alias("p")).select("p.*").filter("x is not null and y is not null")
    points = keep(long.groupBy("a", "b", "x", "y").agg(F.count("*").cast("double").alias("w")))
    tied = lambda name, *by: points.groupBy("a", "b", *by).agg(F.sum("w").alias("w")).groupBy("a", "b").agg(F.sum(F.col("w") * (F.col("w") - 1) / 2).alias("v")).withColumn("of", F.lit(name))
    sums = tied("all").unionByName(tied("x", "x")).unionByName(tied("y", "y")).unionByName(tied("both", "x", "y")).unionByName(_discordant(points).withColumn("of", F.lit("apart")))
    v = lambda name: F.sum(F.when(F.col("of") == name, F.col("v")).otherwise(0.0))
    sums = sums.groupBy("a", "b").agg(*[v(name).alias(name) for name in ("all", "x", "y", "both", "apart")])
    spread = (F.col("all") - F.col("x")) * (F.col("all") - F.col("y"))
    r = (F.col("all") - F.col("x") - F.col("y") + F.col("both") - 2 * F.col("apart")) / F.sqrt(F.when(spread > 0, spread))
    named = rows.sparkSession.createDataFrame(pairs, "a string, b string")
    return named.join(F.broadcast(sums.select("a", "b", r.alias("r"))), ["a", "b"], "left")  # a row a pair
