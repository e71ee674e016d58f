"""Windows of a symbol's periods; made when used, since they need a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Slices of a table that is numbered as a whole, and the rows that their bounds are taken from.
SLICES, BOUND_ROWS = 64, 4096


def by_days() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("date")


def by_months() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("month")


def by_weeks() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("week")


def _sliced(rows: DataFrame, order: Column) -> DataFrame:
    """rows plus _slice, which grows with order. Bounds come from rows picked by hash; any give right positions."""
    picked = rows.select(order.alias("o"), F.xxhash64(order).alias("h")).distinct().orderBy("h").limit(BOUND_ROWS)
    held = picked.agg(F.array_sort(F.collect_list("o")).alias("o"), F.count("*").alias("n"))  # BOUND_ROWS at most
    bounds = held.select(F.expr(f"filter(o, (x, i) -> i % greatest(1, cast(n / {SLICES} as int)) = 0)").alias("_bounds"))
    at = F.expr("size(filter(_bounds, b -> b < _order))")
    return rows.withColumn("_order", order).join(F.broadcast(bounds)).withColumn("_slice", at).drop("_bounds")  # one row


def positioned(rows: DataFrame, order: list[str], name: str = "_i", total: str = "_n") -> DataFrame:
    """rows plus their 0-based place in the whole table's order and the number of rows, with a window a slice rather than one."""
    cut = _sliced(rows, F.struct(*order))
    per = cut.groupBy("_slice").agg(F.count("*").alias("_rows"))
    whole = Window.partitionBy(F.lit(0))  # a row a slice
    per = per.select("_slice", (F.sum("_rows").over(whole.orderBy("_slice")) - F.col("_rows")).alias("_before"), F.sum("_rows").over(whole).alias(total))
    placed = cut.withColumn(name, F.row_number().over(Window.partitionBy("_slice").orderBy("_order")) - 1).join(F.broadcast(per), "_slice")
    return placed.withColumn(name, F.col(name) + F.col("_before")).drop("_slice", "_order", "_before")


def average_ranks(rows: DataFrame, column: str) -> DataFrame:
    """(value, rank) of a column's distinct values: the mean 1-based place of its rows, nulls apart."""
    counts = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("_rows"))
    cut = _sliced(counts, F.col("value"))
    per = cut.groupBy("_slice").agg(F.sum("_rows").alias("_all"))
    per = per.select("_slice", (F.sum("_all").over(Window.partitionBy(F.lit(0)).orderBy("_slice")) - F.col("_all")).alias("_before"))
    upto = F.sum("_rows").over(Window.partitionBy("_slice").orderBy("value"))
    return cut.withColumn("_upto", upto).join(F.broadcast(per), "_slice").select("value", (F.col("_before") + F.col("_upto") - (F.col("_rows") - 1) / 2).alias("rank"))
