"""Splits, scaling and sequences for models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.periods import month_gap
from ..functions.windows import positioned


#: A model's features, as the panel names them.
FEATURES = ("mom1m", "mom12m_current", "mom36m", "chmom_current", "maxret_current", "turn", "std_turn", "mve_current", "dolvol_current", "ill", "retvol", "ep_quarter", "sp_quarter", "agr_quarter", "ep_year", "beta", "betasq", "idiovol", "indmom")


def code_map(rows: DataFrame, column: str) -> DataFrame:
    """(column, code): distinct values in numeric order as 0, 1, ..."""
    known = rows.select(column).distinct().filter(F.col(column).isNotNull())
    return known.withColumn("code", F.dense_rank().over(W.orderBy(F.col(column).cast("int"))) - 1)


def date_split(train_end: str, val_end: str, test_end: str, month: str = "month") -> Column:
    """train, val or test by month; null from test_end on."""
    m = F.col(month)
    return F.when(m < train_end, "train").when(m < val_end, "val").when(m < test_end, "test")


def ratio_split(rows: DataFrame, order: list[str], train: float = 0.7, val: float = 0.15, joint: bool = False) -> DataFrame:
    """rows plus split by position; joint truncates both bounds of n * (train + val) at once."""
    a = F.floor(F.col("_n") * train)
    b = F.floor(F.col("_n") * (train + val)) if joint else a + F.floor(F.col("_n") * val)
    placed = positioned(rows, order)
    return placed.withColumn("split", F.when(F.col("_i") < a, "train").when(F.col("_i") < b, "val").otherwise("test")).drop("_n", "_i")


def scaler(rows: DataFrame, columns: list[str], fit: Column, kind: str = "standard") -> DataFrame:
    """One row: each column's centre and divisor on the rows where fit is true.

    standard: mean and population deviation; minmax: least value and range. A divisor that
    is 0 or undefined is 1; nulls are skipped.
    """
    on = lambda c: F.when(fit, F.col(c))
    if kind == "standard":
        stats = {c: (F.avg(on(c)), F.stddev_pop(on(c))) for c in columns}
    elif kind == "minmax":
        stats = {c: (F.min(on(c)), F.max(on(c)) - F.min(on(c))) for c in columns}
    else:
        raise ValueError(f"unknown scaler {kind}")
    divisor = lambda x: F.coalesce(F.nullif(x.cast("double"), F.lit(0.0)), F.lit(1.0))
    return rows.agg(*[x for c, (a, b) in stats.items() for x in (a.cast("double").alias(f"_{c}_centre"), divisor(b).alias(f"_{c}_divisor"))])


def scaled_by(rows: DataFrame, fitted: DataFrame, columns: list[str], inverse: bool = False) -> DataFrame:
    """rows with columns scaled by a fitted scaler, or taken back to their own units. Nulls stay."""
    out = rows.join(F.broadcast(fitted))  # one row
    part = lambda c, x: F.col(f"`_{c}_{x}`")
    at = (lambda c: F.col(f"`{c}`") * part(c, "divisor") + part(c, "centre")) if inverse else (lambda c: (F.col(f"`{c}`") - part(c, "centre")) / part(c, "divisor"))
    return out.withColumns({c: at(c) for c in columns}).select(*[f"`{c}`" for c in rows.columns])


def scale(rows: DataFrame, columns: list[str], fit: Column, kind: str = "standard") -> DataFrame:
    """Columns scaled by what holds on the rows where fit is true."""
    return scaled_by(rows, scaler(rows, columns, fit, kind), columns)


def first_part(rows: DataFrame, order: list[str], ratio: float = 0.7, name: str = "fits") -> DataFrame:
    """rows plus whether they are in the first part of the table's order, for fitting where there are no dates to split by."""
    return positioned(rows, order).withColumn(name, F.col("_i") < F.floor(F.col("_n") * ratio)).drop("_i", "_n")


def scale_with_target(rows: DataFrame, features: list[str], target: str, fit: Column, kind: str = "standard") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scaled rows, scaler of the features, scaler of the target); features in the order of their names, the target last and scaled apart."""
    features = sorted(c for c in features if c != target)
    fitted, own = scaler(rows, features, fit, kind), scaler(rows, [target], fit, kind)
    out = scaled_by(scaled_by(rows, fitted, features), own, [target])
    rest = [c for c in rows.columns if c not in (*features, target)]
    return out.select(*[f"`{c}`" for c in (*rest, *features, target)]), fitted, own


def sequences(rows: DataFrame, features: list[str], target: str, steps: int, max_gap: int | None = None, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(by..., time, x, y): features of the `steps` rows before each row, and the row's target.

    With max_gap, only where all the months involved are at most that far apart. Too short
    a history gives no rows.
    """
    w = W.partitionBy(*by).orderBy("month")
    before = w.rowsBetween(-steps, -1)
    row = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    out = rows.withColumns({"x": F.transform(F.collect_list(F.struct(row.alias("v"))).over(before), lambda s: s["v"]), "_n": F.row_number().over(w)})
    if max_gap is not None:
        out = out.withColumn("_gap", month_gap(F.lag("month").over(w), "month")).withColumn("_gap", F.max("_gap").over(w.rowsBetween(-(steps - 1), 0))).filter(F.col("_gap") <= max_gap)
    return out.filter(F.col("_n") > steps).select(*by, F.col("month").alias("time"), "x", F.col(target).cast("double").alias("y"))


def scale_sequences(seqs: DataFrame, fit: Column, features: int) -> DataFrame:
    """x and y of sequences scaled on the rows where fit is true, x by feature over all steps."""
    long = seqs.filter(fit).select(F.explode("x").alias("v"))
    one = long.agg(*[f(F.col("v")[k]).alias(f"_{n}{k}") for k in range(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    ys = seqs.filter(fit).agg(F.avg("y").alias("_my"), F.stddev_pop("y").alias("_sy"))
    out = seqs.join(F.broadcast(one)).join(F.broadcast(ys))  # one row each
    unit = lambda s: F.coalesce(F.nullif(F.col(s), F.lit(0.0)), F.lit(1.0))
    x = F.transform("x", lambda v: F.array(*[(v[k] - F.col(f"_m{k}")) / unit(f"_s{k}") for k in range(features)]))
    return out.withColumns({"x": x, "y": (F.col("y") - F.col("_my")) / unit("_sy")}).select(*seqs.columns)


def sampled_symbols(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The rows of n symbols, picked by a hash."""
    picked = rows.select("symbol").distinct().orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "symbol").cast("binary")), "symbol").limit(n)
    return rows.join(picked, "symbol", "left_semi")


#: Names of the final panel's columns, without the suffix that tells a current window from a lagged one.
RENAMED = {f"{c}_current": c for c in ("mom12m", "chmom", "maxret", "mve", "dolvol")}


def final_columns(panel: DataFrame, drop: tuple[str, ...] = ("sp_year", "agr_year")) -> DataFrame:
    """Without the dropped columns, and with the current windows under the plain names in place of the lagged ones."""
    there = {a: b for a, b in RENAMED.items() if a in panel.columns}
    return panel.drop(*drop, *there.values()).withColumnsRenamed(there)


def positions(rows: DataFrame, order: list[str], start: int, stop: int | None = None) -> DataFrame:
    """The rows from one place to before another in the table's order; places below 0 count from the end."""
    at = lambda k: F.lit(k) if k >= 0 else F.col("_n") + k
    placed = positioned(rows, order)
    kept = placed.filter((F.col("_i") >= at(start)) & (F.lit(True) if stop is None else F.col("_i") < at(stop)))
    return kept.drop("_i", "_n")


def cross_section(panel: DataFrame, macro: DataFrame, firm: list[str], macro_columns: list[str], splits: tuple[str, str, str], target: str = "mom1m", kind: str = "standard") -> DataFrame:
    """A row a symbol and month with its split, firm columns and target scaled on the training rows and macro columns on the training months."""
    scaled = scale(macro, macro_columns, F.col("month") < splits[0], kind)
    rows = panel.join(F.broadcast(scaled), "month", "left").withColumn("split", date_split(*splits)).filter("split is not null")  # a row a month
    return scale_with_target(rows, firm, target, F.col("split") == "train", kind)[0]


def firm_and_macro_sequences(rows: DataFrame, firm: list[str], macro: list[str], target: str, firm_steps: int, macro_steps: int, by: tuple[str, ...] = ("split", "symbol")) -> tuple[DataFrame, DataFrame]:
    """(by, time, x, y) of firm windows and (by, time, macro_x) of macro windows, each of its own length, over the same rows."""
    own = sequences(rows, firm, target, firm_steps, by=by)
    return own, sequences(rows, macro, target, macro_steps, by=by).withColumnRenamed("x", "macro_x").drop("y")


def joint_sequences(rows: DataFrame, firm: list[str], macro: list[str], target: str, firm_steps: int, macro_steps: int, by: tuple[str, ...] = ("split", "symbol")) -> DataFrame:
    """(by, time, x, macro_x, y): the firm and the macro window that end before each row which has both, in one pass over a key's rows."""
    w = W.partitionBy(*by).orderBy("month")
    rows = rows.withColumns({f"_{k}": F.array(*[F.col(f"`{c}`").cast("double") for c in cs]) for k, cs in (("firm", firm), ("macro", macro))})
    # A frame would gather its rows anew for each row; lags only point at them.
    window = lambda c, n: F.array(*[F.lag(c, k).over(w) for k in range(n, 0, -1)])
    out = rows.withColumns({"x": window("_firm", firm_steps), "macro_x": window("_macro", macro_steps), "_n": F.row_number().over(w)})
    return out.filter(F.col("_n") > max(firm_steps, macro_steps)).select(*by, F.col("month").alias("time"), "x", "macro_x", F.col(target).cast("double").alias("y"))
