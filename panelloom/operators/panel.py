"""Assembling, filling and joining the symbol-month panel."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.periods import month_id, months_between
from ..functions.windows import by_months
from .filling import filled as filled_rows

FUNDAMENTALS = ("ep_quarter", "sp_quarter", "agr_quarter", "ep_year", "sp_year", "agr_year")
#: Months of the calendar that a slice of a long key holds at most, and the largest power of e in the running sums of a weighted fill.
BLOCK_MONTHS, LARGEST_POWER = 240, 300.0


def by_frequency(ratios: DataFrame) -> DataFrame:
    """(symbol, freq, month, ...) -> one column a measure and frequency."""
    measures = [c for c in ratios.columns if c not in ("symbol", "freq", "month")]
    return ratios.groupBy("symbol", "month").agg(*[F.max(F.when(F.col("freq") == q, F.col(m))).alias(f"{m}_{q}") for q in ("quarter", "year") for m in measures])


def assemble(monthly: DataFrame, *others: DataFrame, static: DataFrame | None = None) -> DataFrame:
    """Full outer join on symbol and month: a filing month without bars has a row."""
    for other in others:
        monthly = monthly.join(other, ["symbol", "month"], "full")
    return monthly if static is None else monthly.join(static, "symbol", "left")


def merged(monthly: DataFrame, *others: DataFrame) -> DataFrame:
    """As assemble, of tables with one row a symbol and month and columns of their own: dealt by symbol, as what follows needs them, and no join."""
    rows = [t.withColumn("_side", F.when(F.col("symbol").isNull() | F.col("month").isNull(), F.lit(k))) for k, t in enumerate((monthly, *others))]  # null keys meet nothing
    both = rows[0]
    for t in rows[1:]:
        both = both.unionByName(t, allowMissingColumns=True)
    values = [c for c in both.columns if c not in ("symbol", "month", "_side")]
    return both.repartition("symbol").groupBy("symbol", "month", "_side").agg(*[F.max(c).alias(c) for c in values]).drop("_side")


def forward_fill(panel: DataFrame, columns: tuple[str, ...] = FUNDAMENTALS) -> DataFrame:
    run = by_months().rowsBetween(W.unboundedPreceding, W.currentRow)
    return panel.withColumns({c: F.last(c, ignorenulls=True).over(run) for c in columns if c in panel.columns})


def _as_is(rows: DataFrame) -> DataFrame:
    return rows


def ewm_fill(panel: DataFrame, columns: tuple[str, ...], half_life: float = 5.0, lead: bool = True, key: str = "symbol", order: str = "month", keep: Callable[[DataFrame], DataFrame] = _as_is) -> DataFrame:
    """Nulls before a column's first value become 0 (if lead), later ones the exponentially weighted mean so far.

    The weight of what is known decays over null rows too; leading zeros are part of the
    series. A column without values becomes 0. order holds yyyy-MM keys. Rows with a null key
    are one key.

    With g rows from one value to the next, the mean w turns to a(g) w + (1 - a(g)) x. Keys'
    sorted rows go through arrays, many keys a step. Keys with more rows than running sums have
    room for are cut into slices (see _filled_by_slices), so no task has to go through all of a
    long key. `keep` may persist the rows, which are read more than once.
    """
    rate = math.log(0.5) / half_life
    at_most = max(1, int(LARGEST_POWER / -rate))
    rows = keep(panel.selectExpr(*[f"cast(`{c}` as double) as `{c}`" if c in columns else f"`{c}`" for c in panel.columns]))
    long = rows.groupBy(key).count().filter(F.col("count") > at_most).select(key)
    whole = rows.filter(F.col(key).isNotNull()).join(long, key, "left_anti").withColumn("_p", F.row_number().over(W.partitionBy(key).orderBy(order)).cast("long"))
    present = [c for c in panel.columns if c in columns]
    # The window leaves rows sorted by key and place, as they are gone through.
    out = whole.select(*[f"`{c}`" for c in rows.columns], "_p").mapInArrow(lambda batches: filled_rows(batches, present, rate, lead, at_most), rows.schema)
    sliced = rows.join(long, key, "left_semi").unionByName(rows.filter(F.col(key).isNull()))
    return out.unionByName(_filled_by_slices(sliced, columns, rate, at_most, lead, key, order))


def _kept(gap: str, rate: float) -> str:
    """The share that a mean keeps when a value comes `gap` rows after the last."""
    return f"exp({rate!r}D * ({gap})) / (exp({rate!r}D * ({gap})) + {1 - math.exp(rate)!r}D)"


def _running_means(rows: DataFrame, named: list[tuple[int, str]], by: str, rate: float, first: str) -> DataFrame:
    """rows plus, for each column, the place _before of its last value, the mean so far, and as a power of e what is left of its first value.

    _p is a row's place, from 1; `first` is the share that the first value has in itself.
    """
    over = f"over (partition by {by} order by _p rows between unbounded preceding and {{}})"
    before, upto = over.format("1 preceding"), over.format("current row")
    seen = rows.selectExpr("*", *[f"last(nvl2(`{c}`, _p, null), true) {before} as _before{i}" for i, c in named])
    seen = seen.selectExpr("*", *[_kept(f"_p - _before{i}", rate) + f" as _kept{i}" for i, _ in named])
    seen = seen.selectExpr("*", *[f"coalesce(sum(nvl2(`{c}`, ln(_kept{i}), null)) {upto}, 0D) as _power{i}" for i, c in named])
    return seen.selectExpr("*", *[f"sum(coalesce(1 - _kept{i}, {first}) * `{c}` * exp(-_power{i})) {upto} * exp(_power{i}) as _mean{i}" for i, c in named])


def _filled_by_slices(rows: DataFrame, columns: tuple[str, ...], rate: float, at_most: int, lead: bool, key: str, order: str) -> DataFrame:
    """As ewm_fill, of keys with many rows.

    A slice's means are taken as if nothing came before it; what does adds a share that decays
    along the slice. A key's slices, a row each, are folded in order into what enters each.
    In a struct, null keys are equal.
    """
    named = list(enumerate(columns))
    at = F.row_number().over(W.partitionBy("_of", "_block").orderBy(order)) - 1
    cut = rows.withColumn("_of", F.struct(key)).withColumn("_block", F.floor(month_id(order) / BLOCK_MONTHS)).withColumn("_at", at).selectExpr("*", f"floor(_at / {at_most}) as _part", f"cast(_at % {at_most} + 1 as bigint) as _p").drop("_at")
    by = "_of, _block, _part"
    seen = _running_means(cut, named, by, rate, "1D")
    upto = f"over (partition by {by} order by _p rows between unbounded preceding and current row)"
    # Until a slice's first value only that one has none before it.
    first = [f"{x} {upto} as _first_{n}{i}" for i, c in named for n, x in (("p", f"min(nvl2(`{c}`, _p, null))"), ("x", f"max(if(_before{i} is null, `{c}`, null))"))]
    ends = seen.selectExpr("*", f"lead(_p) over (partition by {by} order by _p) as _next", *first).filter("_next is null")
    summary = [f"struct(_first_p{i} as p, _first_x{i} as x, nvl2(`{c}`, _p, _before{i}) as last, _power{i} as power, _mean{i} as mean) as c{i}" for i, c in named]
    slices = ends.selectExpr("_of as _key", "struct(_block, _part, _p as n, " + ", ".join(summary) + ") as _s").groupBy("_key").agg(F.array_sort(F.collect_list("_s")).alias("_slices"))
    states = slices.selectExpr("_key", "posexplode(_slices) as (_k, _s)", *[_entering(f"s.c{i}", rate, lead) + f" as _in{i}" for i, _ in named])
    states = states.selectExpr("_key", "_s._block as _of_block", "_s._part as _of_part", *[f"_in{i}[_k] as _in{i}" for i, _ in named])
    both = seen.join(states, F.expr("_of = _key and _block = _of_block and _part = _of_part"))
    filled = {c: f"coalesce(`{c}`, nvl2(_before{i}, _mean{i} + exp(_power{i}) * _in{i}.share, _in{i}.mean){', 0D' if lead else ''}) as `{c}`" for i, c in named}
    return both.selectExpr(*[filled.get(c, f"`{c}`") for c in rows.columns])


def _entering(c: str, rate: float, lead: bool) -> str:
    """Fold over a key's slices in order: for each, the mean that enters it and, times what decays along it, its part of the slice's means."""
    share = f"""case when {c}.p is null then null when a.mean is not null then {_kept(f"a.rows + {c}.p - a.last", rate)} * (a.mean - {c}.x)
                when {str(lead).lower()} and a.rows + {c}.p > 1 then {_kept("1", rate)} * -{c}.x else 0D end"""
    return f"""aggregate(_slices, named_struct('mean', cast(null as double), 'last', cast(null as bigint), 'rows', 0L, 'out', cast(array() as array<struct<mean: double, share: double>>)),
        (a, s) -> named_struct('mean', if({c}.p is null, a.mean, {c}.mean + exp({c}.power) * ({share})), 'last', if({c}.p is null, a.last, a.rows + {c}.last),
                               'rows', a.rows + s.n, 'out', concat(a.out, array(named_struct('mean', a.mean, 'share', {share})))), a -> a.out)"""


def join_macro(panel: DataFrame, macro: DataFrame) -> DataFrame:
    return panel.join(F.broadcast(macro), "month", "left")  # a row a month


def join_macro_dense(panel: DataFrame, macro: DataFrame) -> DataFrame:
    """With a row for every month of macro between a symbol's first and last, whether or not the symbol has it."""
    bounds = panel.groupBy("symbol").agg(F.min("month").alias("_lo"), F.max("month").alias("_hi"))
    grid = bounds.select("symbol", F.explode(months_between(F.col("_lo"), F.col("_hi"))).alias("month"))
    own = grid.join(F.broadcast(macro), "month").select("symbol", "month", *[c for c in macro.columns if c != "month"])  # a row a month
    return panel.join(own, ["symbol", "month"], "full")


def drop_groups(panel: DataFrame, groups: dict[str, list[str]], remove: Iterator[str] | tuple[str, ...]) -> DataFrame:
    """Without the columns of the named groups; unknown names are ignored."""
    return panel.drop(*[c for g in remove for c in groups.get(g, [])])


def column_groups(columns: list[str], static: tuple[str, ...] = ("sic2", "industry", "division", "exchange")) -> dict[str, list[str]]:
    """Groups of a panel's columns: current windows, the lagged ones they stand for, sub-features and static ones."""
    current = [c for c in columns if c.endswith("_current")]
    lagged = [c for c in columns if f"{c}_current" in current]
    sub = [c for c in ("close", "dollar_volume", "volume", "days", "zero_days", "max_ret", "latest_week", "ret_std", "illiquidity", "shares", "turnover_std", "market_cap", "rolling_return", "rolling_return_current") if c in columns]
    return {"current": current, "lagged": lagged, "subfeatures": sub, "static": [c for c in columns if c in static]}


def static_values(panel: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(symbol, columns): a symbol's first known value of each, by month."""
    return panel.groupBy("symbol").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("month"))).alias(c) for c in columns])


def format_panel(panel: DataFrame, macro: DataFrame, fill: tuple[str, ...], keep: Callable[[DataFrame], DataFrame] = _as_is) -> DataFrame:
    """Forward fill, then drop rows without mom1m, then macro, then the weighted fill: the order matters."""
    return ewm_fill(join_macro(forward_fill(panel).dropna(subset=["mom1m"]), macro), fill, keep=keep)


def status(tables: dict[str, DataFrame], symbols: DataFrame) -> DataFrame:
    """(symbol, status, reason): the first table, in order, that has no row for the symbol."""
    out = symbols.select("symbol").distinct()
    for name, t in tables.items():
        out = out.join(t.select("symbol").distinct().withColumn(f"_{name}", F.lit(True)), "symbol", "left")
    reason = F.coalesce(*[F.when(F.col(f"_{name}").isNull(), F.lit(name)) for name in tables])
    return out.select("symbol", F.when(reason.isNull(), "success").otherwise("invalid").alias("status"), reason.alias("reason"))


def without_penny_stocks(bars: DataFrame, unadjusted: DataFrame, least: float = 0.1) -> DataFrame:
    """Without symbols that ever closed below `least`."""
    low = unadjusted.groupBy("symbol").agg(F.min("adj_close").alias("low")).filter(F.col("low") < least)
    return bars.join(low, "symbol", "left_anti")


#: What a symbol must have, in the order in which it is looked at.
REQUIRED = ("prices", "unadjusted_prices", "market_cap", "annual_income", "annual_balance", "quarterly_income", "quarterly_balance")


def validity(documents: DataFrame, *others: str) -> DataFrame:
    """(symbol, valid, reason, others) of stock documents: the first required list, in order, that is missing or empty; other columns as they are."""
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0  # noqa: E731  the size of null is -1
    lists = {"prices": "eod", "unadjusted_prices": "eod_unadj", "market_cap": "market_cap"}
    lists |= {f"{q}_{k.split('_')[0]}": f"financials_{q}.{k}_{'statement' if k == 'income' else 'sheet'}" for q in ("annual", "quarterly") for k in ("income", "balance")}
    reason = F.coalesce(*[F.when(empty(F.col(lists[name])), F.lit(name)) for name in REQUIRED])
    return documents.select("symbol", reason.isNull().alias("valid"), reason.alias("reason"), *others)


def report(validities: DataFrame, made: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """(symbol, status, reason, rows): of every symbol asked for, whether it gave rows of `made`, was invalid, gave none or has no document."""
    rows = made.groupBy("symbol").agg(F.count("*").alias("rows"))
    asked = validities.select("symbol") if symbols is None else symbols.select("symbol").distinct()
    out = asked.join(validities, "symbol", "left").join(rows, "symbol", "left")
    status = F.when(F.col("valid").isNull(), "missing").when(~F.col("valid"), "invalid").when(F.col("rows").isNull(), "failed").otherwise("success")
    return out.select("symbol", status.alias("status"), "reason", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))


def strict(panel: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Without symbols that have a null in a required column of a month with bars."""
    bad = panel.filter(F.coalesce(*[F.when(F.col(c).isNull(), F.lit(True)) for c in required], F.lit(False))).select("symbol").distinct()
    return panel.join(bad, "symbol", "left_anti")
