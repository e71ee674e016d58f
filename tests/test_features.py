"""Small fixtures of the panel engine."""

from __future__ import annotations

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.functions import periods
from panelloom.operators import audits, bars, features, mlprep, moe, panel, ranks
from panelloom.sources import config, dataset, documents, http, macro, sic, upsert


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_iso_weeks_and_month_gap(spark):
    df = spark.createDataFrame([(date(2018, 12, 31),), (date(2021, 1, 1),)], "d date").select(periods.week_key("d"))
    assert [r[0] for r in df.collect()] == ["2019-01", "2020-53"]
    g = spark.createDataFrame([("2020-01", "2020-02"), ("2020-02", "2020-09")], "a string, b string").select(periods.month_gap("a", "b"))
    assert [r[0] for r in g.collect()] == [0, 6]


def _bars(spark, rows):
    return spark.createDataFrame(rows, "symbol string, date date, price double, volume double")


def test_single_bar_and_zero_price(spark):
    m = features.with_momentum(bars.monthly_summary(bars.daily_returns(_bars(spark, [("A", date(2020, 1, 2), 5.0, 1.0), ("B", date(2020, 1, 2), 0.0, 1.0), ("B", date(2020, 2, 3), 4.0, 1.0)]))))
    assert rows_of(m.select("symbol", "month", "mom1m"), "symbol", "month") == [("A", "2020-01", None), ("B", "2020-01", None), ("B", "2020-02", None)]


def test_zero_volume_month_and_one_day_month(spark):
    b = _bars(spark, [("A", date(2020, 1, 2), 5.0, 0.0), ("A", date(2020, 1, 3), 5.0, 0.0), ("A", date(2020, 2, 3), 6.0, 2.0)])
    b = b.withColumns({"shares": F.lit(10.0), "market_cap": F.col("price") * 10})
    r = features.with_liquidity(features.with_momentum(bars.monthly_summary(bars.daily_returns(b)))).orderBy("month").collect()
    assert (r[0]["dolvol_current"], r[0]["ill"], r[0]["zero_days"], r[0]["days"]) == (0.0, None, 2, 2)
    assert r[1]["retvol"] == 0.0 and r[1]["std_turn"] is None and r[1]["max_ret"] == pytest.approx(20.0)


def test_lags_count_present_months(spark):
    b = _bars(spark, [("A", date(2020, m, 3), float(m), 1.0) for m in (1, 2, 9)])
    r = rows_of(features.with_momentum(bars.monthly_summary(bars.daily_returns(b))).select("month", "mom1m"), "month")
    assert r[2] == ("2020-09", pytest.approx(350.0))


def test_risk_against_a_loop(spark):
    rng = np.random.default_rng(0)
    days = [date(2015, 1, 5) + timedelta(days=7 * k) for k in range(210)]
    prices = {s: np.exp(np.cumsum(rng.normal(0, 0.03, 210))) * 10 for s in "ABC"}
    b = _bars(spark, [(s, d, float(p), 1.0) for s in "ABC" for d, p in zip(days, prices[s], strict=True)])
    w = bars.weekly_returns(b)
    got = {(r["symbol"], r["month"]): r for r in features.rolling_risk(bars.monthly_summary(bars.daily_returns(b)), w, features.market_returns(w)).collect()}
    ret = {s: np.concatenate([[np.nan], np.diff(p) / p[:-1] * 100])[::-1] for s, p in prices.items()}  # latest first
    market = np.mean([ret[s] for s in "ABC"], axis=0)
    months = sorted({d.strftime("%Y-%m") for d in days}, reverse=True)
    week_month = [d.strftime("%Y-%m") for d in days][::-1]
    for s in "ABC":
        for kind, first in (("beta", 1), ("beta_current", 0)):
            w0 = week_month.index(months[first])
            for i, m in enumerate(months):
                a = w0 + 4 * i
                want = None
                if a + 52 < 210:
                    x, y = ret[s][a : a + 52], market[a : a + 52]
                    want = np.cov(x, y, ddof=1)[0, 1] / np.var(y)
                assert got[s, m][kind] == (None if want is None else pytest.approx(want, rel=1e-9))
        a = week_month.index(months[1])
        x, y = ret[s][a : a + 156], market[a : a + 156]
        slope = np.cov(x, y, ddof=0)[0, 1] / np.var(y)
        assert got[s, months[0]]["idiovol"] == pytest.approx(np.std(x - slope * y), rel=1e-8)
        assert got[s, months[0]]["rolling_return"] == pytest.approx(x.mean())


def test_windows_with_gaps_and_older_weeks(spark):
    rng = np.random.default_rng(3)
    weeks = [f"{2000 + k // 50}-{k % 50 + 1:02d}" for k in range(40)]
    ret = {s: [None if rng.random() < p else float(v) for v in rng.normal(0, 3, 40)] for s, p in (("A", 0.0), ("B", 0.1), ("C", 0.5), ("D", 1.0))}
    market = {w: None if k == 20 else float(rng.normal(0, 1)) if k < 30 else 0.1 for k, w in enumerate(weeks)}
    rows = spark.createDataFrame([(s, w, v, 3 if s == "B" else 0) for s in ret for w, v in zip(weeks, ret[s], strict=True)], "symbol string, week string, ret double, older int")
    made = features.rolled_weeks(rows, spark.createDataFrame(list(market.items()), "week string, market double"), 8, 4)
    assert "-7" not in made._jdf.queryExecution().toString()  # no frame that goes over its window anew at each row
    got = {(r["symbol"], r["week"]): (r["mean"], r["beta"], r["idio"]) for r in made.collect()}
    assert len(got) == 160
    for s in ret:
        for k, w in enumerate(weeks):
            whole = lambda n: k + 1 >= n and k + 1 + (3 if s == "B" else 0) > n  # noqa: B023, E731
            pairs = lambda n: [(a, market[v]) for a, v in zip(ret[s][k + 1 - n : k + 1], weeks[k + 1 - n : k + 1], strict=True) if a is not None and market[v] is not None]  # noqa: B023, E731
            known = [v for v in ret[s][max(0, k - 7) : k + 1] if v is not None]
            want = [np.mean(known) if whole(8) and known else None, None, None]
            for i, n in ((1, 4), (2, 8)):
                x, y = np.array(pairs(n)).T if whole(n) and len(pairs(n)) == n else (np.zeros(1), np.zeros(1))
                if (y != y[0]).any():
                    want[i] = np.cov(x, y)[0, 1] / np.var(y) if i == 1 else np.std(x - np.cov(x, y, ddof=0)[0, 1] / np.var(y) * y)
            assert got[s, w] == tuple(None if v is None else pytest.approx(v, rel=1e-9) for v in want)


def test_latest_weeks_of_months(spark):
    days = [date(2019, 12, 30), date(2020, 1, 2), date(2020, 1, 31), date(2020, 2, 1), date(2020, 2, 2), date(2020, 5, 1)]
    b = _bars(spark, [(s, d, 1.0, 1.0) for s in "AB" for d in days[: 4 if s == "B" else 6]])
    want = bars.monthly_summary(bars.daily_returns(b)).select("symbol", "month", "latest_week")
    assert rows_of(bars.latest_weeks(bars.weekly_returns(b)), "symbol", "month") == rows_of(want, "symbol", "month")


def test_as_of_cap(spark):
    caps = spark.createDataFrame([("A", date(2020, 1, 10), 10.0), ("A", date(2020, 1, 20), 30.0), ("A", date(2020, 2, 1), 0.0)], "symbol string, date date, market_cap double")
    days = {date(2020, 1, 10): 10.0, date(2020, 1, 15): 20.0, date(2020, 3, 1): None, date(2020, 1, 1): None, date(2020, 2, 1): None}
    st = spark.createDataFrame([("A", d) for d in days], "symbol string, date date")
    assert {r["date"]: r["cap"] for r in features.as_of_cap(st, caps).collect()} == days


def test_as_of_cap_sorts_no_caps_but_those_next_to_statements(spark):
    rng, day = random.Random(3), lambda k: date(2020, 1, 1) + timedelta(k)
    held = {(s, day(k)): rng.choice([0.0, None, float(k + 1)]) if rng.random() < 0.2 else float(k + 1) for s in "ABC" for k in range(120) if rng.random() < 0.3}
    asked = [(s, day(k)) for s in "ABCD" for k in rng.sample(range(-10, 130), 12)]
    caps = spark.createDataFrame([(*k, v) for k, v in held.items()], "symbol string, date date, market_cap double")

    def near(s, d):
        lo, hi = max((x for t, x in held if t == s and x <= d), default=None), min((x for t, x in held if t == s and x >= d), default=None)
        if lo is None or lo == d or hi is None:
            v = None if lo is None else held[s, lo]
        else:
            v = None if None in (held[s, lo], held[s, hi]) else (held[s, lo] + held[s, hi]) / 2
        return v or None

    made = features.as_of_cap(spark.createDataFrame(asked, "symbol string, date date"), caps)
    assert {(r["symbol"], r["date"]): r["cap"] for r in made.collect()} == {k: near(*k) for k in asked}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Window [last") :]
    assert "Aggregate" in below.split("LocalRelation")[0] or "Aggregate" in below.split("LogicalRDD")[0]


def test_bars_become_months_and_weeks_without_a_sort_by_text(spark):
    b = _bars(spark, [("A", date(2020, 1, 2), 5.0, 1.0), ("A", date(2020, 12, 31), 6.0, 1.0), ("A", date(2021, 1, 1), 7.0, 2.0)])
    for made in (bars.monthly_summary(bars.daily_returns(b)), bars.weekly_returns(b), bars.latest_weeks(bars.weekly_returns(b, periods.week_start))):
        assert "SortAggregate" not in made._jdf.queryExecution().sparkPlan().toString()
    assert rows_of(bars.weekly_returns(b).select("week", "close"), "week") == [("2020-01", 5.0), ("2020-53", 7.0)]
    assert rows_of(bars.monthly_summary(bars.daily_returns(b)).select("month", "latest_week"), "month") == [("2020-01", "2020-01"), ("2020-12", "2020-53"), ("2021-01", "2020-53")]


def test_merged_is_assemble_without_a_join(spark):
    m = spark.createDataFrame([("A", "2020-01", 1.0, 5), ("A", "2020-03", None, None), (None, "2020-01", 3.0, 1), ("B", None, 4.0, 1)], "symbol string, month string, mom1m double, days long")
    f = spark.createDataFrame([("A", "2020-02", 7.0), ("A", "2020-03", 8.0), (None, "2020-01", 9.0), ("B", None, 2.0)], "symbol string, month string, ep double")
    made, key = panel.merged(m, f), lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, made.collect()), key=key) == sorted(map(tuple, panel.assemble(m, f).collect()), key=key)
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("lead", [True, False])
def test_ewm_fill_goes_on_from_batch_to_batch(spark, lead):
    rng = random.Random(1)
    rows = [(s, f"{2000 + k // 12}-{k % 12 + 1:02d}", *[rng.random() if rng.random() < 0.4 else None for _ in range(2)]) for s in "ABCDEFG" for k in range(rng.randrange(1, 30))]
    df = spark.createDataFrame(rows, "symbol string, month string, v double, w double").coalesce(1)
    fill = lambda: panel.ewm_fill(df, ("w", "v"), lead=lead)
    want = rows_of(fill(), "symbol", "month")
    assert "MapInArrow" in fill()._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        assert rows_of(fill(), "symbol", "month") == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_filing_collision_and_oldest_growth(spark):
    st = spark.createDataFrame(
        [("A", "quarter", date(2020, 3, 31), date(2020, 5, 1), 100.0), ("A", "quarter", date(2020, 6, 30), date(2020, 8, 1), 110.0), ("A", "quarter", date(2020, 7, 31), date(2020, 8, 20), 121.0)],
        "symbol string, freq string, date date, filing_date date, total_assets double",
    )
    assert rows_of(features.asset_growth(st).select("month", "agr"), "month") == [("2020-05", None), ("2020-08", pytest.approx(10.0))]


def test_filing_month_without_bars_feeds_later_months(spark):
    m = spark.createDataFrame([("A", "2020-01", 1.0), ("A", "2020-03", 2.0)], "symbol string, month string, mom1m double")
    f = spark.createDataFrame([("A", "2020-02", 7.0)], "symbol string, month string, ep_quarter double")
    out = panel.forward_fill(panel.assemble(m, f), ("ep_quarter",)).dropna(subset=["mom1m"])
    assert rows_of(out.select("month", "ep_quarter"), "month") == [("2020-01", None), ("2020-03", 7.0)]


def test_ewm_fill(spark):
    x = [None, None, 1.0, 2.0, None, None, 5.0, None, 6.0]
    df = spark.createDataFrame([("A", f"2020-{i + 1:02d}", v, None) for i, v in enumerate(x)], "symbol string, month string, v double, n double")
    r = panel.ewm_fill(df, ("v", "n")).orderBy("month").collect()
    assert [round(q["v"], 6) for q in r] == [0, 0, 1, 2, 0.371591, 0.371591, 5, 1.130768, 6]
    assert all(q["n"] == 0 for q in r)


@pytest.mark.parametrize(("half_life", "lead"), [(5.0, True), (0.3, True), (0.3, False)])
def test_ewm_fill_of_long_keys_against_pandas(spark, monkeypatch, half_life, lead):
    """A half-life of 0.3 leaves room for 129 rows of a key; blocks of the calendar cut them too."""
    monkeypatch.setattr(panel, "BLOCK_MONTHS", 50)
    rng, rows = np.random.default_rng(0), []
    for key, n in (("hot", 700), ("b", 100), ("c", 3), (None, 200)):
        for m in range(1900 * 12, 1900 * 12 + n):
            if rng.random() < 0.9:
                at = m - 1900 * 12
                rows.append((key, f"{m // 12}-{m % 12 + 1:02d}", *[None if rng.random() < gaps or at < lo else float(rng.normal() * 10.0 ** rng.integers(-3, 4)) for gaps, lo in ((0.1, 0), (0.9, 30), (0.99, 200), (1, 0))]))
    df = spark.createDataFrame(rows, "symbol string, month string, a double, b double, c double, d double")
    columns = list("abcd")
    want = {}
    for key, g in df.toPandas().sort_values("month").groupby("symbol", dropna=False):
        x = g[columns].astype(float)
        x = x.where(x.ffill().notna(), 0.0) if lead else x
        x = x.where(x.notna(), x.ewm(halflife=half_life, adjust=False).mean())
        want |= {(None if key != key else key, m): v for m, v in zip(g["month"], x.to_numpy().tolist(), strict=True)}
    got = {(r["symbol"], r["month"]): r for r in panel.ewm_fill(df, tuple(columns), half_life, lead).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert [got[k][c] for c in columns] == [None if x != x else pytest.approx(x, rel=1e-9, abs=1e-12) for x in v]


def test_dense_macro_join(spark):
    m = spark.createDataFrame([("A", "2020-01", 1.0), ("A", "2020-03", 2.0)], "symbol string, month string, x double")
    macro = spark.createDataFrame([(f"2020-{k:02d}", float(k)) for k in range(1, 6)], "month string, q double")
    assert rows_of(panel.join_macro_dense(m, macro), "month") == [("A", "2020-01", 1.0, 1.0), ("A", "2020-02", None, 2.0), ("A", "2020-03", 2.0, 3.0)]


def test_run_filter(spark):
    months = [f"{2000 + k // 12}-{k % 12 + 1:02d}" for k in range(40)]
    df = spark.createDataFrame([("A", m) for m in [*months[:11], *months[18:30]]], "symbol string, month string")
    r = rows_of(audits.run_lengths(df), "month")
    assert [k for *_, k in r] == [False] * 11 + [True] * 12


def test_gaps_and_nulls_after_first(spark):
    df = spark.createDataFrame([("A", "2020-01", 1.0), ("A", "2020-02", None), ("A", "2020-05", 2.0), ("B", "2020-01", None), ("B", "2020-03", 1.0)], "symbol string, month string, v double")
    assert rows_of(audits.month_gaps(df), "month") == [("2020-04",)]
    assert rows_of(audits.symbol_gaps(df), "symbol") == [("A", "2020-02", "2020-05", 2), ("B", "2020-01", "2020-03", 1)]
    assert rows_of(audits.nulls_after_first(df, ["v"]), "month") == [("v", "A", "2020-02")]
    assert rows_of(audits.nulls_after_first(df, ["v"], strict=True), "month") == []
    assert [r["count"] for r in audits.symbol_gap_lists(df).orderBy("symbol").collect()] == [1, 1]


def test_quantile_bins(spark):
    df = spark.createDataFrame([(float(k), 3.0) for k in (1, 2, 3, 4)], "v double, c double")
    assert rows_of(audits.quantile_bins(df, ["v", "c"], 2).select("column", "low", "high", "count"), "low") == [("v", 1.0, 2.5, 2), ("v", 2.5, 4.0, 2)]


def test_correlated_columns_and_constants(spark):
    df = spark.createDataFrame([(float(k), 2.0 * k, 3.0 * k, 1.0) for k in range(5)], "a double, b double, c double, d double")
    assert rows_of(audits.correlated(df, ["a", "b", "c", "d"]), "column") == [("b",), ("c",)]
    assert audits.without_correlated(df, ["a", "b", "c", "d"]).columns == ["a", "d"]
    r = {(a, b): v for a, b, v in rows_of(audits.correlations(df, ["a", "b"], "kendall"), "a")}
    assert r["a", "b"] == pytest.approx(1)
    assert rows_of(audits.mean_correlations(df, ["a", "b"]), "a")[0][2] == pytest.approx(1)


def test_ranks_of_values_that_differ_from_run_to_run(spark):
    """As sums of doubles do, whose order is open."""
    about = F.udf(lambda v: v + random.random() * 1e-9, "double").asNondeterministic()
    df = spark.createDataFrame([(float(k), float(k * k)) for k in range(9)], "a double, b double").select(about("a").alias("a"), about("b").alias("b"))
    assert rows_of(audits.correlations(df, ["a", "b"], "spearman"), "a")[0][2] == pytest.approx(1)
    assert rows_of(audits.mean_correlations(df, ["a", "b"], ("spearman", "kendall")), "a")[0][2] == pytest.approx(1)


def test_scaler_with_constant_column(spark):
    df = spark.createDataFrame([("2020-01", 4.0, 1.0), ("2020-02", 4.0, 3.0), ("2020-03", 6.0, None)], "month string, c double, v double")
    r = rows_of(mlprep.scale(df, ["c", "v"], F.col("month") < "2020-03"), "month")
    assert r == [("2020-01", 0.0, -1.0), ("2020-02", 0.0, 1.0), ("2020-03", 2.0, None)]


def test_sequences_short_and_gapped(spark):
    df = spark.createDataFrame([("A", f"2020-{k:02d}", float(k)) for k in (1, 2, 3)] + [("B", f"2020-{k:02d}", float(k)) for k in (1, 2, 9, 10)], "symbol string, month string, v double")
    assert rows_of(mlprep.sequences(df, ["v"], "v", 3), "symbol") == [("B", "2020-10", [[1.0], [2.0], [9.0]], 10.0)]
    assert mlprep.sequences(df, ["v"], "v", 2, max_gap=3).count() == 1
    s = mlprep.scale_sequences(mlprep.sequences(df, ["v"], "v", 2), F.lit(True), 1)
    assert abs(sum(r["y"] for r in s.collect())) < 1e-9


def test_splits(spark):
    df = spark.range(13).select(F.col("id").alias("k"))
    count = lambda joint: {r["split"]: r["count"] for r in mlprep.ratio_split(df, ["k"], joint=joint).groupBy("split").count().collect()}
    assert count(True) == {"train": 9, "val": 2, "test": 2} and count(False) == {"train": 9, "val": 1, "test": 3}


def test_moe(spark):
    df = spark.createDataFrame([([1.0, 2.0], [0.25, 0.75])], "e array<double>, g array<double>")
    assert df.select(moe.combine("e", "g")).first()[0] == 1.75
    enc = {(r["position"], r["dim"]): r["value"] for r in moe.sinusoidal_encoding(spark, 3, 4).collect()}
    assert enc[2, 3] == pytest.approx(math.cos(2 / 100)) and enc[1, 0] == pytest.approx(math.sin(1))
    x = spark.createDataFrame([([[1.0, 2.0, None, 4.0]] * 3,)], "x array<array<double>>").select(moe.encoded("x", 4)).first()[0]
    assert all(x[t][i] == (None if i == 2 else pytest.approx(i + 1 + enc[t, i])) for t in range(3) for i in range(4))


def test_universe_and_dedupe(spark):
    codes = spark.createDataFrame([("A", "2011"), ("B", "9999"), ("C", "0001"), ("D.X", "2011"), ("E", "2011"), ("E", "2012"), ("F", "2011")], "symbol string, sicCode string")
    stocks = spark.createDataFrame([("A", "X", "etf", 0), ("A", "Y", "stock", 1), ("B", "X", "stock", 2), ("C", "X", "stock", 3), ("D.X", "X", "stock", 4), ("E", "X", "stock", 5)], "symbol string, exchange string, type string, pos int")
    ok, bad = documents.universe(codes, stocks, sic.sic_dim(spark))
    assert rows_of(ok.select("symbol", "exchange"), "symbol") == [("A", "Y"), ("B", "X")]
    assert [r[0] for r in rows_of(bad, "symbol")] == ["C", "D.X", "F"]
    assert len(sic.rows()) == 83
    d = spark.createDataFrame([("A", 1, 5.0, 0), ("A", 1, 6.0, 1)], "symbol string, date int, v double, pos int")
    assert documents.first_by_date(d).collect()[0]["v"] == 5.0


def test_documents_round_trip(spark, tmp_path):
    (tmp_path / "A.json").write_text('{"symbol": "A", "eod": [{"date": "2020-01-03", "price": 2.0, "volume": 1}, {"date": "2020-01-03", "price": 9.0, "volume": 1}],\n "outstanding_shares": {"2020-01-03": 7},\n "financials_annual": {"income_statement": [{"date": "2019-12-31", "filingDate": "2020-02-10", "revenue": 5}]}}')
    docs = documents.read_documents(spark, str(tmp_path / "*.json"))
    assert [r["price"] for r in documents.daily_bars(docs).collect()] == [2.0]
    assert documents.shares(docs).first()["shares"] == 7
    assert documents.income_statements(docs).first()["filing_date"] == date(2020, 2, 10)
    assert documents.page_windows("1990-01-01", "2020-01-01")[0][1] == "2020-01-01"


def test_documents_are_read_once_for_validity_and_bars(spark):
    text = '{"symbol": "A", "eod": [{"symbol": "A", "date": "2020-01-02", "price": 2.0, "volume": 3.0}], "market_cap": [{"symbol": "A", "date": "2020-01-02", "marketCap": 5.0}]}'
    rows = spark.createDataFrame([(text,), (None,)], "body string")
    assert documents.parse_documents(rows, fields=("symbol", "eod")).collect() == documents.parse_documents(rows).select("symbol", "eod").collect()
    assert [tuple(r) for r in panel.validity(documents.parse_documents(rows), "eod").filter("symbol = 'A'").select("valid", "reason", F.size("eod")).collect()] == [(False, "unadjusted_prices", 1)]


def test_status_and_penny_filter(spark):
    b = spark.createDataFrame([("A", 0.05), ("B", 3.0)], "symbol string, adj_close double")
    assert [r["symbol"] for r in panel.without_penny_stocks(b, b).collect()] == ["B"]
    s = panel.status({"bars": b, "caps": b.filter("symbol = 'B'")}, spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string"))
    assert rows_of(s, "symbol") == [("A", "invalid", "caps"), ("B", "success", None), ("C", "invalid", "bars")]


def test_http_urls():
    r = http.PagedJsonReader({"base": "http://x/", "path": http.ENDPOINTS["splits"], "symbols": "A, B,C&D", "tasks": "2", "key": "k"})
    assert [p.value for p in r.partitions()] == [["A", "C&D"], ["B"]]
    assert r.url("C&D", "2020-01-01") == "http://x/splits?symbol=C%26D&limit=1000&from=2020-01-01&apikey=k"


def _reader(**more):
    return http.PagedJsonReader({"base": "http://x", "path": http.ENDPOINTS["market_cap"], "symbols": "A,B", "to": "2020-01-01", "years": "19", "rate": "6000000", "wait": "0"} | more)


def test_http_pages_and_errors(monkeypatch):
    r = _reader(**{"from": "1990-01-01", "follow": "false", "retries": "0"})
    monkeypatch.setattr(r, "fetch", lambda url: (200, "[]") if "symbol=A" in url else (429, None))
    got = [row for p in r.partitions() for row in r.read(p)]
    assert [(s, page, status) for s, page, *_, status, _, _ in got] == [("A", 0, 200), ("A", 1, 200), ("B", 0, 429), ("B", 1, 429)]
    assert got[0][3] == "2020-01-01" and got[1][2] == "1990-01-01" and got[2][5] is None


def test_http_asks_again_after_a_refusal(monkeypatch):
    r, slept, answers = _reader(symbols="A", wait="60", retries="2"), [], iter([(429, None), (503, None), (200, "[]"), (404, None)])
    monkeypatch.setattr(r, "fetch", lambda url: next(answers))
    turns = http.Turns(0, 1e9, 0, 1, lambda: 0.0, slept.append)
    assert r.ask("u", turns) == (200, "[]") and [s for s in slept if s >= 1] == [60, 60]
    assert r.ask("u", turns) == (404, None)
    answers = iter([(429, None)] * 3)
    assert r.ask("u", turns) == (429, None)


def test_http_rate_of_four_tasks_on_one_clock():
    """Tasks that sleep, pause and stop keep to one rate together; a pause earns no burst."""
    rng = np.random.default_rng(0)
    now, taken = [0.0] * 4, []
    tasks = [http.Turns(0.0, 120, k, 4, lambda k=k: now[k], lambda s, k=k: now.__setitem__(k, now[k] + s)) for k in range(4)]
    for k, t in enumerate(tasks):
        for i in range(100 + 40 * k):
            t.take()
            taken.append(now[k])
            now[k] += float(rng.exponential(0.3)) + (200.0 if i == 50 else 0.0)
    taken = np.sort(taken)
    in_a_minute = np.searchsorted(taken, taken + 60, "left") - np.arange(len(taken))
    assert in_a_minute.max() <= 120 + 4
    # A task that is never late has every fourth token.
    steady, at = http.Turns(0.0, 60, 1, 4, lambda: at[0], lambda s: at.__setitem__(0, at[0] + s)), [0.0]
    got = []
    for _ in range(3):
        steady.take()
        got.append(round(at[0], 6))
    assert got == [1.0, 5.0, 9.0]


@pytest.fixture
def stub():
    """An endpoint of market caps that serves a history of days up to 2020, and records what it is asked for."""
    import json
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from threading import Thread
    from urllib.parse import parse_qs, urlparse

    begins, asked = {"A": "2015-03-02", "B": "1990-05-01", "C": "1975-01-06", "D": "1950-02-01", "E": None}, []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlparse(self.path)
            q = {k: v[0] for k, v in parse_qs(url.query).items()}
            asked.append((url.path.strip("/"), q["symbol"], q.get("from"), q.get("to")))
            rows = []
            if "capitalization" in url.path and begins[q["symbol"]]:
                day, first = date.fromisoformat(q["to"]), max(date.fromisoformat(q["from"]), date.fromisoformat(begins[q["symbol"]]))
                rows = [{"symbol": q["symbol"], "date": (day - timedelta(days=k)).isoformat(), "marketCap": 1000.0 + k} for k in range(0, (day - first).days + 1)]
                rows = [r for r in rows if date.fromisoformat(r["date"]).weekday() < 5]
            elif "light" in url.path:
                rows = [{"symbol": q["symbol"], "date": d, "price": 10.0, "volume": 1.0} for d in ("2019-12-31", "2019-12-30", "2019-12-31")]
            body = json.dumps(rows).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}", asked
    server.shutdown()


def test_paged_assembly_asks_for_no_page_too_many(spark, stub):
    base, asked = stub
    http.register(spark)
    read = spark.read.format("paged_json").option("base", base).option("symbols", "A,B,C,D,E").option("to", "2020-01-01").option("years", "19").option("rate", "600000").option("tasks", "3")
    answers = read.option("endpoints", "market_cap,eod,income_statement:annual").load().persist()
    assert answers.count() == len(asked)
    pages = {s: sum(x[1] == s and "capitalization" in x[0] for x in asked) for s in "ABCDE"}
    assert pages == {"A": 1, "B": 2, "C": 3, "D": 4, "E": 1}
    docs = {r["symbol"]: r for r in documents.assembled(answers).collect()}
    for s, first in (("A", date(2015, 3, 2)), ("B", date(1990, 5, 1)), ("C", date(1975, 1, 6)), ("D", date(1950, 2, 1))):
        days = [date.fromisoformat(r["date"]) for r in docs[s]["market_cap"]]
        want = [d for k in range((date(2020, 1, 1) - first).days + 1) if (d := date(2020, 1, 1) - timedelta(days=k)).weekday() < 5]
        assert days == want
        assert docs[s]["outstanding_shares"] == {"2019-12-31": 100, "2019-12-30": 100} and len(docs[s]["eod"]) == 2
    assert docs["E"]["market_cap"] is None and docs["E"]["outstanding_shares"] is None and docs["E"]["financials_annual"]["income_statement"] == []
    report = {r["symbol"]: (r["status"], r["requests"]) for r in documents.fetch_report(answers, spark.createDataFrame([("A",), ("Z",)], "symbol string")).collect()}
    assert report == {"A": ("success", 3), "Z": ("failed", 0)}
    answers.unpersist()


def test_pages_and_refresh(spark):
    rows = [("A", "2001-01-05", 1.0, 0, "2001-01-01"), ("A", "2001-01-05", 9.0, 1, "1982-01-01"), ("A", "1990-01-01", 2.0, 1, "1982-01-01"), ("B", "2001-01-02", 3.0, 0, "2001-01-01")]
    pages = spark.createDataFrame(rows, "symbol string, date string, cap double, page int, from string")
    assert rows_of(documents.union_of_pages(pages.drop("from")).select("symbol", "date", "cap"), "symbol", "date") == [("A", "1990-01-01", 2.0), ("A", "2001-01-05", 1.0), ("B", "2001-01-02", 3.0)]
    assert rows_of(documents.more_pages(pages).select("symbol", "more"), "symbol") == [("A", False), ("B", True)]
    held = spark.createDataFrame([("A", "d1", 1.0), ("A", "d2", 2.0)], "symbol string, date string, v double")
    news = spark.createDataFrame([("A", "d2", 5.0), ("A", "d3", 6.0)], "symbol string, date string, v double")
    assert rows_of(documents.refreshed(held, news), "date") == [("A", "d1", 1.0), ("A", "d2", 5.0), ("A", "d3", 6.0)]


def test_undefined_idiovol_is_null(spark):
    """Constant prices (the market doesn't move), zero prices, and a window with a hole."""
    days = [date(2015, 1, 5) + timedelta(days=7 * k) for k in range(200)]
    rng = np.random.default_rng(1)
    walk = np.exp(np.cumsum(rng.normal(0, 0.03, 200))) * 10
    for prices in (np.full(200, 5.0), np.zeros(200)):
        b = _bars(spark, [("A", d, float(p), 1.0) for d, p in zip(days, prices, strict=True)])
        w = bars.weekly_returns(b)
        rows = features.rolling_risk(bars.monthly_summary(bars.daily_returns(b)), w, features.market_returns(w)).collect()
        assert all(r["idiovol"] is None and r["idiovol_current"] is None and r["beta"] is None for r in rows)
    hole = walk.copy()
    hole[120] = 0.0
    b = _bars(spark, [(s, d, float(p), 1.0) for s, x in (("A", walk), ("B", hole)) for d, p in zip(days, x, strict=True)])
    w = bars.weekly_returns(b)
    rows = features.rolling_risk(bars.monthly_summary(bars.daily_returns(b)), w, features.market_returns(w)).collect()
    assert {r["symbol"] for r in rows if r["idiovol_current"] is not None} == {"A"}


def test_growth_with_statements_never_filed(spark):
    st = spark.createDataFrame(
        [("A", "year", date(2018, 12, 31), None, 100.0), ("A", "year", date(2019, 12, 31), date(2020, 2, 1), 110.0), ("A", "year", date(2020, 12, 31), date(2021, 2, 1), 121.0)],
        "symbol string, freq string, date date, filing_date date, total_assets double",
    )
    assert rows_of(features.asset_growth(st).select("month", "agr"), "month") == [("2020-02", pytest.approx(10.0)), ("2021-02", pytest.approx(10.0))]


def test_macro_csv(spark, tmp_path):
    (tmp_path / "macro.csv").write_text('yyyymm,Index,csp,CRSP_SPvw,b/m\n196112,"1,000.50",1,0.1,0.2\n196201,"2,000.25",,0.3,0.4\n196202,3,2,0.5,NaN\n196203,"1,234,567.5",,0.7,0.8\nbad,1,1,1,1\n')
    m = macro.read_macro(spark, str(tmp_path / "macro.csv"))
    assert m.columns == ["month", "Index", "csp", "SPvw", "b/m"]
    # The month that the first day lies in is left out, as text compares.
    assert rows_of(m, "month") == [("1962-02", 3.0, 2.0, 0.5, None), ("1962-03", 1234567.5, 2.0, 0.7, 0.8)]
    assert macro.read_macro(spark, str(tmp_path / "macro.csv"), first="1961").count() == 4


def test_documents_to_panel(spark, tmp_path):
    """A run over files: one valid document, one without balance sheets."""
    import json

    (tmp_path / "raw").mkdir()
    statement = {"income_statement": [{"date": "2019-12-31", "fillingDate": "2020-02-01", "revenue": 1}], "balance_sheet": [{"date": "2019-12-31", "fillingDate": "2020-02-01", "totalAssets": 1}]}
    eod = [{"symbol": "A", "date": f"2020-{m:02d}-03", "price": float(m), "volume": 1} for m in (3, 2, 1)]
    for s, finance in (("A", statement), ("B", statement | {"balance_sheet": []})):
        body = {"symbol": s, "eod": eod, "eod_unadj": [{"date": "2020-01-03", "adjClose": 1}], "market_cap": [{"date": "2020-01-03", "marketCap": 1}], "financials_annual": finance, "financials_quarterly": statement}
        (tmp_path / "raw" / f"{s}.json").write_text(json.dumps(body, indent=4))
    made, told = config.run(spark, config.EngineConfig(str(tmp_path)))
    assert rows_of(told, "symbol") == [("A", "success", None, 3), ("B", "invalid", "annual_balance", 0)]
    back = documents.read_panel(spark, str(tmp_path / "frames"))
    assert rows_of(back.select("symbol", "month", "mom1m"), "month") == [("A", "2020-01", None), ("A", "2020-02", 100.0), ("A", "2020-03", 50.0)]
    strict, told = config.run(spark, config.EngineConfig(str(tmp_path), strict=True))
    assert strict.count() == 0 and rows_of(told, "symbol")[0][1] == "failed"
    docs = documents.read_documents(spark, str(tmp_path / "raw" / "*.json")).drop("_corrupt_record")
    documents.write_documents(docs, str(tmp_path / "out"), pretty=True)
    assert documents.daily_bars(documents.read_documents(spark, str(tmp_path / "out" / "*" / "*.txt"))).count() == 6
    assert documents.write_frames(made, str(tmp_path / "part"), ("2020-02", "2020-03")).first()["rows"] == 1
    extra = spark.createDataFrame([("A", "d2", 2), ("A", "d1", 1)], "symbol string, date string, v int")
    assert [x["v"] for x in documents.enrich(docs, extra, "splits").filter("symbol = 'A'").first()["splits"]] == [2, 1]


def _document(s: str, prices: list[float], sic: str) -> dict:
    """Bars every second day from 2017 on, market caps of 100 shares, statements by quarter and year."""
    days = [date(2017, 1, 2) + timedelta(days=2 * k) for k in range(len(prices))]
    eod = [{"symbol": s, "date": d.isoformat(), "price": p, "volume": 10.0 + k % 7} for k, (d, p) in enumerate(zip(days, prices, strict=True))][::-1]
    filed = [{"date": f"{y}-{m:02d}-28", "fillingDate": f"{y + m // 12}-{m % 12 + 1:02d}-20", "netIncome": 5.0 * y, "revenue": 9.0 * m, "totalAssets": 100.0 + y + m} for y in (2018, 2017) for m in (12, 9, 6, 3)]
    finance = {"income_statement": filed, "balance_sheet": filed}
    return {
        "symbol": s, "sicCode_2": sic, "exchange": "X", "type": "stock", "eod": eod, "eod_unadj": [{"date": r["date"], "adjClose": r["price"]} for r in eod],
        "market_cap": [{"symbol": s, "date": r["date"], "marketCap": 100 * r["price"]} for r in eod], "outstanding_shares": {r["date"]: 100 for r in eod},
        "financials_annual": {k: v[:1] + v[4:5] for k, v in finance.items()}, "financials_quarterly": finance,
    }


def test_runs_over_slices_of_documents_resume(spark, tmp_path, monkeypatch):
    """All characteristics of five symbols; a run that dies in its second slice goes on there."""
    import json

    rng = np.random.default_rng(8)
    (tmp_path / "raw").mkdir()
    for k, s in enumerate("ABCDE"):
        body = _document(s, np.exp(np.cumsum(rng.normal(0, 0.02, 320))).round(4).tolist(), f"{10 + k % 2}")
        (tmp_path / "raw" / f"{s}.json").write_text(json.dumps(body if s != "D" else body | {"market_cap": []}, indent=4))
    c = config.EngineConfig(str(tmp_path))
    real, calls = documents.write_frames, []

    def write(made, path, **how):
        calls.append(how)
        if len(calls) == 2:
            raise OSError("the disk is full")
        return real(made, path, **how)

    monkeypatch.setattr(documents, "write_frames", write)
    with pytest.raises(OSError):
        config.run_slices(spark, c, 2)
    told = config.run_slices(spark, c, 2)
    assert len(calls) == 4 and all(how == {"replace": False} for how in calls)
    assert [r[:2] for r in rows_of(told.select("symbol", "status"), "symbol")] == [("A", "success"), ("B", "success"), ("C", "success"), ("D", "invalid"), ("E", "success")]
    whole = documents.read_panel(spark, c.frames)
    wanted = ("mom1m", "mom12m", "mom12m_current", "mom36m", "chmom", "chmom_current", "maxret", "maxret_current", "turn", "std_turn", "mve", "mve_current", "dolvol", "dolvol_current", "ill", "retvol",
              "beta", "beta_current", "betasq", "betasq_current", "idiovol", "idiovol_current", "indmom", "ep_quarter", "sp_quarter", "agr_quarter", "ep_year", "sp_year", "agr_year")
    assert set(wanted) <= set(whole.columns)
    row = whole.filter("symbol = 'A' and month = '2018-07'").first()
    caps = {r["date"]: r["marketCap"] for r in json.loads((tmp_path / "raw" / "A.json").read_text())["market_cap"]}
    assert row["mve_current"] == pytest.approx(math.log(caps[max(d for d in caps if d < "2018-08")]))
    filed = whole.filter("symbol = 'A' and month = '2018-10'").first()
    near = [caps[d] for d in ("2018-09-28",) if d in caps] or [sum(caps[d] for d in (max(x for x in caps if x < "2018-09-28"), min(x for x in caps if x > "2018-09-28"))) / 2 if max(caps) > "2018-09-28" else caps[max(caps)]]
    assert filed["sp_quarter"] == pytest.approx(81.0 / near[0])
    same = {r["symbol"]: r["indmom"] for r in whole.filter("month = '2018-07'").collect()}
    current = {r["symbol"]: r["mom12m_current"] for r in whole.filter("month = '2018-07'").collect()}
    assert same["A"] == same["C"] == same["E"] == pytest.approx(np.mean([current[s] for s in "ACE"])) and same["B"] == pytest.approx(current["B"])


def test_windows_from_files_and_the_same_scaling_again(spark, tmp_path):
    rng = np.random.default_rng(9)
    months = [f"{y}-{m:02d}" for y in (2001, 2002, 2003) for m in range(1, 13)]
    rows = [(s, m, str(10 + k % 2), "X", float(rng.normal(5, 2)), None if rng.random() < 0.2 else float(rng.normal()), float(rng.normal())) for k, s in enumerate("ABCD") for m in (months if s != "D" else months[-3:])]
    frame = spark.createDataFrame(rows, "symbol string, month string, sic2 string, exchange string, mom1m double, turn double, indmom double")
    frame.coalesce(1).write.option("header", True).csv(str(tmp_path / "panel"))
    csp = {m: float(rng.normal()) for m in months}
    lines = ["yyyymm,Index,csp,tbl,twice"] + [f'{m.replace("-", "")},"1,{k:03d}.50",{csp[m]},{k % 5},{2 * (k % 5)}' for k, m in enumerate(months)]
    (tmp_path / "macro.csv").write_text("\n".join(lines))
    c = dataset.Dataset(str(tmp_path / "panel"), str(tmp_path / "macro.csv"), str(tmp_path / "scalers"), ("2003-01", "2003-07", "2004-01"), steps=4, macro_steps=3, correlation=0.99)
    made = dataset.build(spark, c).persist()
    assert made.columns == ["symbol", "split", "time", "x", "macro_x", "y", "exchange", "sic"]
    assert {(r["split"], r["symbol"]): r["n"] for r in made.groupBy("split", "symbol").agg(F.count("*").alias("n")).collect()} == {(s, k): n for k in "ABC" for s, n in (("train", 20), ("val", 2), ("test", 2))}
    assert {(r["symbol"], r["sic"], r["exchange"]) for r in made.collect()} == {("A", 0, "X"), ("B", 1, "X"), ("C", 0, "X")}
    # Columns by the panel's order: mom1m, turn, indmom; twice follows tbl.
    mom = {(r[0], r[1]): r[4] for r in rows}
    train = [v for (_, m), v in mom.items() if m < "2003-01"]
    scaled = {k: (v - np.mean(train)) / np.std(train) for k, v in mom.items()}
    for r in made.collect():
        at = months.index(r["time"])
        assert r["y"] == pytest.approx(scaled[r["symbol"], r["time"]]) and [v[0] for v in r["x"]] == [pytest.approx(scaled[r["symbol"], m]) for m in months[at - 4 : at]]
        assert len(r["macro_x"]) == 3 and len(r["macro_x"][0]) == 3
    # For use, the last rows and not those before a known one, by the stored scalers.
    used = {r["symbol"]: r for r in dataset.latest(spark, c).collect()}
    assert used.keys() == set("ABC") and used["B"]["time"] == "2003-12" and used["B"]["sic"] == 1
    assert [v[0] for v in used["A"]["x"]] == [pytest.approx(scaled["A", m]) for m in months[-4:]]
    tail = made.filter("symbol = 'A' and time = '2003-12'").first()
    assert used["A"]["x"][:3] == tail["x"][1:] and used["A"]["macro_x"][:2] == tail["macro_x"][1:]
    back = dataset.unscaled(spark, c, spark.createDataFrame([("A", float(scaled["A", "2003-12"]))], "symbol string, guess double"), "guess").first()
    assert back["guess"] == pytest.approx(mom["A", "2003-12"])
    few = dataset.build(spark, dataset.Dataset(**(vars(c) | {"sample": 2, "scalers": str(tmp_path / "few")})))
    assert few.select("symbol").distinct().count() <= 2
    made.unpersist()


def test_upserts_survive_a_crash(spark, tmp_path, monkeypatch):
    schema = "symbol string, date string, v double, at int"
    table = upsert.Upserts(spark, str(tmp_path / "caps"), order="at", buckets=4)
    with pytest.raises(ValueError):
        table.read()
    first = spark.createDataFrame([(s, f"d{k}", 1.0 * k, 0) for s in "ABCDEF" for k in range(3)] + [("A", "d0", 7.0, 1), (None, "d0", 3.0, 0)], schema)
    assert table.upsert(first) == 1
    want = {(s, f"d{k}"): 1.0 * k for s in "ABCDEF" for k in range(3)} | {("A", "d0"): 7.0, (None, "d0"): 3.0}
    got = lambda version=None: {(r["symbol"], r["date"]): r["v"] for r in table.read(version).collect()}
    assert got() == want and table.read().count() == len(want)
    news = spark.createDataFrame([("A", "d0", 9.0, 2), ("A", "d9", 5.0, 2), (None, "d0", 4.0, 2)], schema)
    with monkeypatch.context() as m:
        m.setattr(table, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.upsert(news)
    assert table.version() == 1 and got() == want
    for _ in range(2):  # again after the crash, and once more
        table.upsert(news, batch=5)
        assert table.version() == 2 and got() == want | {("A", "d0"): 9.0, ("A", "d9"): 5.0, (None, "d0"): 4.0}
    assert got(1) == want
    table.upsert(spark.createDataFrame([("Z", "d0", 1.0, 0)], schema), batch=6)
    now = got()
    with pytest.raises(RuntimeError):
        table._publish(3, {})
    table.vacuum()
    assert got() == now and table.version() == 3


def test_columns_of_the_final_panel(spark):
    df = spark.createDataFrame([("A", "2020-01", 1.0, 2.0, 3.0, 4.0, "x")], "symbol string, month string, mom12m double, mom12m_current double, sp_year double, turn double, exchange string")
    assert mlprep.final_columns(df).columns == ["symbol", "month", "mom12m", "turn", "exchange"] and mlprep.final_columns(df).first()["mom12m"] == 2.0
    groups = panel.column_groups(df.columns)
    assert groups["lagged"] == ["mom12m"] and groups["static"] == ["exchange"] and "mom12m" not in panel.drop_groups(df, groups, ("lagged", "nothing")).columns
    t = spark.createDataFrame([("true",), ("A",)], "symbol string").select(documents.true_symbol(F.col("symbol")))
    assert [r[0] for r in t.collect()] == ["TRUE", "A"]


def test_scaling_with_target_and_back(spark):
    df = spark.createDataFrame([(f"2020-{k:02d}", float(k), float(k * k)) for k in range(1, 7)], "month string, y double, a double")
    made, fitted, own = mlprep.scale_with_target(df, ["a", "y"], "y", F.col("month") < "2020-05")
    assert made.columns == ["month", "a", "y"]
    back = mlprep.scaled_by(mlprep.scaled_by(made, fitted, ["a"], inverse=True), own, ["y"], inverse=True)
    assert [(round(r["a"], 9), round(r["y"], 9)) for r in back.orderBy("month").collect()] == [(k * k, k) for k in range(1, 7)]


def test_windows_of_two_lengths(spark):
    df = spark.createDataFrame([("t", "A", f"2020-{k:02d}", float(k), 10.0 * k) for k in range(1, 8)], "split string, symbol string, month string, v double, m double")
    own, outer = mlprep.firm_and_macro_sequences(df, ["v"], ["m"], "v", 4, 2)
    assert (own.count(), outer.count()) == (3, 5)
    want = rows_of(own.join(outer, ["split", "symbol", "time"]).select("time", "x", "macro_x", "y"), "time")
    assert rows_of(mlprep.joint_sequences(df, ["v"], ["m"], "v", 4, 2).select("time", "x", "macro_x", "y"), "time") == want and len(want) == 3


def test_positions_of_a_table(spark, monkeypatch):
    from panelloom.functions import windows

    rng = np.random.default_rng(2)
    x = [None if k % 17 == 0 else float(v) for k, v in enumerate(rng.integers(0, 40, 300))]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "k int, v double")
    got = {r["k"]: (r["_i"], r["_n"]) for r in windows.positioned(df, ["v", "k"]).collect()}
    want = sorted(range(300), key=lambda k: (x[k] is not None, x[k] or 0, k))
    assert [got[k] for k in want] == [(i, 300) for i in range(300)]
    ranks = {r["value"]: r["rank"] for r in windows.average_ranks(df, "v").collect()}
    known = np.array([v for v in x if v is not None])
    assert ranks == {v: (known < v).sum() + ((known == v).sum() + 1) / 2 for v in set(known.tolist())}
    assert [r["k"] for r in mlprep.positions(df, ["k"], 3, -290).orderBy("k").collect()] == [3, 4, 5, 6, 7, 8, 9]
    assert windows.positioned(df.limit(0), ["v"]).count() == 0


def test_kendall_against_pairs(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 9, 80).astype(float), rng.integers(0, 9, 80).astype(float)
    s = lambda v: np.sign(v[:, None] - v[None])
    want = (s(a) * s(b)).sum() / np.sqrt((s(a) ** 2).sum() * (s(b) ** 2).sum())
    df = spark.createDataFrame([(float(x), float(y), 1.0) for x, y in zip(a, b, strict=True)], "a double, b double, c double")
    got = {(r["a"], r["b"]): r["r"] for r in audits.correlations(df, ["a", "b", "c"], "kendall").collect()}
    assert got["a", "b"] == pytest.approx(want) and got["a", "c"] is None


def test_kendall_by_slices(spark, monkeypatch):
    """Slices of 20 rows, grids that are sliced again, a hot value, ties and nulls: as over all pairs of rows."""
    monkeypatch.setattr(ranks, "SLICE_ROWS", 20)
    rng = np.random.default_rng(4)
    a = np.where(rng.random(400) < 0.3, 5.0, rng.normal(5, 3, 400).round(1))
    b = np.where(rng.random(400) < 0.3, a, rng.normal(5, 3, 400).round(1))
    rows = [(float(x), None if k % 11 == 0 else float(y), float(x * y)) for k, (x, y) in enumerate(zip(a, b, strict=True))]
    got = {(r["a"], r["b"]): r["r"] for r in audits.correlations(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"], "kendall").collect()}
    s = lambda v: np.sign(v[:, None] - v[None])
    for i, j, name in ((0, 1, ("a", "b")), (0, 2, ("a", "c")), (1, 2, ("b", "c"))):
        x, y = (np.array([float(r[k]) for r in rows if r[i] is not None and r[j] is not None]) for k in (i, j))
        assert got[name] == pytest.approx((s(x) * s(y)).sum() / np.sqrt((s(x) ** 2).sum() * (s(y) ** 2).sum()))


def test_discordant_pairs_by_weight():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 33, 100):
        x, y, w = rng.integers(0, 9, n), rng.integers(0, 9, n), rng.integers(1, 5, n)
        assert ranks.discordant(x, y, w) == sum(float(w[i] * w[j]) for i in range(n) for j in range(n) if x[i] < x[j] and y[i] > y[j])


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_quantiles_are_exact(spark, monkeypatch, accuracy):
    monkeypatch.setattr(ranks, "ACCURACY", accuracy)
    rng = np.random.default_rng(6)
    x = np.where(rng.random(3000) < 0.35, 7.0, rng.normal(0, 10, 3000))
    df = spark.createDataFrame([(float(v), k % 3 if k % 5 else None, None) for k, v in enumerate(x)], "v double, `i.j` int, n double")
    points = [0.0, 0.01, 0.25, 0.333, 0.5, 0.77, 0.999, 1.0]
    got = {(r["column"], r["point"]): r["value"] for r in ranks.quantiles(df, ["v", "i.j", "n"], points).collect()}
    held = [k % 3 for k in range(3000) if k % 5]
    assert got == {("v", p): pytest.approx(np.quantile(x, p), rel=1e-12, abs=1e-12) for p in points} | {("i.j", p): pytest.approx(np.quantile(held, p)) for p in points}
    assert ranks.quantiles(df.limit(0), ["v"], [0.5]).count() == 0


def test_histogram_and_lists(spark):
    df = spark.createDataFrame([(float(k), 2.0) for k in range(11)] + [(None, 2.0)], "v double, c double")
    got = rows_of(audits.histogram(df, ["v", "c"], 5), "column", "bin")
    assert got == [("c", 0, 1.5, 2.5, 12), *[("v", k, 2.0 * k, 2.0 * k + 2, 2 + (k == 4)) for k in range(5)]]
    lists = spark.createDataFrame([([1, 2], [2, 3])], "a array<int>, b array<int>").select(periods.compare_lists(F.col("a"), F.col("b")).alias("x")).first()["x"]
    assert (lists["left_only"], lists["right_only"], lists["both"]) == ([1], [3], [2])
    same = spark.createDataFrame([(1.0, 1.0), (None, None)], "a double, b double").agg(periods.arrays_equal("a", "b")).first()[0]
    assert same is True
    assert audits.overview(df).count() == 2


def test_frames_are_released(spark):
    """A query's persisted frames go with its result."""
    import gc

    from panelloom.plans import registry

    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    df = registry.queries()["beta"](spark, "/root/testdata/sf0.001")
    df.count()
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() > before
    del df
    gc.collect()
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before


def test_stream_first_arrival(spark, tmp_path):
    from panelloom.streaming import incremental

    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    schema = "symbol string, date date, price double, volume double"
    for rows in ([("A", date(2020, 1, 2), 3.0, 1.0), ("A", date(2020, 1, 2), 1.0, 1.0)], [("A", date(2020, 1, 2), 0.5, 1.0), ("A", date(2020, 1, 3), 2.0, 1.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        assert incremental.maintain_monthly(spark.readStream.schema(schema).parquet(src), store, str(tmp_path / "cp")).awaitTermination(120)
    assert rows_of(incremental.latest_monthly(spark, store).select("symbol", "close", "days", "max_ret"), "symbol") == [("A", 2.0, 2, pytest.approx(100.0))]


def test_stream_in_tasks_by_the_number_of_bars(spark, tmp_path, monkeypatch):
    from panelloom.streaming import incremental

    parts, deal = [], type(spark.range(0)).repartition
    monkeypatch.setattr(incremental, "TASK_ROWS", 2)
    monkeypatch.setattr(type(spark.range(0)), "repartition", lambda df, n, *by: parts.append(n) or deal(df, n, *by))
    src, store, schema = str(tmp_path / "in"), str(tmp_path / "store"), "symbol string, date date, price double, volume double"
    days = [date(2020, 1, 2) + timedelta(days=k) for k in range(5)]
    for rows in ([(s, d, 1.0, 1.0) for s in "ABC" for d in days[:4]] + [(None, days[0], 1.0, 1.0)], [("A", days[4], 2.0, 1.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        assert incremental.maintain_monthly(spark.readStream.schema(schema).parquet(src), store, str(tmp_path / "cp"), 1).awaitTermination(120)
    assert parts == [7, 7]
    assert rows_of(incremental.latest_monthly(spark, store).select("symbol", "close", "days"), "symbol") == [("A", 2.0, 5), ("B", 1.0, 4), ("C", 1.0, 4)]
    assert {r[0] for r in spark.read.parquet(f"{store}/monthly/batch=1").select("symbol").collect()} == {"A"}


def test_first_upsert_is_written_once(spark, tmp_path):
    table = upsert.Upserts(spark, str(tmp_path / "t"), ("symbol",), buckets=4)
    for k, v in enumerate((1.0, 2.0)):
        table.upsert(spark.createDataFrame([("A", v), ("B", v)], "symbol string, v double"), k)
        assert bool(list(tmp_path.glob(f"t/data/{k + 1:08d}-*/news"))) == (k == 1)
    table.vacuum()
    assert rows_of(table.read().select("symbol", "v"), "symbol") == [("A", 2.0), ("B", 2.0)]


def test_stream(spark, tmp_path):
    from panelloom.streaming import incremental

    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    schema = "symbol string, date date, price double, volume double"
    for k, rows in enumerate(([("A", date(2020, 1, 2), 1.0, 1.0), ("B", date(2020, 1, 2), 1.0, 1.0)], [("A", date(2020, 1, 3), 2.0, 1.0)])):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        q = incremental.maintain_monthly(spark.readStream.schema(schema).parquet(src), store, str(tmp_path / "cp"))
        assert q.awaitTermination(120)
        del k
    assert rows_of(incremental.latest_monthly(spark, store).select("symbol", "close", "days"), "symbol") == [("A", 2.0, 2), ("B", 1.0, 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_streamed_means_equal_those_of_all_bars(spark, tmp_path, seed):
    """Bars in any split into batches, with late ones and corrections; one batch dies between its tables and is run again."""
    from panelloom.streaming import aggregates

    rng = np.random.default_rng(seed)
    static = spark.createDataFrame([("A", "10"), ("B", "10"), ("C", "20")], "symbol string, sic2 string")
    final = {(s, date(2019, 1, 1) + timedelta(days=int(k))): float(p) for s in "ABCD" for k, p in zip(np.flatnonzero(rng.random(500) < 0.3), np.exp(rng.normal(2, 0.3, 500)), strict=False)}
    dealt = {k: int(b) for k, b in zip(final, rng.integers(0, 3, len(final)), strict=True)}
    schema = "symbol string, date date, price double, volume double"
    daily = spark.createDataFrame([(s, d, p, 1.0) for (s, d), p in final.items()], schema)
    weekly = bars.weekly_returns(daily)
    want = {r["week"]: r["market"] for r in features.market_returns(weekly).collect()}
    momentum = features.with_momentum(bars.monthly_summary(bars.daily_returns(daily)))
    means = {(r["sic2"], r["month"]): r["indmom"] for r in features.industry_momentum(momentum, static, "mom12m").collect()}
    src, store, cp = str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "cp")
    for b in range(3):
        rows = [(s, d, p if dealt[s, d] == b else p * 2, 1.0) for (s, d), p in final.items() if dealt[s, d] == b or (dealt[s, d] == b + 1 and d.day % 4 == 0)]  # some come wrong a batch early
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        if b == 1:
            with pytest.MonkeyPatch.context() as m:
                real = aggregates.Upserts.upsert
                m.setattr(aggregates.Upserts, "upsert", lambda self, news, batch=None: (_ for _ in ()).throw(OSError("lost")) if self.path.endswith("/market") else real(self, news, batch))
                with pytest.raises(Exception, match="lost"):
                    aggregates.maintain(stream, store, cp, static).awaitTermination()
        aggregates.maintain(stream, store, cp, static).awaitTermination()
    got = {r["week"]: r["market"] for r in aggregates.market(spark, store).collect()}
    assert got.keys() == want.keys() and all(got[k] == (None if v is None else pytest.approx(v, abs=1e-9)) for k, v in want.items())
    got = {(r["sic2"], r["month"]): r["indmom"] for r in aggregates.industries(spark, store).collect()}
    assert got.keys() == means.keys() and all(got[k] == (None if v is None else pytest.approx(v, abs=1e-9)) for k, v in means.items())


@pytest.mark.parametrize(("seed", "spare"), [(1, 3), (2, 0)])
def test_streamed_risk_equals_that_of_all_bars(spark, tmp_path, seed, spare, monkeypatch):
    """Short windows; batches of news, corrections within a symbol's row and beyond it; one batch dies between its tables and is run again."""
    from panelloom.streaming import risk

    rng = np.random.default_rng(seed)
    schema = "symbol string, date date, price double"
    final = {(s, date(2019, 1, 1) + timedelta(days=int(k))): float(p) for s in "ABCD" for k, p in zip(np.flatnonzero(rng.random(240) < 0.3), np.exp(rng.normal(2, 0.3, 240)), strict=False) if s != "D" or k > 90}
    of = lambda d: min(2, (d - date(2019, 1, 1)).days // 80)
    dealt = {k: 2 if rng.random() < 0.04 else of(k[1]) for k in final}  # some bars come very late
    batches = [[(s, d, p if dealt[s, d] == b or b == 2 else 2 * p) for (s, d), p in final.items() if dealt[s, d] == b or (d.day % 9 == 0 and b > dealt[s, d])] for b in range(3)]
    batches[2].append((None, date(2019, 2, 2), 1.0))
    src, store, cp = str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "cp")
    asked = []
    real = risk._history
    monkeypatch.setattr(risk, "_history", lambda *a: asked.append(a[-1]) or real(*a))
    for b, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        run = lambda: risk.maintain(stream, store, cp, long=8, short=4, spare=spare).awaitTermination()  # noqa: B023, E731
        if b == 1:
            with monkeypatch.context() as m:
                m.setattr(risk.aggregates, "add", lambda *_: (_ for _ in ()).throw(OSError("lost")))
                with pytest.raises(Exception, match="lost"):
                    run()
        run()
        held = {(s, d): p for some in batches[: b + 1] for s, d, p in some if s}
        daily = spark.createDataFrame([(s, d, p, 1.0) for (s, d), p in held.items()], "symbol string, date date, price double, volume double")
        weekly = bars.weekly_returns(daily)
        want = {(r["symbol"], r["month"]): r for r in features.rolling_risk(bars.monthly_summary(bars.daily_returns(daily)), weekly, features.market_returns(weekly), 8, 4).collect()}
        got = {(r["symbol"], r["month"]): r for r in risk.risk(spark, store).collect()}
        assert got.keys() == want.keys()
        for k, w in want.items():
            assert got[k].asDict() == {c: v if v is None or isinstance(v, str) else pytest.approx(v, abs=1e-5) for c, v in w.asDict().items()}, (b, k)
    assert any(r["idiovol_current"] is not None for r in got.values()) and asked


def test_streamed_risk_reads_rows_not_histories(spark, tmp_path, monkeypatch):
    """News at the end are served from symbols' rows alone."""
    from panelloom.streaming import risk

    schema, src, store = "symbol string, date date, price double", str(tmp_path / "in"), str(tmp_path / "store")
    rng = np.random.default_rng(5)
    rows = [(s, date(2018, 1, 1) + timedelta(days=7 * k), float(p)) for s in "ABC" for k, p in enumerate(np.exp(rng.normal(2, 0.2, 60)))]
    last = max(r[1] for r in rows)
    for b in range(2):
        spark.createDataFrame([r for r in rows if (r[1] == last) == (b == 1)], schema).coalesce(1).write.mode("append").parquet(src)
        if b == 1:
            monkeypatch.setattr(risk, "_history", lambda *_: (_ for _ in ()).throw(AssertionError("read a history")))
        risk.maintain(spark.readStream.schema(schema).parquet(src), store, str(tmp_path / "cp"), long=8, short=4, spare=2).awaitTermination()
    assert spark.read.parquet(f"{store}/rolled/batch=1").count() == 3
    weekly = bars.weekly_returns(spark.createDataFrame([(*r, 1.0) for r in rows], schema + ", volume double"))
    want = {r["symbol"]: r["idio"] for r in features.rolled_weeks(weekly, features.market_returns(weekly), 8, 4).filter("week = '2019-08'").collect()}
    assert {r["symbol"]: r["idio"] for r in spark.read.parquet(f"{store}/rolled/batch=1").collect()} == {k: pytest.approx(v) for k, v in want.items()} and len(want) == 3


def test_streamed_risk_of_a_long_batch_reads_no_histories(spark, tmp_path, monkeypatch):
    """A batch that brings more weeks than a symbol's row holds is served from the row before it and the batch."""
    from panelloom.streaming import risk

    schema, src, store = "symbol string, date date, price double", str(tmp_path / "in"), str(tmp_path / "store")
    rng = np.random.default_rng(6)
    rows = [(s, date(2018, 1, 1) + timedelta(days=7 * k), float(p)) for s in "AB" for k, p in enumerate(np.exp(rng.normal(2, 0.2, 50)))]
    monkeypatch.setattr(risk, "_history", lambda *_: (_ for _ in ()).throw(AssertionError("read a history")))
    for late in (False, True):
        spark.createDataFrame([r for r in rows if (r[1] > date(2018, 5, 1)) == late], schema).coalesce(1).write.mode("append").parquet(src)
        risk.maintain(spark.readStream.schema(schema).parquet(src), store, str(tmp_path / "cp"), long=8, short=4, spare=2).awaitTermination()
    daily = spark.createDataFrame([(*r, 1.0) for r in rows], schema + ", volume double")
    weekly = bars.weekly_returns(daily)
    want = features.rolling_risk(bars.monthly_summary(bars.daily_returns(daily)), weekly, features.market_returns(weekly), 8, 4)
    plain = lambda df: {(r["symbol"], r["month"]): {c: v if v is None or isinstance(v, str) else pytest.approx(v, abs=1e-9) for c, v in r.asDict().items()} for r in df.collect()}
    got = {(r["symbol"], r["month"]): r.asDict() for r in risk.risk(spark, store).collect()}
    assert got == plain(want) and any(r["idiovol"] is not None for r in got.values())
