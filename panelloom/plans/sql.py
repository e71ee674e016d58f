"""DuckDB SQL of the queries, from named common table expressions."""

from __future__ import annotations

import re

from ..operators.mlprep import FEATURES

SPLITS = ("1999-06", "2000-07", "2002-01")


#: Added before rounding to so many digits, so that ties fall alike in both engines.
NUDGE = {n: f"0.{'0' * (n + 2)}37" for n in (2, 4, 6, 8)}


def r(expression: str, digits: int = 6, name: str | None = None) -> str:
    return f"round({expression} + {NUDGE[digits]}, {digits}) + 0.0 AS {name or expression.split('.')[-1]}"


MONTH_ORDER = "PARTITION BY symbol ORDER BY month"


def lag(c: str, n: int) -> str:
    return c if n == 0 else f"lag({c}, {n}) OVER ({MONTH_ORDER})"


def change(later: str, earlier: str) -> str:
    return f"(({later}) - ({earlier})) / nullif({earlier}, 0) * 100"


def mom(a: int, b: int) -> str:
    return change(lag("close", a), lag("close", b))


def ln(x: str) -> str:
    return f"CASE WHEN ({x}) > 0 THEN ln({x}) END"


def dolvol(x: str) -> str:
    return f"CASE WHEN ({x}) = 0 THEN 0.0 WHEN ({x}) > 0 THEN ln({x}) END"


MONTH_ID = "(CAST(substr({0}, 1, 4) AS INTEGER) * 12 + CAST(substr({0}, 6, 2) AS INTEGER))"
GAP = f"({MONTH_ID.format('{1}')} - {MONTH_ID.format('{0}')} - 1)"
FUNDAMENTALS = ("ep_quarter", "sp_quarter", "agr_quarter", "ep_year", "sp_year", "agr_year")
MACRO = ("m_mean", "m_sum", "m_count", "m_open", "m_done")
ALPHA = 1 - 2 ** (-1 / 5)


def _ewm(source: str, columns: tuple[str, ...], lead: bool = True) -> str:
    """Recursive fill of columns over the rows of source in month order."""
    x = {c: f"CASE WHEN {c} IS NULL AND count({c}) OVER ({MONTH_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 0 THEN 0.0 ELSE {c} END" if lead else c for c in columns}
    rest = f"* EXCLUDE ({', '.join(columns)})"
    first = ", ".join(f"{c}, {c} AS w_{c}, 1.0::DOUBLE AS d_{c}" for c in columns)
    step = ", ".join(
        f"coalesce(n.{c}, e.w_{c}) AS {c}, "
        f"CASE WHEN n.{c} IS NULL THEN e.w_{c} WHEN e.w_{c} IS NULL THEN n.{c} ELSE (e.d_{c} * {1 - ALPHA!r} * e.w_{c} + {ALPHA!r} * n.{c}) / (e.d_{c} * {1 - ALPHA!r} + {ALPHA!r}) END AS w_{c}, "
        f"CASE WHEN n.{c} IS NULL AND e.w_{c} IS NOT NULL THEN e.d_{c} * {1 - ALPHA!r} ELSE 1.0 END AS d_{c}"
        for c in columns
    )
    return f"""
    WITH RECURSIVE n AS MATERIALIZED (SELECT {rest}, {", ".join(f"{v} AS {k}" for k, v in x.items())}, row_number() OVER ({MONTH_ORDER}) AS rn FROM {source}),
    e AS (
      SELECT symbol, month, rn, {first} FROM n WHERE rn = 1 UNION ALL
      SELECT n.symbol, n.month, n.rn, {step} FROM e JOIN n ON n.symbol = e.symbol AND n.rn = e.rn + 1
    )
    SELECT n.* EXCLUDE (rn, {", ".join(columns)}), {", ".join(f"e.{c}" for c in columns)} FROM n JOIN e ON n.symbol = e.symbol AND n.rn = e.rn"""


def _scaled(source: str, columns: tuple[str, ...], fit: str, rest: str) -> str:
    one = ", ".join(f"(x.{c} - s.m_{c}) / CASE WHEN s.s_{c} = 0 OR s.s_{c} IS NULL THEN 1.0 ELSE s.s_{c} END AS {c}" for c in columns)
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in columns)
    return f"SELECT {rest}, {one} FROM {source} x, (SELECT {stats} FROM {source} WHERE {fit}) s"


FRAME = "(PARTITION BY symbol ORDER BY week ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"

CTES = {
    "bars": "SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) / sum(l_quantity) AS price, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2",
    "fullbars": "SELECT *, price * shares AS market_cap FROM (SELECT *, sum(volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS shares FROM bars)",
    "daily": f"SELECT *, strftime(date, '%Y-%m') AS month, strftime(date, '%G-%V') AS week, {change('price', 'lag(price) OVER (PARTITION BY symbol ORDER BY date)')} AS ret FROM fullbars",
    "monthly": """SELECT symbol, month, arg_max(price, date) AS close, sum(price * volume) AS dollar_volume, sum(volume) AS volume, count(*) AS days, count(*) FILTER (WHERE volume = 0) AS zero_days,
      max(ret) AS max_ret, max(week) AS latest_week, stddev_pop(ret) AS ret_std, avg(abs(ret) / nullif(price * volume, 0)) AS illiquidity,
      arg_max(shares, date) AS shares, stddev_samp(CASE WHEN shares <> 0 THEN volume / nullif(shares, 0) END) AS turnover_std, arg_max(market_cap, date) AS market_cap FROM daily GROUP BY symbol, month""",
    "weekclose": "SELECT symbol, week, arg_max(price, date) AS close FROM daily GROUP BY symbol, week",
    "weekly": f"SELECT *, {change('close', 'lag(close) OVER (PARTITION BY symbol ORDER BY week)')} AS ret FROM weekclose",
    "market": "SELECT week, avg(ret) AS market FROM weekly GROUP BY week",
    "momentum": f"""SELECT *, {mom(0, 1)} AS mom1m, {mom(1, 12)} AS mom12m, {mom(0, 12)} AS mom12m_current, {mom(12, 36)} AS mom36m, {mom(1, 6)} - {mom(7, 12)} AS chmom,
      {mom(0, 6)} - {mom(6, 12)} AS chmom_current, {lag("max_ret", 1)} AS maxret, max_ret AS maxret_current FROM monthly""",
    "liquidity": f"""SELECT *, CASE WHEN count(*) OVER ({MONTH_ORDER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 THEN avg(volume) OVER ({MONTH_ORDER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END / nullif(shares, 0) AS turn,
      turnover_std AS std_turn, {ln(lag("market_cap", 1))} AS mve, {ln("market_cap")} AS mve_current, {dolvol(lag("dollar_volume", 2))} AS dolvol, {dolvol("dollar_volume")} AS dolvol_current, illiquidity AS ill, ret_std AS retvol,
      CASE WHEN row_number() OVER ({MONTH_ORDER}) = 1 THEN NULL WHEN volume / nullif(shares, 0) = 0 THEN CAST(zero_days AS DOUBLE) ELSE (zero_days + 1 / nullif(volume / nullif(shares, 0), 0)) * (21.0 / days) END AS zerotrade FROM momentum""",
    "static": "SELECT CAST(s_suppkey AS VARCHAR) AS symbol, lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS sic2, r_name AS exchange FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "industry": "SELECT sic2, month, avg(mom12m_current) AS indmom, avg(mom12m) AS indmom_lagged FROM momentum JOIN static USING (symbol) GROUP BY sic2, month",
    "wbase": "SELECT symbol, week, ret, market, row_number() OVER (PARTITION BY symbol ORDER BY week DESC) - 1 AS wi, count(*) OVER (PARTITION BY symbol) AS nw FROM weekly JOIN market USING (week)",
    "rolled": f"""SELECT symbol, wi, nw, avg(ret) OVER {FRAME.format(155)} AS mean_ret,
      CASE WHEN count(CASE WHEN ret IS NOT NULL AND market IS NOT NULL THEN 1 END) OVER {FRAME.format(51)} >= 52 THEN covar_samp(ret, CASE WHEN ret IS NOT NULL THEN market END) OVER {FRAME.format(51)} / nullif(var_pop(CASE WHEN ret IS NOT NULL THEN market END) OVER {FRAME.format(51)}, 0) END AS beta,
      CASE WHEN count(CASE WHEN ret IS NOT NULL AND market IS NOT NULL THEN 1 END) OVER {FRAME.format(155)} = 156 AND var_pop(market) OVER {FRAME.format(155)} > 0
        THEN sqrt(greatest(var_pop(ret) OVER {FRAME.format(155)} - pow(covar_pop(ret, market) OVER {FRAME.format(155)}, 2) / var_pop(market) OVER {FRAME.format(155)}, 0)) END AS idio FROM wbase""",
    "mplace": "SELECT symbol, month, latest_week, row_number() OVER (PARTITION BY symbol ORDER BY month DESC) - 1 AS mi FROM monthly",
    "wstart": "SELECT m.symbol, max(CASE WHEN mi = 1 THEN wi END) AS lagged, max(CASE WHEN mi = 0 THEN wi END) AS cur FROM mplace m JOIN wbase b ON m.symbol = b.symbol AND m.latest_week = b.week WHERE mi < 2 GROUP BY m.symbol",
    "risk": """SELECT m.symbol, m.month, CASE WHEN a.wi + 156 < a.nw THEN a.mean_ret END AS rolling_return, CASE WHEN c.wi + 156 < c.nw THEN c.mean_ret END AS rolling_return_current,
      CASE WHEN a.wi + 52 < a.nw THEN a.beta END AS beta, CASE WHEN c.wi + 52 < c.nw THEN c.beta END AS beta_current,
      CASE WHEN a.wi + 156 < a.nw THEN a.idio END AS idiovol, CASE WHEN c.wi + 156 < c.nw THEN c.idio END AS idiovol_current,
      CASE WHEN a.wi + 52 < a.nw THEN a.beta * a.beta END AS betasq, CASE WHEN c.wi + 52 < c.nw THEN c.beta * c.beta END AS betasq_current
      FROM mplace m JOIN wstart s ON m.symbol = s.symbol LEFT JOIN rolled a ON a.symbol = m.symbol AND a.wi = s.lagged + 4 * m.mi LEFT JOIN rolled c ON c.symbol = m.symbol AND c.wi = s.cur + 4 * m.mi""",
    "periods": """SELECT CAST(l_suppkey AS VARCHAR) AS symbol, 'quarter' AS freq, CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS date, l_extendedprice AS gross, l_extendedprice * (1 - l_discount) AS net FROM lineitem UNION ALL
      SELECT CAST(l_suppkey AS VARCHAR), 'year', CAST(date_trunc('year', l_shipdate) + INTERVAL 12 MONTH - INTERVAL 1 DAY AS DATE), l_extendedprice, l_extendedprice * (1 - l_discount) FROM lineitem""",
    "statements": """SELECT symbol, freq, date, date + 40 AS filing_date, strftime(date + 40, '%Y-%m') AS month, revenue, revenue - 0.9 * gross AS net_income,
      sum(revenue) OVER (PARTITION BY symbol, freq ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total_assets FROM (SELECT symbol, freq, date, sum(net) AS revenue, sum(gross) AS gross FROM periods GROUP BY ALL)""",
    "capped": """SELECT s.*, nullif(CASE WHEN lo.date = s.date THEN lo.market_cap WHEN lo.date IS NULL THEN NULL WHEN hi.date IS NULL THEN lo.market_cap ELSE (lo.market_cap + hi.market_cap) / 2 END, 0) AS cap
      FROM statements s ASOF LEFT JOIN fullbars lo ON s.symbol = lo.symbol AND s.date >= lo.date ASOF LEFT JOIN fullbars hi ON s.symbol = hi.symbol AND s.date <= hi.date""",
    "epsp": "SELECT symbol, freq, month, net_income / cap AS ep, revenue / cap AS sp FROM capped WHERE month IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, freq, month ORDER BY date DESC) = 1",
    "growth": f"""SELECT symbol, freq, month, CASE WHEN month IS DISTINCT FROM oldest THEN g END AS agr FROM (SELECT *, {change("total_assets", "lag(total_assets) OVER (PARTITION BY symbol, freq ORDER BY date)")} AS g,
      first_value(month) OVER (PARTITION BY symbol, freq ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS oldest FROM statements) WHERE month IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, freq, month ORDER BY date DESC) = 1""",
    "ratios": "SELECT symbol, month, " + ", ".join(f"max(CASE WHEN freq = '{q}' THEN {m} END) AS {m}_{q}" for q in ("quarter", "year") for m in ("ep", "sp", "agr")) + " FROM epsp JOIN growth USING (symbol, freq, month) GROUP BY symbol, month",
    "wide": "SELECT * FROM liquidity LEFT JOIN risk USING (symbol, month)",
    "panel": "SELECT p.*, static.sic2, static.exchange, industry.indmom, industry.indmom_lagged FROM (SELECT * FROM wide FULL JOIN ratios USING (symbol, month)) p LEFT JOIN static USING (symbol) LEFT JOIN industry ON industry.sic2 = static.sic2 AND industry.month = p.month",
    "ffilled": "SELECT * REPLACE (" + ", ".join(f"last_value({c} IGNORE NULLS) OVER ({MONTH_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}" for c in FUNDAMENTALS) + ") FROM panel",
    "macro": "SELECT strftime(o_orderdate, '%Y-%m') AS month, avg(o_totalprice) AS m_mean, sum(o_totalprice) AS m_sum, CAST(count(*) AS DOUBLE) AS m_count, avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END) AS m_open, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS m_done FROM orders GROUP BY 1",
    "formatted": "SELECT f.*, " + ", ".join(f"macro.{c}" for c in MACRO) + " FROM ffilled f LEFT JOIN macro ON f.month = macro.month WHERE mom1m IS NOT NULL",
    "filled": _ewm("formatted", FEATURES),
    "sicmap": "SELECT sic2, dense_rank() OVER (ORDER BY CAST(sic2 AS INTEGER)) - 1 AS code FROM (SELECT DISTINCT sic2 FROM static)",
    "parted": f"SELECT *, CASE WHEN month < '{SPLITS[0]}' THEN 'train' WHEN month < '{SPLITS[1]}' THEN 'val' WHEN month < '{SPLITS[2]}' THEN 'test' END AS split FROM filled",
    "scaledpart": _scaled("(SELECT * FROM parted WHERE split IS NOT NULL)", FEATURES, "split = 'train'", "symbol, month, split, sic2, " + ", ".join(MACRO)),
    "macroscaled": _scaled("macro", MACRO, f"month < '{SPLITS[0]}'", "month"),
    "sparse": "SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS symbol, strftime(l_shipdate, '%Y-%m') AS month FROM lineitem",
    "sparsebars": "SELECT CAST(l_partkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) / sum(l_quantity) AS price, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2",
    "sparsemonths": "SELECT symbol, strftime(date, '%Y-%m') AS month, arg_max(price, date) AS close FROM sparsebars GROUP BY 1, 2",
}


def query(final: str) -> str:
    """final with the expressions that it names, directly or not."""
    needed: list[str] = []

    def need(text: str, own: str = "") -> None:
        for name in CTES:
            if name != own and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                if name not in needed:
                    need(CTES[name], name)
                    needed.append(name) if name not in needed else None

    need(final)
    return ("WITH " + ", ".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in needed) + " " if needed else "") + final
