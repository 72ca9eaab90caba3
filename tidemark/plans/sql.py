"""DuckDB SQL of the shared parts: each function gives CTEs to put after one another."""

from __future__ import annotations

from ..config import COST, MED_MIN, PRESETS, SIG_N, SMA_N
from ..operators.windows import PERIODS
from ..sources.bars import SQL as BARS

SIGNALS = f"""
s0 AS (SELECT *, ln(c) - lag(ln(c)) OVER (PARTITION BY symbol ORDER BY dt) AS r FROM bars),
s1 AS (SELECT *, CASE WHEN count(r) OVER f >= {SIG_N} THEN stddev_samp(r) OVER f * sqrt(252.0::double) END AS sigma,
       CASE WHEN count(c) OVER g >= {SMA_N} THEN avg(c) OVER g END AS sma FROM s0
       WINDOW f AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN {SIG_N - 1} PRECEDING AND CURRENT ROW),
              g AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN {SMA_N - 1} PRECEDING AND CURRENT ROW)),
s2 AS (SELECT *, CASE WHEN count(sigma) OVER e >= {MED_MIN} THEN median(sigma) OVER e END AS sigma_tgt FROM s1
       WINDOW e AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sig AS (SELECT *, CASE WHEN sigma IS NOT NULL AND sigma_tgt IS NOT NULL AND sigma > 0 THEN least(1.0::double, sigma_tgt / sigma) ELSE 1.0::double END AS wv,
        coalesce(c > sma, true) AS up FROM s2)"""


def weighted(preset: str) -> str:
    vol, floor, below = PRESETS[preset]
    w_vol = "1.0::double" if not vol else "wv" if floor is None else f"greatest({floor}::double, wv)"
    return f"wt AS (SELECT *, {w_vol} AS w_vol, {w_vol} * CASE WHEN up THEN 1.0::double ELSE {below}::double END AS w FROM sig)"


PERIOD_ROWS = ", ".join(f"({i}, '{a}/{b}', DATE '{a}', DATE '{b}')" for i, (a, b) in enumerate(PERIODS))
PATHS = f"""
periods(ord, period, start, stop) AS (VALUES {PERIOD_ROWS}),
b0 AS (SELECT symbol, dt, o, c, lag(w) OVER (PARTITION BY symbol ORDER BY dt) AS before FROM wt),
b1 AS (SELECT ord, period, symbol, CAST(row_number() OVER (PARTITION BY period, symbol ORDER BY dt) - 1 AS INT) AS t, CAST(count(*) OVER (PARTITION BY period, symbol) - 1 AS INT) AS n, dt, o, c, before
       FROM b0 JOIN periods ON dt BETWEEN start AND stop),
paths AS MATERIALIZED (SELECT ord, period, symbol, t, n, dt, o, c, CASE WHEN t = 0 THEN 1.0::double ELSE before END AS target FROM b1 WHERE n >= 1)"""


def paths(preset: str) -> str:
    return f"{BARS.strip()},{SIGNALS},{weighted(preset)},{PATHS}"


GO = {"never": "false", "threshold": "abs(target - drifted) >= 0.10::double - 1e-9::double", "change": "target <> previous", "daily": "true", "once": "t = 1"}


def ledger(rule: str, cost: float = COST) -> str:
    """nav: period, symbol, t, v, w, paid, trades by recursion over t; needs WITH RECURSIVE."""
    k = f"{cost}::double"
    return f"""
led(period, symbol, t, sh, m, previous, paid, trades, v, w) AS (
  SELECT period, symbol, t, 1.0::double / c, 0.0::double, 1.0::double, 0.0::double, 0, 1.0::double, 1.0::double FROM paths WHERE t = 0
  UNION ALL
  SELECT period, symbol, t, sh2, m2, target, paid + CASE WHEN go THEN {k} * x ELSE 0 END, trades + CASE WHEN go AND x > 0 THEN 1 ELSE 0 END, sh2 * c + m2, sh2 * c / (sh2 * c + m2)
  FROM (SELECT *, CASE WHEN NOT go OR x = 0 THEN sh WHEN sell THEN sh - x / o ELSE sh + x / o END AS sh2,
               CASE WHEN NOT go OR x = 0 THEN m WHEN sell THEN m + (x - {k} * x) WHEN want >= cap THEN 0.0::double ELSE m - (1 + {k}) * x END AS m2
        FROM (SELECT *, CASE WHEN sell THEN held - target * total WHEN want <= 0 THEN 0.0::double WHEN want >= cap THEN cap ELSE want END AS x
              FROM (SELECT *, held > target * total AS sell, target * total - held AS want, m / (1 + {k}) AS cap, {GO[rule]} AS go
                    FROM (SELECT l.*  EXCLUDE (t, v, w), p.t, p.o, p.c, p.target, l.sh * p.o AS held, l.sh * p.o + l.m AS total, l.sh * p.o / (l.sh * p.o + l.m) AS drifted
                          FROM led l JOIN paths p ON p.period = l.period AND p.symbol = l.symbol AND p.t = l.t + 1))))),
nav AS (SELECT period, symbol, t, v, w, paid, trades FROM led)"""


def metrics(nav: str = "nav", name: str = "metrics", keys: str = "period, symbol") -> str:
    return f"""
{name}_d AS (SELECT *, 1 - v / max(v) OVER (PARTITION BY {keys} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fall,
             v / lag(v) OVER (PARTITION BY {keys} ORDER BY t) - 1 AS simple, ln(v) - lag(ln(v)) OVER (PARTITION BY {keys} ORDER BY t) AS lg FROM {nav}),
{name}_a AS (SELECT {keys}, arg_max(v, t) AS last, max(t) AS n, max(fall) AS mdd, stddev_samp(lg) AS sd_log, avg(simple) AS mean, stddev_samp(simple) AS sd,
             coalesce(avg(w) FILTER (t > 0), 1.0) AS avg_w, arg_max(paid, t) AS cost, arg_max(trades, t) AS trades FROM {name}_d GROUP BY {keys}),
{name} AS (SELECT {keys}, last - 1 AS ret, mdd, pow(last, 252.0::double / n) - 1 AS cagr, CASE WHEN mdd > 0 THEN (pow(last, 252.0::double / n) - 1) / mdd END AS calmar,
           sd_log * sqrt(252.0::double) AS vol, avg_w, CASE WHEN sd > 0 THEN mean / sd * sqrt(252.0::double) END AS sharpe, cost, trades FROM {name}_a)"""


SEGMENTS = """
isl AS (SELECT period, symbol, n, t, t - row_number() OVER (PARTITION BY period, symbol ORDER BY t) AS island FROM paths WHERE t >= 1 AND target < 1),
segs AS (SELECT period, symbol, CAST(row_number() OVER (PARTITION BY period, symbol ORDER BY min(t)) - 1 AS INT) AS seg, min(t) AS s, max(t) + 1 AS e, n FROM isl GROUP BY period, symbol, island, n)"""


def segment_nav(path: str, segs: str, name: str, keys: str, low: float = 0.5, cost: float = COST) -> str:
    """The closed form; path: keys, t, o, c."""
    k, w = f"{cost}::double", f"{low}::double"
    using = f"USING ({keys}, t)"
    so_far = f"(PARTITION BY {keys} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""
{name}_m AS (SELECT {keys}, s AS t, true AS down FROM {segs} UNION ALL SELECT {keys}, e, false FROM {segs}),
{name}_p AS (SELECT {keys}, t, o, c, down, last_value(down IGNORE NULLS) OVER {so_far} AS last_down, last_value(CASE WHEN down THEN o END IGNORE NULLS) OVER {so_far} AS o_s,
             first_value(c) OVER (PARTITION BY {keys} ORDER BY t) AS c0 FROM {path} LEFT JOIN {name}_m {using}),
{name}_k AS (SELECT *, exp(sum(CASE WHEN down = false THEN ln({w} + (1 - {w}) * (1 - {k}) / (1 + {k}) * o_s / o) ELSE 0.0::double END) OVER {so_far}) / c0 AS k FROM {name}_p),
{name}_v AS (SELECT *, CASE WHEN coalesce(last_down, false) THEN {w} * k * c + (1 - {k}) * (1 - {w}) * k * o_s ELSE k * c END AS v,
             CASE WHEN down THEN {k} * (1 - {w}) * k * o_s WHEN down = false THEN {k} * (1 - {k}) * (1 - {w}) * lag(k) OVER (PARTITION BY {keys} ORDER BY t) * o_s / (1 + {k}) ELSE 0.0::double END AS fee FROM {name}_k),
{name} AS (SELECT {keys}, t, v, CASE WHEN coalesce(last_down, false) THEN {w} * k * c / v ELSE 1.0::double END AS w, sum(fee) OVER {so_far} AS paid, CAST(count(down) OVER {so_far} AS INT) AS trades FROM {name}_v)"""
