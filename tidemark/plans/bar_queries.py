"""Queries over synthetic bars: signals, windows, ledgers, controls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import rule
from ..operators import controls, ledger, signals, windows
from ..sources import bars as src
from . import sql

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query_into(queries: dict, oracles: dict):
    def query(name: str, oracle: str | None):
        def add(f):
            queries[name] = f
            if oracle:
                oracles[name] = oracle
            return f

        return add

    return query


query = query_into(QUERIES, ORACLE_SQL)


def rounded(df: DataFrame, *keys: str, digits: int = 6, **own: int) -> DataFrame:
    """keys as they are; doubles rounded, so that engines that sum in other orders agree."""
    return df.select(*[F.round(c, own.get(c, digits)).alias(c) if t == "double" and c not in keys else F.col(c) for c, t in df.dtypes])


def r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) AS {expr}"


def bars(spark, sf_dir):
    return src.synthetic(spark, sf_dir)


def paths_of(spark, sf_dir, preset: str) -> DataFrame:
    return windows.paths(signals.weights(bars(spark, sf_dir), rule(preset)), windows.periods_table(spark))


B = f"WITH {sql.BARS.strip()}"
S = f"{B},{sql.SIGNALS}"


@query("bars_scan", f"{B} SELECT symbol, dt, {r('o')}, {r('h')}, {r('l')}, {r('c')}, v FROM bars")
def bars_scan(spark, sf_dir):
    return rounded(bars(spark, sf_dir), "v")


@query("bars_from_events", """SELECT event_type AS symbol, CAST(ts AS date) AS dt, arg_min(value, (ts, event_id)) AS o, max(value) AS h, min(value) AS l, arg_max(value, (ts, event_id)) AS c, CAST(count(*) AS DOUBLE) AS v
FROM events GROUP BY 1, 2""")
def bars_from_events(spark, sf_dir):
    return src.from_events(src.load(spark, sf_dir, "events"))


@query("latest_trend_weight", f"""{S},{sql.weighted('f')} SELECT symbol, max(dt) AS date, round(arg_max(c, dt), 6) AS close, round(max(sma) FILTER (dt = last), 6) AS sma200, bool_and(up) FILTER (dt = last) AS above_sma200,
max(w) FILTER (dt = last) AS w, count(*) AS bars, min(dt) AS first_bar FROM (SELECT *, max(dt) OVER (PARTITION BY symbol) AS last FROM wt) GROUP BY symbol""")
def latest_trend_weight(spark, sf_dir):
    sig = signals.trend_signals(bars(spark, sf_dir), rule("f"))
    last = sig.groupBy("symbol").agg(F.max_by(F.struct("c", "sma", "up", "w"), "dt").alias("x"), F.max("dt").alias("date"), F.count("*").alias("bars"), F.min("dt").alias("first_bar"))
    return rounded(last.select("symbol", "date", F.col("x.c").alias("close"), F.col("x.sma").alias("sma200"), F.col("x.up").alias("above_sma200"), F.col("x.w").alias("w"), "bars", "first_bar"))


@query("log_returns", f"{S} SELECT symbol, dt, {r('r', 8)} FROM s0")
def log_returns(spark, sf_dir):
    return rounded(signals.with_log_return(bars(spark, sf_dir)).select("symbol", "dt", "r"), digits=8)


@query("sigma_hat", f"{S} SELECT symbol, dt, {r('sigma', 8)} FROM s1")
def sigma_hat(spark, sf_dir):
    return rounded(signals.with_sigma(bars(spark, sf_dir), rule().sig_n).select("symbol", "dt", "sigma"), digits=8)


@query("sigma_tgt", f"{S} SELECT symbol, dt, {r('sigma_tgt', 8)} FROM s2")
def sigma_tgt(spark, sf_dir):
    own = signals.with_sigma(bars(spark, sf_dir), rule().sig_n).select("symbol", "dt", "sigma")
    return rounded(signals.with_sigma_target(own, rule().med_min).select("symbol", "dt", "sigma_tgt"), digits=8)


@query("sma200", f"{S} SELECT symbol, dt, {r('sma')} FROM s1")
def sma200(spark, sf_dir):
    return rounded(signals.with_sma(bars(spark, sf_dir), rule().sma_n).select("symbol", "dt", "sma"))


@query("trend_filter", f"{S} SELECT symbol, dt, up FROM sig")
def trend_filter(spark, sf_dir):
    return signals.trend_signals(bars(spark, sf_dir), rule("f")).select("symbol", "dt", "up")


@query("vol_weight", f"{S} SELECT symbol, dt, {r('wv', 8)} FROM sig")
def vol_weight(spark, sf_dir):
    return rounded(signals.signals(bars(spark, sf_dir), rule("v")).select("symbol", "dt", "wv"), digits=8)


def weights_query(preset: str):
    @query(f"weights_{preset}", f"{S},{sql.weighted(preset)} SELECT symbol, dt, {r('w_vol', 8)}, {r('w', 8)} FROM wt")
    def run(spark, sf_dir):
        return rounded(signals.weights(bars(spark, sf_dir), rule(preset)).select("symbol", "dt", "w_vol", "w"), digits=8)


for _preset in ("v", "f", "vf", "vf75"):
    weights_query(_preset)


@query("rebalance_flags", f"{S},{sql.weighted('vf')} SELECT symbol, dt, coalesce(abs(w - lag(w) OVER (PARTITION BY symbol ORDER BY dt)) >= 0.10::double - 1e-9::double, false) AS go FROM wt")
def rebalance_flags(spark, sf_dir):
    sig = signals.weights(bars(spark, sf_dir), rule("vf"))
    return sig.select("symbol", "dt", F.coalesce(signals.should_rebalance(F.col("w"), F.lag("w").over(signals.by_day())), F.lit(False)).alias("go"))


@query("latest_snapshot", f"""{S},{sql.weighted('vf75')}, x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS k, count(*) OVER (PARTITION BY symbol) AS bars, min(dt) OVER (PARTITION BY symbol) AS first_bar FROM wt)
SELECT symbol, dt AS date, round(c, 6) AS close, {r('w', 8)}, {r('w_vol', 8)}, {r('wv', 8)}, up AS above_sma200, round(sma, 6) AS sma200, {r('sigma', 8)}, {r('sigma_tgt', 8)},
round(CASE WHEN sigma_tgt > 0 THEN sigma / sigma_tgt END, 8) AS vol_ratio, bars, first_bar FROM x WHERE k = 1""")
def latest_snapshot(spark, sf_dir):
    return rounded(signals.latest(signals.signals(bars(spark, sf_dir), rule("vf75"))), digits=8, close=6, sma200=6)


P = {preset: f"WITH RECURSIVE {sql.paths(preset)}" for preset in ("v", "f", "vf", "vf75")}


@query("period_windows", f"{P['f']} SELECT ord, period, symbol, min(dt) AS first_day, max(dt) AS last_day, max(n) AS n FROM paths GROUP BY ALL")
def period_windows(spark, sf_dir):
    cut = windows.in_periods(bars(spark, sf_dir), windows.periods_table(spark)).where("n >= 1")
    return cut.groupBy("ord", "period", "symbol").agg(F.min("dt").alias("first_day"), F.max("dt").alias("last_day"), F.max("n").alias("n"))


@query("window_targets", f"{P['f']} SELECT period, symbol, t, dt, target FROM paths")
def window_targets(spark, sf_dir):
    return paths_of(spark, sf_dir, "f").select("period", "symbol", "t", "dt", "target")


@query("path_summary", f"{P['vf75']} SELECT period, symbol, min(dt) AS first_day, max(dt) AS last_day, max(n) AS n, round(avg(target) FILTER (t > 0), 8) AS mean_target, count(*) FILTER (t > 0 AND target < 1) AS low_days FROM paths GROUP BY ALL")
def path_summary(spark, sf_dir):
    own = paths_of(spark, sf_dir, "vf75").groupBy("period", "symbol")
    return rounded(own.agg(F.min("dt").alias("first_day"), F.max("dt").alias("last_day"), F.max("n").alias("n"), F.avg(F.when(F.col("t") > 0, F.col("target"))).alias("mean_target"), F.count_if((F.col("t") > 0) & (F.col("target") < 1)).alias("low_days")), digits=8)


NAV = f"SELECT period, symbol, t, {r('v', 8)}, {r('w', 8)}, {r('paid', 8)}, trades FROM nav"


def ledger_query(how: str, preset: str):
    @query(f"ledger_{how}", f"{P[preset]},{sql.ledger(how)} {NAV}")
    def run(spark, sf_dir):
        return rounded(ledger.ledger(paths_of(spark, sf_dir, preset), how), digits=8)


for _how, _preset in (("threshold", "f"), ("change", "f"), ("never", "f"), ("daily", "v"), ("once", "f")):
    ledger_query(_how, _preset)


@query("ledger_segments", f"{P['f']},{sql.SEGMENTS},{sql.segment_nav('paths', 'segs', 'nav', 'period, symbol')} {NAV}")
def ledger_segments(spark, sf_dir):
    paths = paths_of(spark, sf_dir, "f")
    return rounded(ledger.segment_nav(paths, controls.segments(paths)), digits=8)


@query("trade_to", """WITH g AS (SELECT o_orderkey AS id, 1 + o_orderkey % 5 AS n, (o_custkey % 7)::double AS m, 1 + o_totalprice / 98765.4321::double AS o, (o_orderkey % 5) / 4.0::double AS w FROM orders),
h AS (SELECT *, n * o AS held, n * o + m AS total, m / (1 + 0.001::double) AS cap FROM g),
x AS (SELECT *, CASE WHEN held > w * total THEN held - w * total WHEN w * total - held <= 0 THEN 0 WHEN w * total - held >= cap THEN cap ELSE w * total - held END AS x, held > w * total AS sell, w * total - held >= cap AS all_in FROM h)
SELECT id, round(CASE WHEN sell THEN n - x / o ELSE n + x / o END, 6) AS shares, round(CASE WHEN sell THEN m + (x - 0.001::double * x) WHEN w * total - held <= 0 THEN m WHEN all_in THEN 0 ELSE m - (1 + 0.001::double) * x END, 6) AS cash, round(x, 6) AS traded, round(0.001::double * x, 6) AS fee FROM x""")
def trade_to(spark, sf_dir):
    rows = src.load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), (1 + F.col("o_orderkey") % 5).cast("double").alias("n"), (F.col("o_custkey") % 7).cast("double").alias("m"), (1 + F.col("o_totalprice") / F.lit(98765.4321)).alias("o"), ((F.col("o_orderkey") % 5) / F.lit(4.0)).alias("w")
    )
    done = rows.select("id", ledger.trade(F.col("n"), F.col("m"), F.col("o"), F.col("w"), 0.001).alias("x"))
    return rounded(done.select("id", F.col("x.n").alias("shares"), F.col("x.m").alias("cash"), F.col("x.x").alias("traded"), F.col("x.fee").alias("fee")), digits=6)


M = "ret, mdd, cagr, calmar, vol, avg_w, sharpe, cost"
ALL_METRICS = ", ".join(r(m, 8) for m in M.split(", ")) + ", trades"


@query("metrics", f"{P['vf']},{sql.ledger('threshold')},{sql.metrics()} SELECT period, symbol, {ALL_METRICS} FROM metrics")
def metrics(spark, sf_dir):
    return rounded(ledger.metrics(ledger.ledger(paths_of(spark, sf_dir, "vf"))), digits=8)


@query("max_drawdown", f"{P['f']},{sql.ledger('change')},{sql.metrics()} SELECT period, symbol, {r('mdd', 8)} FROM metrics")
def max_drawdown(spark, sf_dir):
    return rounded(ledger.metrics(ledger.ledger(paths_of(spark, sf_dir, "f"), "change")).select("period", "symbol", "mdd"), digits=8)


BASE = "nav AS (SELECT period, symbol, t, c / max(c) FILTER (t = 0) OVER (PARTITION BY period, symbol) AS v, 1.0::double AS w, 0.0::double AS paid, 0 AS trades FROM paths)"


@query("sharpe", f"{P['f']},{BASE},{sql.metrics()} SELECT period, symbol, {r('sharpe', 8)} FROM metrics")
def sharpe(spark, sf_dir):
    return rounded(ledger.metrics(controls.baseline(paths_of(spark, sf_dir, "f"))).select("period", "symbol", "sharpe"), digits=8)


@query("baseline_a", f"{P['f']},{BASE},{sql.metrics()} SELECT period, symbol, {ALL_METRICS} FROM metrics")
def baseline_a(spark, sf_dir):
    return rounded(ledger.metrics(controls.baseline(paths_of(spark, sf_dir, "f"))), digits=8)


@query("segments", f"{P['f']},{sql.SEGMENTS} SELECT period, symbol, seg, s, e, n FROM segs")
def segments(spark, sf_dir):
    return controls.segments(paths_of(spark, sf_dir, "f"))


@query("low_level", f"{P['f']} SELECT period, symbol, min(target) FILTER (t >= 1 AND target < 1) AS low FROM paths WHERE t >= 1 GROUP BY ALL")
def low_level(spark, sf_dir):
    return controls.low_level(paths_of(spark, sf_dir, "f"))


@query("buyhold_c", f"""{P['f']}, q AS (SELECT *, max(c) FILTER (t = 0) OVER (PARTITION BY period, symbol) AS c0, max(o) FILTER (t = 1) OVER (PARTITION BY period, symbol) AS o1 FROM paths),
nav AS (SELECT period, symbol, t, CASE WHEN t = 0 THEN 1.0::double ELSE 0.6::double / c0 * c + 0.4::double * o1 / c0 * 0.999::double END AS v, CASE WHEN t = 0 THEN 1.0::double ELSE 0.6::double / c0 * c / (0.6::double / c0 * c + 0.4::double * o1 / c0 * 0.999::double) END AS w,
CASE WHEN t = 0 THEN 0.0::double ELSE 0.001::double * 0.4::double * o1 / c0 END AS paid, CASE WHEN t = 0 THEN 0 ELSE 1 END AS trades FROM q) {NAV}""")
def buyhold_c(spark, sf_dir):
    return rounded(controls.buyhold(paths_of(spark, sf_dir, "f"), F.lit(0.6)), digits=8)


SOLVE = """
arr AS MATERIALIZED (SELECT period, symbol, list(c ORDER BY t) FILTER (t >= 1) AS cs, max(o) FILTER (t = 1) * (1 - 0.001::double) AS k, any_value(avg_w) AS goal FROM paths JOIN metrics USING (period, symbol) GROUP BY period, symbol),
bis(period, symbol, it, lo, hi, best, rho, done) AS (
  SELECT period, symbol, 0, 0.0::double, 1.0::double, NULL::double, NULL::double, false FROM arr
  UNION ALL
  SELECT period, symbol, it + 1, CASE WHEN now < 0 THEN mid ELSE lo END, CASE WHEN now < 0 THEN hi ELSE mid END, CASE WHEN rho IS NULL OR abs(now) < abs(rho) THEN mid ELSE best END,
         CASE WHEN rho IS NULL OR abs(now) < abs(rho) THEN now ELSE rho END, abs(now) <= 1e-9::double
  FROM (SELECT b.*, (lo + hi) / 2 AS mid, list_avg(list_transform(a.cs, lambda c: (lo + hi) / 2 * c / ((lo + hi) / 2 * c + (1 - (lo + hi) / 2) * a.k))) - a.goal AS now
        FROM bis b JOIN arr a ON a.period = b.period AND a.symbol = b.symbol WHERE NOT done AND it < 100)),
dagger AS (SELECT period, symbol, arg_max(best, it) AS c, arg_max(rho, it) AS residual, max(it) AS iterations, abs(arg_max(rho, it)) <= 1e-6::double AS matched FROM bis GROUP BY period, symbol)"""


@query("c_dagger", f"{P['vf']},{sql.ledger('threshold')},{sql.metrics()},{SOLVE} SELECT period, symbol, {r('c', 7)}, matched FROM dagger")
def c_dagger(spark, sf_dir):
    paths = paths_of(spark, sf_dir, "vf")
    goals = ledger.metrics(ledger.ledger(paths)).select("period", "symbol", F.col("avg_w").alias("goal"))
    return rounded(controls.solve_matched(paths, goals).select("period", "symbol", "c", "matched"), digits=7)
