"""Queries of the statistics and of the two evaluations. Effects come from the evaluations over synthetic bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import N_BOOT, N_SHUFFLE, SEED, rule
from ..operators import controls, evaluate, ledger, signals, stats, windows
from ..shared import materialise
from ..sources import bars as src
from . import sql
from .bar_queries import P, SOLVE, query_into, r, rounded

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = query_into(QUERIES, ORACLE_SQL)

DRAWS = N_BOOT
SHUFFLES = N_SHUFFLE
PERIODS = [f"{a}/{b}" for a, b in windows.PERIODS]
LABELS = ", ".join(f"'{p}'" for p in PERIODS)


def paths_of(spark, sf_dir, preset):
    return windows.paths(signals.weights(src.synthetic(spark, sf_dir), rule(preset)), windows.periods_table(spark))


# ---------------------------------------------------------------- overlay

CELLS = "cells(ord, name, metric, min_effect, sign) AS (VALUES (0, 'MDD', 'mdd', 1.0::double, 1), (1, 'Sharpe', 'sharpe', 0.05::double, 1))"
MEMBERS = "members AS (SELECT symbol, CAST(row_number() OVER (ORDER BY symbol) - 1 AS INT) AS member_idx FROM (SELECT DISTINCT symbol FROM paths))"
OVERLAY = f"""{P['vf']},{sql.ledger('threshold')},{sql.metrics()},{SOLVE},
q AS (SELECT p.*, d.c AS wt0, max(p.c) FILTER (t = 0) OVER (PARTITION BY p.period, p.symbol) AS c0, max(o) FILTER (t = 1) OVER (PARTITION BY p.period, p.symbol) AS o1 FROM paths p JOIN dagger d USING (period, symbol)),
bnav AS (SELECT period, symbol, t, CASE WHEN t = 0 THEN 1.0::double ELSE wt0 / c0 * c + (1 - wt0) * o1 / c0 * (1 - 0.001::double) END AS v, 0.0::double AS w, 0.0::double AS paid, 0 AS trades FROM q),
{sql.metrics('bnav', 'bm')},{CELLS},{MEMBERS},
both_ AS (SELECT ce.name AS cell, m.period, m.symbol, m.trades >= 1 AND d.matched AS ok,
          CASE ce.metric WHEN 'mdd' THEN (b.mdd - m.mdd) * 100 ELSE m.sharpe - b.sharpe END AS g
          FROM metrics m JOIN bm b USING (period, symbol) JOIN dagger d USING (period, symbol) CROSS JOIN cells ce),
effects AS MATERIALIZED (SELECT cell, period, symbol, member_idx, CASE WHEN ok THEN g END AS g, ok AND g IS NOT NULL AS h FROM both_ JOIN members USING (symbol))"""


def boot_sql(draws: int) -> str:
    return f"""
boot AS (SELECT b, CAST(('0x' || substr(md5('{SEED}|' || b || '|' || i), 1, 8))::bigint % (SELECT count(*) FROM members) AS INT) AS member_idx, count(*) AS k
         FROM range(0, {draws}) x(b), range(0, (SELECT count(*) FROM members)) y(i) GROUP BY 1, 2)"""


STATS = f"""{boot_sql(DRAWS)},
per AS (SELECT cell, period, CASE WHEN count(*) FILTER (h) > 0 THEN sum(g) FILTER (h) / count(*) FILTER (h) END AS d, count(*) FILTER (h) AS informative FROM effects GROUP BY 1, 2),
pt AS (SELECT cell, CASE WHEN count(d) = 2 THEN avg(d) END AS t, min(informative) AS fewest FROM per GROUP BY 1),
star0 AS (SELECT cell, b, period, CASE WHEN coalesce(sum(k) FILTER (h), 0) > 0 THEN sum(k * g) FILTER (h) / sum(k) FILTER (h) END AS d FROM effects JOIN boot USING (member_idx) GROUP BY 1, 2, 3),
star AS (SELECT cell, CAST(b AS INT) AS b, CASE WHEN count(d) = 2 THEN avg(d) END AS ts FROM star0 GROUP BY 1, 2),
conf0 AS (SELECT cell, any_value(t) AS t, any_value(fewest) AS fewest, count(ts) AS valid, count(*) FILTER (abs(ts - t) >= abs(t)) AS far, quantile_cont(ts, 0.025::double) AS t_lo, quantile_cont(ts, 0.975::double) AS t_hi,
          stddev_pop(ts) AS t_sd, max(ts) - min(ts) AS rng FROM star JOIN pt USING (cell) GROUP BY 1),
conf1 AS (SELECT *, CASE WHEN t IS NULL OR t = 0 THEN valid ELSE far END AS tail, CASE WHEN t IS NULL OR t = 0 THEN 1.0::double ELSE (1 + far) / (valid + 1)::double END AS p_raw,
          concat_ws(',', CASE WHEN fewest < 10 THEN '1' END, CASE WHEN {DRAWS} - valid > 0.05 * {DRAWS} THEN '3' END, CASE WHEN fewest < 10 THEN '4' END, CASE WHEN valid = 0 OR rng = 0 THEN '5' END) AS untestable FROM conf0),
conf AS (SELECT *, CASE WHEN untestable <> '' THEN 1.0::double ELSE p_raw END AS p FROM conf1)"""
VERDICT = f"""
dd AS (SELECT cell, max(d) FILTER (period = '{PERIODS[0]}') AS d0, max(d) FILTER (period = '{PERIODS[1]}') AS d1, count(d) = 2 AS defined, max(informative) FILTER (period = '{PERIODS[0]}') AS h0, max(informative) FILTER (period = '{PERIODS[1]}') AS h1 FROM per GROUP BY 1),
ww AS (SELECT cell, max(w) FILTER (period = '{PERIODS[0]}') AS w0, max(w) FILTER (period = '{PERIODS[1]}') AS w1 FROM (SELECT cell, period, CASE WHEN count(*) FILTER (h AND member_idx % 2 = 0) > 0 THEN sum(g) FILTER (h AND member_idx % 2 = 0) / count(*) FILTER (h AND member_idx % 2 = 0) END AS w FROM effects GROUP BY 1, 2) GROUP BY 1),
gr0 AS (SELECT c.*, conf.*, dd.d0, dd.d1, dd.h0, dd.h1, ww.w0, ww.w1, coalesce(defined AND abs(d0) >= min_effect - 1e-9 AND abs(d1) >= min_effect - 1e-9, false) AS big, coalesce(sign(w0) = sign(d0) AND sign(w1) = sign(d0), false) AS agrees
        FROM cells c JOIN conf ON conf.cell = c.name JOIN dd USING (cell) JOIN ww USING (cell)),
gr AS (SELECT *, CASE WHEN untestable <> '' OR w0 IS NULL OR w1 IS NULL THEN 'inconclusive' WHEN big AND sign(d0) = sign(d1) AND sign(d0) <> 0 AND agrees THEN 'consistent' WHEN big AND sign(d0) * sign(d1) < 0 THEN 'inconsistent' ELSE 'inconclusive' END AS verdict,
       CASE WHEN w0 IS NULL OR w1 IS NULL THEN 'no informative members' WHEN agrees THEN 'passed' ELSE 'failed' END AS subset_check FROM gr0),
hm AS (SELECT *, least(1.0::double, max((m - k + 1) * p) OVER (ORDER BY k)) AS p_holm FROM (SELECT *, row_number() OVER (ORDER BY p, ord) AS k, count(*) OVER () AS m FROM gr)),
graded AS (SELECT *, CASE WHEN verdict = 'consistent' THEN CASE WHEN sign(d0) = sign THEN 'as_predicted' ELSE 'opposite' END END AS direction, p_holm <= 0.05 AS reject FROM hm)"""
GRADED = f"SELECT ord, name, {r('d0')}, {r('d1')}, {r('w0')}, {r('w1')}, {r('t')}, {r('t_lo')}, {r('t_hi')}, {r('t_sd')}, valid, {r('p')}, {r('p_holm')}, reject, untestable, verdict, direction, subset_check FROM graded"


def overlay_effects(spark, sf_dir) -> DataFrame:
    """Effects with member_idx, read by several statistics: written once."""
    paths = materialise(paths_of(spark, sf_dir, "vf"), "paths")
    strategy = materialise(ledger.metrics(ledger.ledger(paths)), "strategy")
    matched, control = evaluate.overlay_controls(paths, strategy)
    effects = evaluate.overlay_effects(strategy, matched, control, evaluate.cells_table(spark, evaluate.OVERLAY_CELLS))
    return materialise(effects.join(F.broadcast(evaluate.members(paths)), "symbol"), "effects")


@query("g_overlay", f"{OVERLAY} SELECT cell, period, symbol, member_idx, {r('g', 5)}, h FROM effects")
def g_overlay(spark, sf_dir):
    return rounded(overlay_effects(spark, sf_dir), digits=5).select("cell", "period", "symbol", "member_idx", "g", "h")


@query("boot_weights", f"{P['f']},{MEMBERS},{boot_sql(DRAWS)} SELECT CAST(b AS INT) AS b, member_idx, k FROM boot")
def boot_weights(spark, sf_dir):
    n = src.load(spark, sf_dir, "part").select("p_brand").distinct().count()
    return stats.boot_weights(spark, n, DRAWS)


@query("period_stat", f"{OVERLAY},{STATS} SELECT cell, period, {r('d')}, informative FROM per")
def period_stat(spark, sf_dir):
    return rounded(stats.period_stat(overlay_effects(spark, sf_dir)))


@query("t_point", f"{OVERLAY},{STATS} SELECT cell, {r('t')} FROM pt")
def t_point(spark, sf_dir):
    return rounded(stats.t_point(overlay_effects(spark, sf_dir), 2))


@query("t_boot", f"{OVERLAY},{STATS} SELECT cell, b, round(ts, 5) AS t FROM star")
def t_boot(spark, sf_dir):
    effects = overlay_effects(spark, sf_dir)
    return rounded(stats.t_boot(effects, stats.boot_weights(spark, evaluate.members(effects).count(), DRAWS), 2), digits=5)


def confirmed(spark, sf_dir) -> DataFrame:
    effects = overlay_effects(spark, sf_dir)
    return stats.confirm(effects, stats.boot_weights(spark, evaluate.members(effects).count(), DRAWS), 2, DRAWS)


@query("shift_p", f"{OVERLAY},{STATS} SELECT cell, round(p_raw, 8) AS p, tail FROM conf")
def shift_p(spark, sf_dir):
    effects = overlay_effects(spark, sf_dir)
    star = stats.t_boot(effects, stats.boot_weights(spark, evaluate.members(effects).count(), DRAWS), 2)
    return rounded(stats.shift_p(star, stats.t_point(effects, 2)), digits=8)


@query("t_ci", f"{OVERLAY},{STATS} SELECT cell, {r('t_lo')}, {r('t_hi')}, {r('t_sd')} FROM conf")
def t_ci(spark, sf_dir):
    return rounded(confirmed(spark, sf_dir).select("cell", "t_lo", "t_hi", "t_sd"))


@query("untestable", f"{OVERLAY},{STATS} SELECT cell, untestable, {r('p')} FROM conf")
def untestable(spark, sf_dir):
    return rounded(confirmed(spark, sf_dir).select("cell", F.array_join(F.col("untestable").cast("array<string>"), ",").alias("untestable"), "p"))


@query("holm", "WITH p AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS ord, (c_custkey * 7919 % 1009) / 2018.0::double AS p FROM customer), k AS (SELECT *, row_number() OVER (ORDER BY p, ord) AS k, count(*) OVER () AS m FROM p) SELECT CAST(ord AS BIGINT) AS ord, p, round(least(1.0::double, max((m - k + 1) * p) OVER (ORDER BY k)), 8) AS p_holm FROM k")
def holm(spark, sf_dir):
    own = src.load(spark, sf_dir, "customer")
    ranked = own.select("c_custkey", ((F.col("c_custkey") * 7919 % 1009) / F.lit(2018.0)).alias("p"))
    from pyspark.sql import Window

    ranked = ranked.select((F.row_number().over(Window.orderBy("c_custkey")) - 1).cast("long").alias("ord"), "p")
    return stats.holm(ranked).select("ord", "p", F.round("p_holm", 8).alias("p_holm"))


@query("grade", """WITH x AS (SELECT o_orderkey AS id, ((o_orderkey * 37 % 41) - 20) / 10.0::double AS d0, ((o_custkey * 53 % 41) - 20) / 10.0::double AS d1, o_orderkey % 11 = 0 AS bad FROM orders)
SELECT id, CASE WHEN bad THEN 'inconclusive' WHEN abs(d0) >= 1 - 1e-9 AND abs(d1) >= 1 - 1e-9 AND sign(d0) = sign(d1) THEN 'consistent' WHEN abs(d0) >= 1 - 1e-9 AND abs(d1) >= 1 - 1e-9 AND sign(d0) * sign(d1) < 0 THEN 'inconsistent' ELSE 'inconclusive' END AS verdict,
CASE WHEN NOT bad AND abs(d0) >= 1 - 1e-9 AND abs(d1) >= 1 - 1e-9 AND sign(d0) = sign(d1) THEN CASE WHEN d0 > 0 THEN 'as_predicted' ELSE 'opposite' END END AS direction FROM x""")
def grade(spark, sf_dir):
    rows = src.load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.array(((F.col("o_orderkey") * 37 % 41) - 20) / F.lit(10.0), ((F.col("o_custkey") * 53 % 41) - 20) / F.lit(10.0)).alias("d"),
        F.when(F.col("o_orderkey") % 11 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("bad"),
    )
    said, direction = stats.verdict(F.col("d"), F.lit(None).cast("array<double>"), F.col("bad"), F.lit(1.0), F.lit(1))
    return rows.select("id", said.alias("verdict"), direction.alias("direction"))


def even_half(names: DataFrame) -> DataFrame:
    return names.where(F.col("member_idx") % 2 == 0).select("symbol")


def graded(cells: DataFrame) -> DataFrame:
    at = lambda c, i: F.get(c, i)
    flat = cells.select(
        "ord", "name", at("d", 0).alias("d0"), at("d", 1).alias("d1"), at("wl", 0).alias("w0"), at("wl", 1).alias("w1"), "t", "t_lo", "t_hi", "t_sd", "valid", "p", "p_holm", "reject",
        F.array_join(F.col("untestable").cast("array<string>"), ",").alias("untestable"), "verdict", "direction", "subset_check",
    )
    return rounded(flat)


@query("grade_overlay", f"{OVERLAY},{STATS},{VERDICT} {GRADED}")
def grade_overlay(spark, sf_dir):
    paths = materialise(paths_of(spark, sf_dir, "vf"), "paths")
    found = evaluate.evaluate_overlay(paths, PERIODS, n_boot=DRAWS, subset=even_half(evaluate.members(paths)))
    return graded(found["cells"])


@query("cell_stats", f"{OVERLAY},{STATS},{VERDICT} SELECT name, {r('t')}, {r('p')}, untestable, verdict, h0, h1 FROM graded")
def cell_stats(spark, sf_dir):
    effects = overlay_effects(spark, sf_dir)
    names = evaluate.members(effects)
    inside = names.where(F.col("member_idx") % 2 == 0).select("member_idx")
    out = stats.cell_stats(effects, evaluate.cells_table(spark, evaluate.OVERLAY_CELLS), stats.boot_weights(spark, names.count(), DRAWS), PERIODS, DRAWS, inside)
    return rounded(out.select("name", "t", "p", F.array_join(F.col("untestable").cast("array<string>"), ",").alias("untestable"), "verdict", F.get("h_count", 0).alias("h0"), F.get("h_count", 1).alias("h1")))


@query("subset_check", f"{OVERLAY},{STATS},{VERDICT} SELECT name, subset_check FROM graded")
def subset_check(spark, sf_dir):
    paths = materialise(paths_of(spark, sf_dir, "vf"), "paths")
    found = evaluate.evaluate_overlay(paths, PERIODS, n_boot=DRAWS, subset=even_half(evaluate.members(paths)))
    return found["cells"].select("name", "subset_check")


# ---------------------------------------------------------------- segments

LAYOUT = """
lay AS (SELECT period, symbol, n, CAST(count(*) FILTER (e <= n) AS INT) AS k, list(e - s ORDER BY s) FILTER (e <= n) AS lengths, max(s) FILTER (e > n) AS tail, CAST(coalesce(sum(e - s + 1) FILTER (e <= n), 0) AS INT) AS taken FROM segs GROUP BY 1, 2, 3),
layout AS (SELECT period, symbol, n, k, coalesce(lengths, []) AS lengths, CAST(coalesce(tail - 1, n) AS INT) AS range_end, CAST(coalesce(tail - 1, n) - taken AS INT) AS free, tail, k = 0 OR (coalesce(tail - 1, n) - taken = 0 AND len(list_distinct(coalesce(lengths, []))) <= 1) AS uniq FROM lay)"""
SHUFFLED = f"""{P['f']},{sql.SEGMENTS},{LAYOUT},
draws AS (SELECT CAST(range AS INT) AS r FROM range({SHUFFLES})),
blk AS (SELECT r, period, symbol, n, e - s AS len, row_number() OVER (PARTITION BY r, period, symbol ORDER BY md5('block|{SEED}|' || r || '|' || period || '|' || symbol || '|' || s), s) - 1 AS j FROM segs, draws WHERE e <= n),
blk2 AS (SELECT *, coalesce(sum(len + 1) OVER (PARTITION BY r, period, symbol ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM blk),
plc AS (SELECT r, period, symbol, k, unnest(range(0, free + k)) AS q FROM layout, draws WHERE k > 0),
plc2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r, period, symbol ORDER BY md5('place|{SEED}|' || r || '|' || period || '|' || symbol || '|' || q), q) AS rk FROM plc) WHERE rk <= k),
plc3 AS (SELECT r, period, symbol, q, row_number() OVER (PARTITION BY r, period, symbol ORDER BY q) - 1 AS j FROM plc2),
placed AS MATERIALIZED (SELECT r, period, symbol, CAST(1 + q - j + used AS INT) AS s, CAST(1 + q - j + used + len AS INT) AS e, n FROM blk2 JOIN plc3 USING (r, period, symbol, j)
           UNION ALL SELECT r, period, symbol, s, e, n FROM segs, draws WHERE e > n)"""


@query("shuffle_layout", f"{P['f']},{sql.SEGMENTS},{LAYOUT} SELECT period, symbol, n, k, array_to_string(lengths, ',') AS lengths, range_end, free, tail, uniq FROM layout")
def shuffle_layout(spark, sf_dir):
    lay = controls.shuffle_layout(controls.segments(paths_of(spark, sf_dir, "f")))
    return lay.select("period", "symbol", "n", "k", F.array_join(F.col("lengths").cast("array<string>"), ",").alias("lengths"), "range_end", "free", "tail", F.col("unique").alias("uniq"))


@query("shuffle_once", f"{SHUFFLED} SELECT r, period, symbol, s, e, n FROM placed")
def shuffle_once(spark, sf_dir):
    return controls.shuffles(controls.segments(paths_of(spark, sf_dir, "f")), SHUFFLES)


FAN = f"""{SHUFFLED},
fan AS (SELECT r, period, symbol, t, o, c FROM (SELECT DISTINCT r, period, symbol FROM placed) JOIN paths USING (period, symbol)),
{sql.segment_nav('fan', 'placed', 'snav', 'r, period, symbol')},{sql.metrics('snav', 'sm', 'r, period, symbol')},
summary AS (SELECT period, symbol, count(*) AS draws, avg(mdd) AS mdd, avg(sharpe) AS sharpe, avg(calmar) AS calmar FROM sm GROUP BY 1, 2),
{sql.segment_nav('paths', 'segs', 'nav', 'period, symbol')},{sql.metrics()},
cells(ord, name, metric, min_effect, sign) AS (VALUES (0, 'MDD', 'mdd', 1.0::double, 1), (1, 'Calmar', 'calmar', 0.05::double, 1)),{MEMBERS},
both_ AS (SELECT ce.name AS cell, m.period, m.symbol, s.period IS NOT NULL AS ok, CASE ce.metric WHEN 'mdd' THEN (s.mdd - m.mdd) * 100 ELSE m.calmar - s.calmar END AS g FROM metrics m LEFT JOIN summary s USING (period, symbol) CROSS JOIN cells ce),
effects AS MATERIALIZED (SELECT cell, period, symbol, member_idx, CASE WHEN ok THEN g END AS g, ok AND g IS NOT NULL AS h FROM both_ JOIN members USING (symbol))"""


def segments_evaluated(spark, sf_dir, subset: bool = False) -> dict:
    paths = materialise(paths_of(spark, sf_dir, "f"), "paths")
    return evaluate.evaluate_segments(paths, PERIODS, n_shuffle=SHUFFLES, n_boot=DRAWS, subset=even_half(evaluate.members(paths)) if subset else None)


@query("shuffle_summary", f"{FAN} SELECT period, symbol, draws, {r('mdd')}, {r('sharpe')}, {r('calmar')} FROM summary")
def shuffle_summary(spark, sf_dir):
    return rounded(segments_evaluated(spark, sf_dir)["summary"].drop("fewest_trades", "most_trades"))


@query("g_segments", f"{FAN} SELECT cell, period, symbol, {r('g', 5)}, h FROM effects")
def g_segments(spark, sf_dir):
    return rounded(segments_evaluated(spark, sf_dir)["effects"], digits=5)


@query("shuffle_trade_check", f"{FAN} SELECT r, period, symbol, sm.trades AS drawn, m.trades AS trades FROM sm JOIN metrics m USING (period, symbol) WHERE sm.trades <> m.trades")
def shuffle_trade_check(spark, sf_dir):
    found = segments_evaluated(spark, sf_dir)
    return evaluate.trade_mismatch(found["shuffles"], found["strategy"]).select("r", "period", "symbol", "drawn", "trades")


@query("grade_segments", f"{FAN},{STATS},{VERDICT} {GRADED}")
def grade_segments(spark, sf_dir):
    return graded(segments_evaluated(spark, sf_dir, subset=True)["cells"])
