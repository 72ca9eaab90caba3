"""Queries of bar maintenance and of evidence classification.

Stored bars are the synthetic ones up to a day; fetched ones the 30 days before and 20 after, with gaps and, for some
symbols, changed prices. Configurations are made from the rows of `part`.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evidence, maintain
from ..sources import bars as src
from . import sql
from .bar_queries import query_into, r, rounded

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = query_into(QUERIES, ORACLE_SQL)

LAST = "1999-06-30"
FROM, TO = "1999-05-31", "1999-07-20"
ANCHOR = "1995-06-01"
#: Adjusted symbols end in 3, symbols without stored bars in 4, symbols whose fetch failed in 5.
B = f"""WITH {sql.BARS.strip()},
old AS (SELECT * FROM bars WHERE dt <= DATE '{LAST}' AND symbol NOT LIKE '%4'),
fresh AS (SELECT symbol, dt, o, h, l, CASE WHEN symbol LIKE '%3' THEN c * 0.5::double ELSE c END AS c, v FROM bars WHERE dt BETWEEN DATE '{FROM}' AND DATE '{TO}' AND day(dt) <> 13 AND symbol NOT LIKE '%4' AND symbol NOT LIKE '%5'),
whole AS (SELECT symbol, dt, o, h, l, c * 0.5::double AS c, v FROM bars WHERE dt BETWEEN DATE '{ANCHOR}' AND DATE '{TO}' AND (symbol LIKE '%3' OR symbol LIKE '%4') AND NOT (symbol = 'Brand#13' AND day(dt) = 13)),
same AS (SELECT old.symbol, bool_and(abs(old.c - fresh.c) / abs(old.c) <= 1e-9) AS ok FROM old JOIN fresh USING (symbol, dt) GROUP BY 1),
ok AS (SELECT symbol, coalesce(ok, false) AS ok FROM (SELECT symbol FROM old UNION SELECT symbol FROM fresh) LEFT JOIN same USING (symbol)),
last AS (SELECT symbol, max(dt) AS last FROM old GROUP BY 1),
gap AS (SELECT old.* FROM old JOIN last USING (symbol) WHERE dt >= last - 30 AND NOT EXISTS (SELECT 1 FROM fresh f WHERE f.symbol = old.symbol AND f.dt = old.dt)),
merged AS (SELECT * FROM fresh UNION ALL SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.symbol = old.symbol AND f.dt = old.dt)),
cnt AS (SELECT f.symbol, count(*) FILTER (f.dt > last) AS appended, bool_and(coalesce(o.c = f.c AND o.o = f.o AND o.v = f.v AND o.h = f.h AND o.l = f.l, false)) AS unchanged FROM fresh f LEFT JOIN last USING (symbol) LEFT JOIN old o ON o.symbol = f.symbol AND o.dt = f.dt GROUP BY 1),
gapw AS (SELECT symbol, count(*) AS n FROM old WHERE dt >= DATE '{ANCHOR}' AND NOT EXISTS (SELECT 1 FROM whole f WHERE f.symbol = old.symbol AND f.dt = old.dt) GROUP BY 1),
facts AS (SELECT s.symbol, s.symbol IN (SELECT symbol FROM old) AS has_old, s.symbol IN (SELECT symbol FROM fresh) AS has_new, s.symbol IN (SELECT symbol FROM whole) AS has_full, coalesce(ok, false) AS ok, coalesce(unchanged, false) AS unchanged, coalesce(appended, 0) AS appended,
         coalesce((SELECT count(*) FROM gap g WHERE g.symbol = s.symbol), 0) AS gn, coalesce(w.n, 0) AS gf FROM (SELECT DISTINCT symbol FROM bars) s LEFT JOIN ok USING (symbol) LEFT JOIN cnt USING (symbol) LEFT JOIN gapw w USING (symbol)),
decided AS (SELECT *, CASE WHEN has_old AND NOT has_new THEN 'cache' WHEN has_old AND ok THEN CASE WHEN unchanged THEN 'none' ELSE 'append' END WHEN NOT has_full THEN CASE WHEN has_old THEN 'cache' ELSE 'failed' END
            WHEN has_old THEN CASE WHEN gf = 0 THEN 'replace' ELSE 'cache' END ELSE 'initial' END AS action FROM facts)"""


def frames(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    bars = src.synthetic(spark, sf_dir)
    ends = lambda x: F.col("symbol").endswith(x)
    old = bars.where((F.col("dt") <= LAST) & ~ends("4"))
    fresh = bars.where(F.col("dt").between(FROM, TO) & (F.dayofmonth("dt") != 13) & ~ends("4") & ~ends("5")).withColumn("c", F.when(ends("3"), F.col("c") * 0.5).otherwise(F.col("c")))
    whole = bars.where(F.col("dt").between(ANCHOR, TO) & (ends("3") | ends("4")) & ~((F.col("symbol") == "Brand#13") & (F.dayofmonth("dt") == 13))).withColumn("c", F.col("c") * 0.5)
    return bars, old, fresh, whole


@query("overlap_ok", f"{B} SELECT symbol, ok FROM ok")
def overlap_ok(spark, sf_dir):
    _, old, fresh, _ = frames(spark, sf_dir)
    return maintain.overlap_ok(old, fresh)


@query("merge_by_date", f"{B} SELECT symbol, dt, {r('o')}, {r('h')}, {r('l')}, {r('c')}, v FROM merged")
def merge_by_date(spark, sf_dir):
    _, old, fresh, _ = frames(spark, sf_dir)
    return rounded(maintain.merge_by_date(old, fresh).select("symbol", "dt", "o", "h", "l", "c", "v"), "v")


@query("missing_cached", f"{B} SELECT symbol, dt FROM gap")
def missing_cached(spark, sf_dir):
    _, old, fresh, _ = frames(spark, sf_dir)
    since = old.groupBy("symbol").agg(F.date_sub(F.max("dt"), maintain.OVERLAP_DAYS).alias("since"))
    return maintain.missing_cached(old.join(since, "symbol"), fresh, F.col("since")).select("symbol", "dt")


@query("append_count", f"{B} SELECT symbol, appended, unchanged FROM cnt")
def append_count(spark, sf_dir):
    _, old, fresh, _ = frames(spark, sf_dir)
    return maintain.append_count(old, fresh)


@query("update_decision", f"""{B} SELECT symbol, action, action IN ('cache', 'failed') OR (action IN ('append', 'none') AND gn > 0) AS degraded,
CAST(CASE WHEN action IN ('append', 'none') THEN gn WHEN has_new AND has_full AND has_old THEN gf ELSE 0 END AS BIGINT) AS gap, CAST(CASE WHEN action = 'append' THEN appended ELSE 0 END AS BIGINT) AS appended FROM decided""")
def update_decision(spark, sf_dir):
    bars, old, fresh, whole = frames(spark, sf_dir)
    return maintain.decide(bars, old, fresh, whole, ANCHOR)


@query("updated_bars", f"""{B}, stored AS (SELECT o.* FROM old o JOIN decided USING (symbol) WHERE action IN ('cache', 'none') UNION ALL SELECT w.* FROM whole w JOIN decided USING (symbol) WHERE action IN ('replace', 'initial') UNION ALL SELECT m.* FROM merged m JOIN decided USING (symbol) WHERE action = 'append')
SELECT symbol, count(*) AS bars, max(dt) AS last, round(sum(c), 4) AS total FROM stored GROUP BY 1""")
def updated_bars(spark, sf_dir):
    bars, old, fresh, whole = frames(spark, sf_dir)
    stored = maintain.update(old, fresh, whole, maintain.decide(bars, old, fresh, whole, ANCHOR))
    return rounded(stored.groupBy("symbol").agg(F.count("*").alias("bars"), F.max("dt").alias("last"), F.sum("c").alias("total")), digits=4)


@query("settled_bars", f"WITH {sql.BARS.strip()}, x AS (SELECT *, max(dt) OVER (PARTITION BY symbol) AS last FROM bars WHERE dt >= DATE '1996-01-01') SELECT symbol, dt, {r('c')} FROM x WHERE NOT (dt = last AND dt = DATE '2001-11-04')")
def settled_bars(spark, sf_dir):
    kept = maintain.settled(src.synthetic(spark, sf_dir), dt.date(2001, 11, 4), dt.time(15, 59), "1996-01-01")
    return rounded(kept.select("symbol", "dt", "c"))


# ---------------------------------------------------------------- evidence
CONFIG_SQL = """configs AS (SELECT p_partkey AS id, ['v', 'f', 'vf', 'vf75'][CAST(p_partkey % 4 AS INT) + 1] AS preset, p_size % 2 = 0 AS vol, [NULL, 0.0, 0.5, 0.75][CAST(p_size % 4 AS INT) + 1]::double AS vol_floor,
[1.0, 0.5, 0.75][CAST(p_partkey % 3 AS INT) + 1]::double AS below_sma, CASE WHEN p_partkey % 7 = 0 THEN '2016-01-01' ELSE '2019-06-01' END AS anchor, 20 AS sig_n, 250 AS med_min, CASE WHEN p_partkey % 5 = 0 THEN 150 ELSE 200 END AS sma_n FROM part),
rules(rule, rv, rf, rb, status) AS (VALUES ('v', true, NULL::double, 1.0::double, 'tested_drawdown_only'), ('f', false, NULL, 0.5, 'tested_drawdown_only'), ('vf', true, NULL, 0.5, 'components_tested_separately')),
presets(preset, pv, pf, pb) AS (VALUES ('v', true, NULL::double, 1.0::double), ('f', false, NULL, 0.5), ('vf', true, NULL, 0.5), ('vf75', true, 0.75, 0.75)),
matched AS (SELECT c.*, rule, status FROM configs c LEFT JOIN rules ON vol = rv AND vol_floor IS NOT DISTINCT FROM rf AND below_sma = rb),
cls AS (SELECT m.*, concat_ws(',', CASE WHEN anchor <> '2019-06-01' THEN 'anchor=' || anchor END, CASE WHEN sma_n <> 200 THEN 'sma_n=' || sma_n END) AS frozen,
  CASE WHEN rule IS NOT NULL THEN '' WHEN vol AND vol_floor = 0.75 AND below_sma = 0.75 THEN 'vol_floor=0.75 (descriptive comparison only),below_sma=0.75 (descriptive comparison only)'
       ELSE concat_ws(',', CASE WHEN vol <> pv THEN 'vol=' || vol END, CASE WHEN vol_floor IS DISTINCT FROM pf THEN 'vol_floor=' || coalesce(regexp_replace(CAST(vol_floor AS VARCHAR), '\\.0$', ''), 'none') END, CASE WHEN below_sma <> pb THEN 'below_sma=' || regexp_replace(CAST(below_sma AS VARCHAR), '\\.0$', '') END) END AS own FROM matched m JOIN presets p ON m.preset = p.preset)"""


def configs(spark, sf_dir) -> DataFrame:
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), i.cast("int") + 1)
    key, size = F.col("p_partkey"), F.col("p_size")
    return src.load(spark, sf_dir, "part").select(
        key.alias("id"), pick(["v", "f", "vf", "vf75"], key % 4).alias("preset"), (size % 2 == 0).alias("vol"), pick([None, 0.0, 0.5, 0.75], size % 4).cast("double").alias("vol_floor"), pick([1.0, 0.5, 0.75], key % 3).alias("below_sma"),
        F.when(key % 7 == 0, "2016-01-01").otherwise("2019-06-01").alias("anchor"), F.lit(20).alias("sig_n"), F.lit(250).alias("med_min"), F.when(key % 5 == 0, 150).otherwise(200).alias("sma_n"),
    )


@query("config_match", f"WITH {CONFIG_SQL} SELECT id, rule, status FROM matched")
def config_match(spark, sf_dir):
    return evidence.match(configs(spark, sf_dir)).select("id", "rule", "status")


@query("config_classify", f"""WITH {CONFIG_SQL} SELECT id, CASE WHEN frozen = '' AND rule IS NOT NULL THEN status ELSE 'untested_parameters' END AS config_status, concat_ws(',', nullif(frozen, ''), nullif(own, '')) AS deviations,
CASE WHEN frozen = '' THEN rule END AS applied_rule FROM cls""")
def config_classify(spark, sf_dir):
    out = evidence.classify(configs(spark, sf_dir))
    return out.select("id", "config_status", F.array_join("deviations", ",").alias("deviations"), "applied_rule")


FINDING_ROWS = ", ".join(f"({o}, {'NULL' if c is None else repr(c)}, '{k}', '{u}', '{res}')" for o, c, k, u, _, _, res, *_ in evidence.FINDINGS)


@query("findings_applicability", f"WITH {CONFIG_SQL}, findings(ord, cell, component, frule, result) AS (VALUES {FINDING_ROWS}) SELECT id, ord, cell, component, result, coalesce(frule = CASE WHEN frozen = '' THEN rule END, false) AS applies FROM cls, findings")
def findings_applicability(spark, sf_dir):
    return evidence.findings(configs(spark, sf_dir), ["id"]).select("id", "ord", "cell", "component", "result", "applies")


@query("universe_membership", """WITH x AS (SELECT l_orderkey AS id, upper(p_brand) AS symbol FROM lineitem JOIN part ON l_partkey = p_partkey), u AS (SELECT DISTINCT upper(p_brand) AS symbol, true AS inside FROM part WHERE p_brand < 'Brand#40')
SELECT id, CASE WHEN bool_and(coalesce(inside, false)) THEN 'in_backtest_universe' WHEN bool_or(coalesce(inside, false)) THEN 'mixed' ELSE 'not_backtested' END AS universe_membership FROM x LEFT JOIN u USING (symbol) GROUP BY 1""")
def universe_membership(spark, sf_dir):
    part = src.load(spark, sf_dir, "part")
    items = src.load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_partkey")
    asked = items.join(part, items["l_partkey"] == part["p_partkey"]).select("id", F.lower("p_brand").alias("symbol"))
    return evidence.universe_membership(asked, part.where("p_brand < 'Brand#40'").select(F.col("p_brand").alias("symbol")), ["id"])
