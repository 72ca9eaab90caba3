import numpy as np
import pytest
from helpers import PATHS, path_rows, random_walk, slow_ledger, slow_metrics
from pyspark.sql import functions as F

from tidemark.operators import controls, ledger


def targets(n, seed, levels):
    rng = np.random.default_rng(seed)
    return np.concatenate([[1.0], np.repeat(rng.choice(levels, n // 7 + 1), 7)[:n]])


@pytest.fixture(scope="module")
def walks():
    out = {}
    for k in range(4):
        o, c = random_walk(160, 10 + k)
        out[f"S{k}"] = (o, c, targets(159, k, [1.0, 0.5] if k < 2 else [1.0, 0.8, 0.35, 0.62]))
    return out


@pytest.fixture(scope="module")
def paths(spark, walks):
    return spark.createDataFrame([r for s, (o, c, t) in walks.items() for r in path_rows("p", s, o, c, t)], PATHS).cache()


@pytest.mark.parametrize("rule", ledger.RULES)
def test_fold_matches_a_plain_loop(paths, walks, rule):
    got = {}
    for r in ledger.ledger(paths, rule).collect():
        got.setdefault(r.symbol, {})[r.t] = r
    for s, (o, c, target) in walks.items():
        v, w, paid, trades = slow_ledger(o, c, target, rule)
        rows = [got[s][t] for t in range(len(c))]
        assert np.allclose([r.v for r in rows], v, rtol=1e-12) and np.allclose([r.w for r in rows], w, rtol=1e-12)
        assert rows[-1].paid == pytest.approx(paid, abs=1e-12) and rows[-1].trades == trades


def test_unknown_rule(paths):
    with pytest.raises(ValueError):
        ledger.ledger(paths, "weekly")


def test_two_level_targets_have_a_closed_form(paths):
    two = paths.where("symbol in ('S0', 'S1')")
    fold = ledger.ledger(two, "change").select("symbol", "t", "v", "w", "paid", "trades")
    closed = ledger.segment_nav(two, controls.segments(two), 0.5).select("symbol", "t", *[F.col(c).alias(f"{c}2") for c in ("v", "w", "paid", "trades")])
    both = fold.join(closed, ["symbol", "t"])
    assert both.count() == 320
    assert both.where("abs(v - v2) > 1e-12 or abs(w - w2) > 1e-12 or abs(paid - paid2) > 1e-12 or trades <> trades2").count() == 0


def test_trade_arithmetic(spark):
    rows = [(10.0, 0.0, 10.0, 0.5), (5.0, 50.0, 10.0, 1.0), (5.0, 50.0, 10.0, 0.6), (5.0, 50.0, 10.0, 0.5)]
    got = [r[0] for r in spark.createDataFrame(rows, "n double, m double, o double, w double").select(ledger.trade(F.col("n"), F.col("m"), F.col("o"), F.col("w"), 0.001)).collect()]
    assert (got[0].n, got[0].m, got[0].x) == pytest.approx((5, 49.95, 50)) and got[0].fee == pytest.approx(0.05)
    assert got[1].m == 0 and got[1].x == pytest.approx(50 / 1.001)  # all cash goes
    assert (got[2].n, got[2].m) == pytest.approx((6, 50 - 10.01))
    assert (got[3].n, got[3].m, got[3].x) == (5, 50, 0)


def test_metrics_by_hand(spark):
    v, w = [1, 1.02, 0.99, 1.03, 1.01], [1, 1, 0.5, 0.5, 1]
    nav = spark.createDataFrame([("p", "s", t, float(a), float(b), 0.0, 0) for t, (a, b) in enumerate(zip(v, w))], "period string, symbol string, t int, v double, w double, paid double, trades int")
    got = ledger.metrics(nav).head()
    assert got.mdd == pytest.approx(1 - 0.99 / 1.02) and got.avg_w == pytest.approx(0.75)
    for k, x in slow_metrics(v, w).items():
        assert got[k] == pytest.approx(x), k
    flat = ledger.metrics(nav.withColumn("v", F.lit(1.0))).head()
    assert flat.sharpe is None and flat.calmar is None and flat.mdd == 0


def test_segments_by_hand(spark):
    target = [1, 1, 0.5, 0.5, 1, 0.5, 1, 1, 0.5, 0.5]
    own = spark.createDataFrame(path_rows("p", "s", [1] * 10, [1] * 10, target), PATHS)
    assert [(r.s, r.e) for r in controls.segments(own).orderBy("s").collect()] == [(2, 4), (5, 6), (8, 10)]
    assert controls.low_level(own).head().low == 0.5
    with pytest.raises(Exception, match="more than one value"):
        controls.low_level(own.withColumn("target", F.when(F.col("t") == 5, 0.7).otherwise(F.col("target")))).collect()


def test_layout_and_shuffle_invariants(spark):
    n = 300
    segs = [(10, 20), (40, 41), (60, 85), (100, 130), (200, 207), (280, 301)]
    own = spark.createDataFrame([("p", "s", k, a, b, n) for k, (a, b) in enumerate(segs)] + [("p", "u", 0, 290, 301, n)], "period string, symbol string, seg int, s int, e int, n int")
    lay = {r.symbol: r for r in controls.shuffle_layout(own).collect()}
    assert (lay["s"].k, lay["s"].tail, lay["s"].range_end) == (5, 280, 279) and lay["s"].lengths == [10, 1, 25, 30, 7]
    assert lay["s"].free == 279 - sum(x + 1 for x in lay["s"].lengths) and not lay["s"].unique and lay["u"].unique
    for placed in (controls.shuffles(own, 40), controls.numpy_shuffles(own, 40)):
        by = {}
        for r in placed.collect():
            by.setdefault((r.r, r.symbol), []).append((r.s, r.e))
        assert len(by) == 80
        for (_, symbol), got in by.items():
            got.sort()
            assert got[-1] == (280, 301) if symbol == "s" else got == [(290, 301)]
            assert sorted(e - s for s, e in got) == sorted(b - a for a, b in segs) if symbol == "s" else True
            assert got[0][0] >= 1 and all(b[0] >= a[1] + 1 for a, b in zip(got, got[1:]) if b != (280, 301)) and all(e <= 280 for _, e in got[:-1])
        assert len({tuple(sorted(v)) for (r, s), v in by.items() if s == "s"}) > 30


def test_matched_buy_and_hold(spark, paths):
    goals = spark.createDataFrame([("p", "S0", 0.8), ("p", "S1", 0.31), ("p", "S2", 1.5)], "period string, symbol string, goal double")
    got = {r.symbol: r for r in controls.solve_matched(paths, goals).collect()}
    nav = ledger.metrics(controls.buyhold(paths.join(spark.createDataFrame([("p", s, got[s].c) for s in ("S0", "S1")], "period string, symbol string, x double"), ["period", "symbol"]), F.col("x")))
    avg = {r.symbol: r.avg_w for r in nav.collect()}
    assert got["S0"].matched and avg["S0"] == pytest.approx(0.8, abs=1e-9) and avg["S1"] == pytest.approx(0.31, abs=1e-9)
    assert not got["S2"].matched and got["S2"].c <= 1 and got["S2"].iterations == 100
    once = ledger.metrics(ledger.ledger(paths.withColumn("target", F.lit(0.6)), "once")).select("symbol", "ret", "avg_w", "cost").orderBy("symbol").collect()
    held = ledger.metrics(controls.buyhold(paths, F.lit(0.6))).select("symbol", "ret", "avg_w", "cost").orderBy("symbol").collect()
    assert np.allclose([r[1:] for r in once], [r[1:] for r in held])
