import numpy as np
import pytest
from helpers import BARS, bars_rows, random_walk
from pyspark.sql import functions as F

from tidemark.config import PRESETS, Rule, parse_budget, parse_floor, rule
from tidemark.operators import signals, windows


@pytest.fixture(scope="module")
def bars(spark):
    rows = [r for k in range(3) for r in bars_rows(f"S{k}", random_walk(420, k)[1])]
    return spark.createDataFrame(rows, BARS).cache()


def test_warm_up_lengths(spark, bars):
    out = signals.signals(bars, rule()).where("symbol = 'S0'").orderBy("dt").collect()
    first = lambda c: next(i for i, r in enumerate(out) if r[c] is not None)
    assert (first("sigma"), first("sma"), first("sigma_tgt")) == (20, 199, 269)
    assert all(r.w == 1 for r in out[:199]) and {r.up for r in out[:199]} == {True}


def test_values_against_numpy(bars):
    out = signals.signals(bars, rule("vf")).where("symbol = 'S1'").orderBy("dt").collect()
    c = np.array([r.c for r in out])
    logs = np.diff(np.log(c))
    j = 350
    sigma = lambda i: logs[i - 20 : i].std(ddof=1) * np.sqrt(252)
    target = np.median([sigma(i) for i in range(20, j + 1)])
    assert out[j].sigma == pytest.approx(sigma(j), rel=1e-9) and out[j].sigma_tgt == pytest.approx(target, rel=1e-9) and out[j].sma == pytest.approx(c[j - 199 : j + 1].mean(), rel=1e-12)
    assert out[j].w == pytest.approx(min(1, target / sigma(j)) * (1 if c[j] > c[j - 199 : j + 1].mean() else 0.5), rel=1e-9)


def test_both_medians_agree(bars):
    own = signals.with_sigma(bars, 20).select("symbol", "dt", "sigma")
    a = signals.with_sigma_target(own, 250).withColumnRenamed("sigma_tgt", "a").select("symbol", "dt", "a")
    b = signals.with_sigma_target_window(own, 250).withColumnRenamed("sigma_tgt", "b").select("symbol", "dt", "b")
    assert a.join(b, ["symbol", "dt"]).where("not (a <=> b) and abs(a - b) > 1e-12 * b or (a is null) <> (b is null)").count() == 0


def test_flat_prices_have_weight_one_and_are_not_above(spark):
    flat = spark.createDataFrame(bars_rows("X", [50.0] * 320), BARS)
    out = signals.signals(flat, rule("vf")).orderBy("dt").collect()
    assert {r.wv for r in out} == {1.0}  # zero sigma
    assert out[-1].up is False and out[-1].w == 0.5  # equal is not above


def test_no_look_ahead(bars):
    cut = bars.where(F.col("dt") < "2021-01-15")
    whole = signals.signals(bars, rule()).where(F.col("dt") < "2021-01-15").select("symbol", "dt", "w")
    assert whole.exceptAll(signals.signals(cut, rule()).select("symbol", "dt", "w")).count() == 0


def test_custom_rules_see_only_the_past(spark, bars):
    periods = windows.periods_table(spark, (("2020-06-01", "2020-09-30"), ("2020-10-01", "2021-01-10")))
    own = windows.paths(signals.trend_signals(bars, rule("f", sma_n=50)), periods)

    def above(closes):
        sums = np.cumsum(np.concatenate([[0], closes]))
        sma = np.concatenate([np.full(49, np.nan), (sums[50:] - sums[:-50]) / 50])
        return np.where(np.isnan(sma) | (closes > sma), 1.0, 0.5)

    custom = windows.custom_paths(bars, periods, above)
    assert own.count() == custom.count() > 0
    both = own.join(custom.select("period", "symbol", "t", F.col("target").alias("other"), F.col("n").alias("m")), ["period", "symbol", "t"])
    assert both.count() == own.count() and both.where("target <> other or n <> m").count() == 0
    with pytest.raises(Exception, match="one weight per close"):
        windows.custom_paths(bars, periods, lambda c: c[:-1]).collect()


def test_rebalance_threshold(spark):
    got = spark.createDataFrame([(0.9, 1.0), (0.95, 1.0), (1.0, 0.9)], "a double, b double").select(signals.should_rebalance(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [True, False, True]


def test_rules_and_options():
    assert set(PRESETS) == {"v", "f", "vf", "vf75"} and rule().triple == (True, 0.75, 0.75)
    assert rule("vf75", vol_floor=None).vol_floor is None and rule("v", below_sma=0.5).triple == rule("vf").triple
    assert parse_floor("none") is None and parse_floor("0.5") == 0.5 and parse_budget("3") == 3
    for bad in (lambda: rule("x"), lambda: Rule(below_sma=0), lambda: Rule(vol_floor=1.5), lambda: parse_floor("2"), lambda: parse_budget("inf"), lambda: Rule(anchor="2020-13-01")):
        with pytest.raises(ValueError):
            bad()


def test_latest(bars):
    out = {r.symbol: r for r in signals.latest(signals.signals(bars, rule())).collect()}
    assert len(out) == 3 and out["S0"].bars == 420 and str(out["S0"].first_bar) == "2020-01-01"
    assert out["S0"].vol_ratio == pytest.approx(out["S0"].sigma / out["S0"].sigma_tgt)
    short = signals.latest(signals.signals(bars.where("dt < '2020-02-01'"), rule())).collect()[0]
    assert short.sigma_tgt is None and short.vol_ratio is None and short.w == 1
