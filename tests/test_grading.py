import json

import numpy as np
import pytest
from helpers import PATHS, path_rows, random_walk
from pyspark.sql import functions as F

from tidemark import api
from tidemark.functions.text import general
from tidemark.operators import controls, evaluate, stats


def test_general_number_format(spark):
    numbers = [0.0, 0.75, 200.0, 1.0, -0.5, 1e-4, 1.25e-5, 123456.0, 1234567.0, 999999.5, 0.1 + 0.2, 1 / 3, 1e20, -2.5e-7, 100000.0, 1e6, float("inf"), float("nan")]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", general(F.col("x")).alias("s")).collect()
    assert [r.s for r in rows] == [f"{x:g}" for x in numbers]
    assert spark.range(1).select(general(F.lit(None).cast("double"))).head()[0] is None


def effects_frame(spark, g, h):
    rows = [(c, p, i, None if x is None else float(x), bool(y)) for (c, p), (xs, ys) in {k: (g[k], h[k]) for k in g}.items() for i, (x, y) in enumerate(zip(xs, ys))]
    return spark.createDataFrame(rows, "cell string, period string, member_idx int, g double, h boolean")


def test_holm_by_hand(spark):
    p = [0.01, 0.04, 0.03, 0.20, 0.0005]
    got = stats.holm(spark.createDataFrame(list(enumerate(p)), "ord int, p double")).orderBy("ord").collect()
    assert [r.p_holm for r in got] == pytest.approx([0.04, 0.09, 0.09, 0.20, 0.0025])


def test_shift_p_by_hand(spark):
    star = spark.createDataFrame([("c", b, t) for b, t in enumerate([1.0, 1.5, 2.5, 3.1, None])], "cell string, b int, t double")
    point = spark.createDataFrame([("c", 1.5)], "cell string, t double")
    got = stats.shift_p(star, point).head()
    assert (got.p, got.tail) == (pytest.approx(0.4), 1)
    assert stats.shift_p(star, point.withColumn("t", F.lit(0.0))).head().p == 1


def test_boot_weights(spark):
    for source in ("md5", "numpy"):
        rows = stats.boot_weights(spark, 12, 50, 3, source).collect()
        total = {}
        for r in rows:
            total[r.b] = total.get(r.b, 0) + r.k
        assert set(total.values()) == {12} and len(total) == 50 and {r.member_idx for r in rows} == set(range(12))
    with pytest.raises(ValueError):
        stats.boot_weights(spark, 2, 2, 2, "dice")


def test_confirm_against_numpy(spark):
    rng = np.random.default_rng(0)
    m, draws = 14, 300
    g = {("a", p): rng.normal(1, 1, m) for p in ("p", "q")} | {("b", p): rng.normal(0, 1, m) for p in ("p", "q")}
    h = {k: rng.random(m) > (0.1 if k[0] == "a" else 0.6) for k in g}
    boot = stats.boot_weights(spark, m, draws)
    w = np.zeros((draws, m))
    for r in boot.collect():
        w[r.b, r.member_idx] = r.k
    got = {r.cell: r for r in stats.confirm(effects_frame(spark, g, h), boot, 2, draws).collect()}
    for cell in ("a", "b"):
        with np.errstate(invalid="ignore"):
            each = [(w @ (g[cell, p] * h[cell, p])) / (w @ h[cell, p].astype(float)) for p in ("p", "q")]
        ts = np.mean(each, axis=0)
        ok = ts[np.isfinite(ts)]
        t = np.mean([g[cell, p][h[cell, p]].mean() for p in ("p", "q")])
        r = got[cell]
        assert r.t == pytest.approx(t) and r.valid == len(ok) and r.t_sd == pytest.approx(ok.std()) and (r.t_lo, r.t_hi) == pytest.approx(tuple(np.percentile(ok, [2.5, 97.5])))
        assert r.p_raw == pytest.approx((1 + (np.abs(ok - t) >= abs(t)).sum()) / (len(ok) + 1))
        few = min(h[cell, p].sum() for p in ("p", "q")) < 10
        assert (1 in r.untestable and 4 in r.untestable) == few and (r.p == 1 if r.untestable else r.p == r.p_raw)


def test_untestable_rules(spark):
    m = 12
    boot = stats.boot_weights(spark, m, 100)
    same = effects_frame(spark, {("a", p): [2.0] * m for p in ("p", "q")}, {("a", p): [True] * m for p in ("p", "q")})
    assert stats.confirm(same, boot, 2, 100).head().untestable == [5]
    none = effects_frame(spark, {("a", p): [None] * m for p in ("p", "q")}, {("a", p): [False] * m for p in ("p", "q")})
    got = stats.confirm(none, boot, 2, 100).head()
    assert got.untestable == [1, 3, 4, 5] and got.t is None and got.p == 1


@pytest.mark.parametrize(
    "d, wl, bad, said, direction",
    [
        ([2.0, 1.5], None, [], "consistent", "as_predicted"),
        ([-2.0, -1.5], None, [], "consistent", "opposite"),
        ([2.0, -1.5], None, [], "inconsistent", None),
        ([2.0, 0.5], None, [], "inconclusive", None),
        ([2.0, None], None, [], "inconclusive", None),
        ([2.0, 1.0], [1.0, -1.0], [], "inconclusive", None),
        ([2.0, 1.0], [1.0, 3.0], [], "consistent", "as_predicted"),
        ([2.0, 1.5], None, [4], "inconclusive", None),
        ([1.0 - 5e-10, 1.5, -1.2], None, [], "consistent", "as_predicted"),
    ],
)
def test_verdicts(spark, d, wl, bad, said, direction):
    row = spark.createDataFrame([(d, wl, bad)], "d array<double>, wl array<double>, bad array<int>")
    got = row.select(*stats.verdict(F.col("d"), F.col("wl"), F.col("bad"), F.lit(1.0), F.lit(1))).head()
    assert tuple(got) == (said, direction)


@pytest.fixture(scope="module")
def paths(spark):
    rows = []
    for k in range(12):
        for i, p in enumerate(("p", "q")):
            o, c = random_walk(130, 100 * i + k)
            target = np.concatenate([[1.0], np.repeat(np.random.default_rng(k).choice([1.0, 0.5], 19), 7)[:129]])
            rows += path_rows(p, f"S{k:02}", o, c, target, i)
    return spark.createDataFrame(rows, PATHS).cache()


VERDICTS = {"consistent", "inconsistent", "inconclusive"}


def test_overlay_end_to_end(spark, paths):
    out = evaluate.evaluate_overlay(paths, ["p", "q"], n_boot=100)
    cells = out["cells"].orderBy("ord").collect()
    assert [c.name for c in cells] == ["MDD", "Sharpe"] and {c.verdict for c in cells} <= VERDICTS and all(0 < c.p <= c.p_holm <= 1 for c in cells)
    own, control = ({(r.period, r.symbol): r for r in out[k].collect()} for k in ("strategy", "control"))
    for r in out["effects"].where("cell = 'MDD' and h").collect():
        k = r.period, r.symbol
        assert r.g == pytest.approx(100 * (control[k].mdd - own[k].mdd)) and control[k].avg_w == pytest.approx(own[k].avg_w, abs=1e-6)
    nobody = evaluate.evaluate_overlay(paths, ["p", "q"], n_boot=50, subset=spark.createDataFrame([("none",)], "symbol string"))["cells"].collect()
    assert {(c.subset_check, c.verdict) for c in nobody} == {("no informative members", "inconclusive")}


def test_single_period_is_descriptive(paths):
    got = evaluate.evaluate_overlay(paths.where("period = 'p'"), ["p"], n_boot=50)["cells"].collect()
    assert {c.verdict for c in got} == {evaluate.SINGLE_PERIOD} and all(c.p is None for c in got)


@pytest.mark.parametrize("source", ["md5", "numpy"])
def test_segments_end_to_end(paths, source):
    out = evaluate.evaluate_segments(paths, ["p", "q"], n_shuffle=10, n_boot=60, source=source)
    assert evaluate.trade_mismatch(out["shuffles"], out["strategy"]).count() == 0
    assert {r.draws for r in out["summary"].collect()} == {10}
    assert {c.verdict for c in out["cells"].collect()} <= VERDICTS


def test_evaluations_as_plain_rows(paths):
    out = evaluate.evaluate_overlay(paths, ["p", "q"], n_boot=50)
    plain = json.loads(json.dumps(api.evaluation_dict(out), default=str, allow_nan=False))
    assert [c["name"] for c in plain["cells"]] == ["MDD", "Sharpe"] and len(plain["strategy"]) == len(plain["c_dagger"]) == 24 and "summary" not in plain
    assert plain["cells"][0]["d"] == [pytest.approx(x) for x in out["cells"].orderBy("ord").head().d]


def test_another_number_of_trades_is_an_error(paths, monkeypatch):
    whole = controls.shuffles
    monkeypatch.setattr(controls, "shuffles", lambda segs, *a, **k: whole(segs, *a, **k).where("not (r = 1 and symbol = 'S03' and period = 'q' and s < 60)"))
    with pytest.raises(ValueError, match="S03"):
        evaluate.evaluate_segments(paths, ["p", "q"], n_shuffle=3, n_boot=20)


def test_cells_are_checked():
    for cells in ((), evaluate.SEGMENT_CELLS, (evaluate.Cell("x", "ret", evaluate.MATCHED, 1.0),), evaluate.OVERLAY_CELLS * 2):
        with pytest.raises(ValueError):
            evaluate.check_cells(cells, evaluate.MATCHED)
