"""All rules on five series with a known character, every day against plain loops."""

import math
import statistics

import numpy as np
import pytest
from helpers import BARS, bars_rows

from tidemark.config import PRESETS, rule
from tidemark.operators import signals


def walk(seed, vol):
    return 50 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0.0002, vol)))


def series():
    days = np.arange(560)
    calm_then_wild = walk(13, np.where(days < 330, 0.007, 0.025))
    halted = walk(12, np.full(560, 0.018))
    halted[410:445] = halted[410]  # no change for longer than sigma's window
    near_the_floor = walk(14, np.where(days < 400, 0.01, np.where(days // 20 % 2, 0.0123, 0.0145)))
    waves = 80 * (1 + 0.2 * np.sin(days / 12)) * walk(15, np.full(560, 0.003)) / 50
    return {"plain": walk(11, np.full(560, 0.02)), "halted": halted, "regimes": calm_then_wild, "floor": near_the_floor, "waves": waves}


def slow_weights(closes, vol, floor, below):
    logs, sigmas, out = [math.log(b / a) for a, b in zip(closes, closes[1:])], [], []
    for i, c in enumerate(closes):
        sigma = statistics.stdev(logs[i - 20 : i]) * math.sqrt(252) if i >= 20 else None
        if sigma is not None:
            sigmas.append(sigma)
        target = statistics.median(sigmas) if len(sigmas) >= 250 else None
        w = 1.0
        if vol and target is not None and sigma > 1e-12:
            w = min(1.0, target / sigma)
            w = w if floor is None else max(w, floor)
        if i >= 199 and not c > sum(closes[i - 199 : i + 1]) / 200:
            w *= below
        out.append(w)
    return out


@pytest.mark.parametrize("preset", sorted(PRESETS))
def test_every_day_of_every_series(spark, preset):
    every = series()
    own = spark.createDataFrame([r for name, closes in every.items() for r in bars_rows(name, closes)], BARS)
    got = {}
    for r in signals.signals(own, rule(preset)).orderBy("symbol", "dt").select("symbol", "w").collect():
        got.setdefault(r.symbol, []).append(r.w)
    vol, floor, below = rule(preset).triple
    for name, closes in every.items():
        want = slow_weights(closes.tolist(), vol, floor, below)
        assert np.allclose(got[name], want, atol=1e-9), name
        assert len(set(np.round(want, 6))) > 1, name  # the rule does something on each


def test_the_series_have_their_character():
    every = {name: np.array(slow_weights(c.tolist(), True, 0.75, 0.75)) for name, c in series().items()}
    only_vol = {name: np.array(slow_weights(c.tolist(), True, None, 1.0)) for name, c in series().items()}
    assert (only_vol["halted"][431:445] == 1).all() and (only_vol["regimes"][400:] < 0.7).all()
    assert 0 < (only_vol["floor"][420:] < 0.75).mean() < 1
    assert (np.diff((every["waves"] < 1).astype(int)) != 0).sum() > 6
