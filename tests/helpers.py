"""Plain versions of the ordered computations, and small paths."""

import datetime as dt
import math

import numpy as np


def bars_rows(symbol, closes, opens=None, start=dt.date(2020, 1, 1)):
    opens = closes if opens is None else opens
    return [(symbol, start + dt.timedelta(days=i), float(o), float(max(o, c)), float(min(o, c)), float(c), 1.0) for i, (o, c) in enumerate(zip(opens, closes))]


BARS = "symbol string, dt date, o double, h double, l double, c double, v double"


def random_walk(n, seed, vol=0.02):
    rng = np.random.default_rng(seed)
    c = 100 * np.exp(np.cumsum(vol * rng.normal(size=n)))
    o = np.concatenate([[c[0]], c[:-1] * np.exp(0.003 * rng.normal(size=n - 1))])
    return o, c


def path_rows(period, symbol, o, c, target, ord_=0):
    n = len(c) - 1
    return [(ord_, period, symbol, t, n, dt.date(2020, 1, 1) + dt.timedelta(days=t), float(o[t]), float(c[t]), float(target[t])) for t in range(n + 1)]


PATHS = "ord int, period string, symbol string, t int, n int, dt date, o double, c double, target double"


def slow_ledger(o, c, target, rule, cost=0.001):
    """Shares, cash and their value day by day."""
    shares, cash, paid, trades, last = 1 / c[0], 0.0, 0.0, 0, 1.0
    v, w = [1.0], [1.0]
    for t in range(1, len(c)):
        held = shares * o[t]
        total = held + cash
        go = {"never": False, "daily": True, "once": t == 1, "change": target[t] != last, "threshold": abs(target[t] - held / total) >= 0.1 - 1e-9}[rule]
        last = target[t]
        if go:
            gap = target[t] * total - held
            if gap < 0:
                shares, cash, x = shares + gap / o[t], cash - gap * (1 - cost), -gap
            else:
                x = min(gap, cash / (1 + cost))
                cash = 0.0 if gap >= cash / (1 + cost) else cash - (1 + cost) * x
                shares += x / o[t]
            paid, trades = paid + cost * x, trades + (x > 0)
        v.append(shares * c[t] + cash)
        w.append(shares * c[t] / v[-1])
    return np.array(v), np.array(w), paid, trades


def slow_metrics(v, w):
    v, w = np.asarray(v, float), np.asarray(w, float)
    n, simple, logs = len(v) - 1, v[1:] / v[:-1] - 1, np.diff(np.log(v))
    mdd = float((1 - v / np.maximum.accumulate(v)).max())
    cagr = v[-1] ** (252 / n) - 1
    return {
        "ret": v[-1] - 1, "mdd": mdd, "cagr": cagr, "calmar": cagr / mdd if mdd > 0 else None, "vol": logs.std(ddof=1) * math.sqrt(252), "avg_w": w[1:].mean(),
        "sharpe": simple.mean() / simple.std(ddof=1) * math.sqrt(252) if simple.std(ddof=1) > 0 else None,
    }
