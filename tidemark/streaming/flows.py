"""Streaming forms: bars from an event stream, log observation in micro-batches, a ledger that keeps its state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import journal
from ..config import COST, REBALANCE_THRESHOLD, TOLERANCE


def bars_stream(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Daily OHLCV by event type. With `append` output a bar comes once the watermark has passed its day: it is settled
    then, and events that come later than `late` are not counted."""
    when = F.struct("ts", "event_id")
    day = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 day"), F.col("event_type"))
    bars = day.agg(F.min_by("value", when).alias("o"), F.max("value").alias("h"), F.min("value").alias("l"), F.max_by("value", when).alias("c"), F.count("*").cast("double").alias("v"))
    return bars.select(F.col("event_type").alias("symbol"), F.to_date("window.start").alias("dt"), "o", "h", "l", "c", "v")


def observe_batch(log_path: str, ref: str, repo: str = ""):
    """For foreachBatch: parses activity entries, drops known and repeated ones, seals the rest onto the observations at log_path.

    Each batch is one append; a batch that runs again finds its entries in the log and adds nothing.
    """

    def run(batch: DataFrame, _: int) -> None:
        journal.observe_items(batch, log_path, repo, ref)

    return run


STATE = "shares double, cash double, paid double, trades int, t int"
OUTPUT = "symbol string, t int, dt date, v double, w double, paid double, trades int"


def ledger_stream(days: DataFrame, cost: float = COST, threshold: float = REBALANCE_THRESHOLD) -> DataFrame:
    """The threshold ledger over a stream of (symbol, dt, o, c, target), each symbol's days in order.

    State per symbol: shares, cash, cost so far, trades, days. A micro-batch's days of a symbol are put in order of dt.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        shares, cash, paid, trades, t = state.get if state.exists else (None, 0.0, 0.0, 0, -1)
        out = []
        for row in pd.concat(list(frames)).sort_values("dt").itertuples():
            t += 1
            if shares is None:
                shares = 1.0 / row.c
            else:
                held = shares * row.o
                total = held + cash
                if abs(row.target - held / total) >= threshold - TOLERANCE:
                    gap = row.target * total - held
                    if gap < 0:
                        x = -gap
                        shares, cash = shares - x / row.o, cash + x - cost * x
                    else:
                        x = min(gap, cash / (1 + cost))
                        shares, cash = shares + x / row.o, 0.0 if x < gap or gap == cash / (1 + cost) else cash - (1 + cost) * x
                    paid, trades = paid + cost * x, trades + (x > 0)
            value = shares * row.c + cash
            out.append((key[0], t, row.dt, value, shares * row.c / value, paid, int(trades)))
        state.update((shares, cash, paid, int(trades), t))
        yield pd.DataFrame(out, columns=["symbol", "t", "dt", "v", "w", "paid", "trades"])

    return days.groupBy("symbol").applyInPandasWithState(step, OUTPUT, STATE, "append", "NoTimeout")
