"""Ledgers over paths, and metrics of net asset values.

A path is traded from full investment at the close of t = 0. `ledger` is the general one: each path's days pass in order
through a task, in Arrow batches. `segment_nav` is a closed form for two-level targets, with window functions only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import COST, REBALANCE_THRESHOLD, TOLERANCE, TRADING_DAYS

RULES = ("never", "threshold", "change", "daily", "once")
METRICS = ("ret", "mdd", "cagr", "calmar", "vol", "avg_w", "sharpe")


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def trade(n: Column, m: Column, o: Column, w: Column, cost: float) -> Column:
    """Struct n, m, x (traded value), fee: shares n and cash m brought to weight w at open o.

    Selling raises cash less the fee; buying spends at most what the cash pays for with its fee, and then leaves none.
    """
    held = n * o
    total = held + m
    cap = m / (1 + cost)
    want = w * total - held
    row = lambda a, b, x: F.struct(a.alias("n"), b.alias("m"), x.alias("x"), (cost * x).alias("fee"))
    sell = held - w * total
    return (
        F.when(held > w * total, row(n - sell / o, m + (sell - cost * sell), sell))
        .when(want <= 0, row(n, m, F.lit(0.0)))
        .when(want >= cap, row(n + cap / o, F.lit(0.0), cap))
        .otherwise(row(n + want / o, m - (1 + cost) * want, want))
    )


def ledger(paths: DataFrame, rule: str = "threshold", cost: float = COST, threshold: float = REBALANCE_THRESHOLD, keys=("period", "symbol")) -> DataFrame:
    """keys, t, v, w, paid, trades: net asset value and weight by day, the running cost and number of trades.

    A day needs the shares and cash of the day before, so each path's days pass in order through one task, which keeps the
    state of one path only: time is linear in a path's length, and no path is held whole.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rebalance rule {rule!r}")
    names = [*keys, "t", "v", "w", "paid", "trades"]
    schema = T.StructType([*(paths.schema[k] for k in keys), T.StructField("t", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in ("v", "w", "paid")), T.StructField("trades", T.IntegerType())])
    least = threshold - TOLERANCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, n, m, previous, paid, trades = None, 0.0, 0.0, 1.0, 0.0, 0
        for batch in batches:
            out = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                key, (t, o, c, target) = row[: len(keys)], row[len(keys) :]
                if key != path:
                    path, n, m, previous, paid, trades = key, 1.0 / c, 0.0, 1.0, 0.0, 0
                    out.append((t, 1.0, 1.0, 0.0, 0))
                    continue
                held = n * o
                go = rule == "daily" or rule == "once" and t == 1 or rule == "change" and target != previous or rule == "threshold" and abs(target - held / (held + m)) >= least
                previous = target
                if go:
                    goal, cap = target * (held + m), m / (1 + cost)
                    x = min(max(goal - held, 0.0), cap)
                    if held > goal:
                        x = held - goal
                        n, m = n - x / o, m + (x - cost * x)
                    elif x < cap:
                        n, m = n + x / o, m - (1 + cost) * x
                    else:
                        n, m = n + x / o, 0.0
                    paid, trades = paid + cost * x, trades + (x > 0)
                value = n * c + m
                out.append((t, value, n * c / value, paid, trades))
            made = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *(pa.array(x, k) for x, k in zip(made, (pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int32())))], names=names)

    days = paths.select(*keys, F.col("t").cast("int").alias("t"), *[F.col(c).cast("double").alias(c) for c in ("o", "c", "target")])
    return days.repartition(*keys).sortWithinPartitions(*keys, "t").mapInArrow(run, schema)


def segment_nav(paths: DataFrame, segments: DataFrame, low: float = 0.5, cost: float = COST, keys=("period", "symbol")) -> DataFrame:
    return segment_nav_with_low(paths.withColumn("low", F.lit(low)), segments, cost, keys)


def segment_nav_with_low(paths: DataFrame, segments: DataFrame, cost: float = COST, keys=("period", "symbol")) -> DataFrame:
    """keys, t, v, w, paid, trades for trades at the opens of segments (keys, s, e) only; weight `low` inside [s, e).

    At each s and after each e there is no cash, so a segment multiplies the shares by a factor of its own two opens:
    shares before a segment are a running product, and each day's value follows from the last event before it.
    """
    low = F.col("low")
    marks = segments.select(*keys, F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(True).alias("down")), F.struct(F.col("e").alias("t"), F.lit(False).alias("down")))).alias("x")).select(*keys, "x.*")
    path = paths.select(*keys, "t", "o", "c", "low").join(marks, [*keys, "t"], "left")
    order = Window.partitionBy(*keys).orderBy("t")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    down = path.withColumns({"last_down": F.last("down", True).over(so_far), "o_s": F.last(F.when(F.col("down"), F.col("o")), True).over(so_far), "c0": F.first("c").over(order)})
    factor = low + (1 - low) * (1 - cost) / (1 + cost) * F.col("o_s") / F.col("o")
    shares = F.exp(F.sum(F.when(~F.col("down"), F.ln(factor)).otherwise(0.0)).over(so_far)) / F.col("c0")
    out = down.withColumn("k", shares)
    is_low = F.coalesce("last_down", F.lit(False))
    cash = (1 - cost) * (1 - low) * F.col("k") * F.col("o_s")
    value = F.when(is_low, low * F.col("k") * F.col("c") + cash).otherwise(F.col("k") * F.col("c"))
    before = F.lag("k").over(order)
    fee = F.when(F.col("down"), cost * (1 - low) * F.col("k") * F.col("o_s")).when(~F.col("down"), cost * (1 - cost) * (1 - low) * before * F.col("o_s") / (1 + cost)).otherwise(0.0)
    out = out.withColumns({"v": value, "w": F.when(is_low, low * F.col("k") * F.col("c") / value).otherwise(1.0), "fee": fee})
    return out.select(*keys, "t", "v", "w", F.sum("fee").over(so_far).alias("paid"), F.count("down").over(so_far).cast("int").alias("trades"))


def metrics(nav: DataFrame, keys=("period", "symbol")) -> DataFrame:
    """keys, METRICS, cost, trades. Undefined values are null."""
    order = Window.partitionBy(*keys).orderBy("t")
    peak = F.max("v").over(order.rowsBetween(Window.unboundedPreceding, 0))
    days = nav.withColumns({"fall": 1 - F.col("v") / peak, "simple": F.col("v") / F.lag("v").over(order) - 1, "log": F.ln("v") - F.lag(F.ln("v")).over(order)})
    out = days.groupBy(*keys).agg(
        F.max_by("v", "t").alias("last"), F.max("t").alias("n"), F.max("fall").alias("mdd"), F.stddev_samp("log").alias("sd_log"), F.avg("simple").alias("mean"), F.stddev_samp("simple").alias("sd"),
        F.avg(F.when(F.col("t") > 0, F.col("w"))).alias("avg_w"), F.max_by("paid", "t").alias("cost"), F.max_by("trades", "t").alias("trades"),
    )
    year = F.sqrt(F.lit(float(TRADING_DAYS)))
    cagr = F.when(F.col("n") > 0, F.pow("last", F.try_divide(F.lit(float(TRADING_DAYS)), "n")) - 1)
    sharpe = F.when(F.col("sd") > 0, F.try_divide("mean", "sd") * year)
    out = out.withColumn("cagr", cagr)
    return out.select(
        *keys, (F.col("last") - 1).alias("ret"), "mdd", "cagr", F.when(F.col("mdd") > 0, F.try_divide("cagr", "mdd")).alias("calmar"), (F.col("sd_log") * year).alias("vol"),
        F.coalesce("avg_w", F.lit(1.0)).alias("avg_w"), sharpe.alias("sharpe"), "cost", "trades",
    )
