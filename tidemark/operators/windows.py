"""Evaluation windows: bars and weights cut to periods, with the weight of the close before each open."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PERIODS = (("1996-01-01", "1998-06-30"), ("1998-07-01", "2001-06-30"))
KEYS = ["period", "symbol"]


def periods_table(spark: SparkSession, periods=PERIODS) -> DataFrame:
    """ord, period (label), start, stop."""
    rows = [(i, f"{a}/{b}", a, b) for i, (a, b) in enumerate(periods)]
    table = spark.createDataFrame(rows, "ord int, period string, start string, stop string")
    return table.select("ord", "period", F.to_date("start").alias("start"), F.to_date("stop").alias("stop"))


def in_periods(df: DataFrame, periods: DataFrame) -> DataFrame:
    """Rows of df once for each period that holds their day, with t counted from 0 and n the last t.

    A range join against a fixed handful of periods, which is broadcast.
    """
    p = F.broadcast(periods)
    own = df.join(p, (df["dt"] >= p["start"]) & (df["dt"] <= p["stop"])).drop("start", "stop")
    whole = Window.partitionBy(*KEYS)
    return own.withColumn("t", F.row_number().over(whole.orderBy("dt")) - 1).withColumn("n", F.count("*").over(whole).cast("int") - 1)


def paths(weighted: DataFrame, periods: DataFrame) -> DataFrame:
    """ord, period, symbol, t, n, dt, o, c, target: the target for the open of t is the weight at the close before it.

    The weight is looked up in the whole series before the cut, so a period's first open has one; t = 0 has 1.
    A period with fewer than two bars of a symbol is left out.
    """
    before = weighted.withColumn("before", F.lag("w").over(Window.partitionBy("symbol").orderBy("dt")))
    cut = in_periods(before.select("symbol", "dt", "o", "c", "before"), periods).where("n >= 1")
    return cut.select("ord", *KEYS, "t", "n", "dt", "o", "c", F.when(F.col("t") == 0, 1.0).otherwise(F.col("before")).alias("target"))


def custom_paths(bars: DataFrame, periods: DataFrame, target: Callable) -> DataFrame:
    """paths() for a rule given as a function of closes to weights of the same length.

    It is called once per period and symbol and gets the closes before the period's last only, so no rule can read
    ahead. A grouped map: the function is arbitrary NumPy code, and a symbol's daily series fits in a task.
    """
    p = F.broadcast(periods)
    seen = bars.select("symbol", "dt", "o", "c").join(p, bars["dt"] <= p["stop"])

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("dt", kind="stable").reset_index(drop=True)
        inside = own["dt"] >= own["start"]
        closes = own["c"].to_numpy(dtype=float)
        first, n = int((~inside).sum()), int(inside.sum()) - 1
        out = own[inside].copy()
        if n < 1:
            return out.assign(t=0, n=n, target=1.0)[["ord", *KEYS, "t", "n", "dt", "o", "c", "target"]].iloc[:0]
        w = target(closes[: first + n])
        if getattr(w, "shape", None) != (first + n,):
            raise ValueError("a rule returns one weight per close")
        return out.assign(t=range(n + 1), n=n, target=[1.0, *w[first : first + n].tolist()])[["ord", *KEYS, "t", "n", "dt", "o", "c", "target"]]

    return seen.groupBy(*KEYS).applyInPandas(run, "ord int, period string, symbol string, t int, n int, dt date, o double, c double, target double")
