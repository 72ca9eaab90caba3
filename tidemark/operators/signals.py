"""Indicators and target weights by symbol and close: bars in, one row per bar out. Undefined values are null."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import REBALANCE_THRESHOLD, TOLERANCE, TRADING_DAYS, Rule

def by_day():
    return Window.partitionBy("symbol").orderBy("dt")


def trailing(n: int):
    return by_day().rowsBetween(1 - n, 0)


def with_log_return(bars: DataFrame) -> DataFrame:
    return bars.withColumn("r", F.ln("c") - F.lag(F.ln("c")).over(by_day()))


def with_sigma(bars: DataFrame, n: int) -> DataFrame:
    """Annualised standard deviation (one degree of freedom less) of the last n log returns."""
    w = trailing(n)
    sigma = F.when(F.count("r").over(w) >= n, F.stddev_samp("r").over(w) * F.sqrt(F.lit(float(TRADING_DAYS))))
    return with_log_return(bars).withColumn("sigma", sigma)


def with_sma(bars: DataFrame, n: int) -> DataFrame:
    w = trailing(n)
    return bars.withColumn("sma", F.when(F.count("c").over(w) >= n, F.avg("c").over(w)))


def with_sigma_target(df: DataFrame, min_defined: int) -> DataFrame:
    """Median of all sigmas so far. A grouped map: each symbol's series is short, and an exact running median has no
    built-in window function of less than quadratic cost."""
    schema = T.StructType([*df.schema, T.StructField("sigma_tgt", T.DoubleType())])

    def median(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("dt", kind="stable")
        m = own["sigma"].astype(float).expanding(min_periods=min_defined).median()
        return own.assign(sigma_tgt=m.astype(object).where(m.notna(), None))

    return df.groupBy("symbol").applyInPandas(median, schema)


def with_sigma_target_window(df: DataFrame, min_defined: int) -> DataFrame:
    """The same as a window expression; quadratic in a symbol's length, for checks on small data."""
    w = by_day().rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("sigma_tgt", F.when(F.count("sigma").over(w) >= min_defined, F.percentile("sigma", F.lit(0.5)).over(w)))


def trend(c: Column, sma: Column) -> Column:
    """Strictly above the average; true while it is undefined."""
    return F.coalesce(c > sma, F.lit(True))


def vol_weight(sigma: Column, target: Column) -> Column:
    """min(1, target / sigma); 1 while undefined or with zero sigma."""
    ok = sigma.isNotNull() & target.isNotNull() & (sigma > 0)
    return F.when(ok, F.least(F.lit(1.0), F.try_divide(target, sigma))).otherwise(1.0)


def combined(rule: Rule, wv: Column, up: Column) -> tuple[Column, Column]:
    """w_vol and w."""
    w_vol = F.lit(1.0) if not rule.vol else wv if rule.vol_floor is None else F.greatest(F.lit(float(rule.vol_floor)), wv)
    return w_vol, w_vol * F.when(up, 1.0).otherwise(float(rule.below_sma))


def signals(bars: DataFrame, rule: Rule) -> DataFrame:
    """bars with r, sigma, sma, sigma_tgt, wv, up, w_vol, w. All windows and the grouped map share one exchange."""
    out = with_sigma_target(with_sma(with_sigma(bars, rule.sig_n), rule.sma_n), rule.med_min)
    out = out.withColumns({"wv": vol_weight(F.col("sigma"), F.col("sigma_tgt")), "up": trend(F.col("c"), F.col("sma"))})
    w_vol, w = combined(rule, F.col("wv"), F.col("up"))
    return out.withColumns({"w_vol": w_vol, "w": w})


def trend_signals(bars: DataFrame, rule: Rule) -> DataFrame:
    """signals() of a rule without volatility target: no sigma, window functions only."""
    if rule.vol:
        raise ValueError("the rule has a volatility target")
    out = with_sma(bars, rule.sma_n).withColumn("up", trend(F.col("c"), F.col("sma")))
    _, w = combined(rule, F.lit(1.0), F.col("up"))
    return out.withColumns({"w_vol": F.lit(1.0), "w": w})


def weights(bars: DataFrame, rule: Rule) -> DataFrame:
    """The cheaper of signals() and trend_signals()."""
    return signals(bars, rule) if rule.vol else trend_signals(bars, rule)


def should_rebalance(new: Column, last: Column, threshold: float = REBALANCE_THRESHOLD) -> Column:
    return F.abs(new - last) >= threshold - TOLERANCE


def latest(sig: DataFrame) -> DataFrame:
    """One row per symbol: its last bar's values, number of bars and first day."""
    fields = ["c", "w", "w_vol", "wv", "up", "sma", "sigma", "sigma_tgt"]
    last = F.max_by(F.struct(*fields), "dt").alias("x")
    out = sig.groupBy("symbol").agg(F.max("dt").alias("date"), last, F.count("*").alias("bars"), F.min("dt").alias("first_bar"))
    ratio = F.when(F.col("x.sigma_tgt") > 0, F.try_divide("x.sigma", "x.sigma_tgt"))
    return out.select(
        "symbol", "date", F.col("x.c").alias("close"), F.col("x.w").alias("w"), F.col("x.w_vol").alias("w_vol"), F.col("x.wv").alias("wv"), F.col("x.up").alias("above_sma200"),
        F.col("x.sma").alias("sma200"), F.col("x.sigma").alias("sigma"), F.col("x.sigma_tgt").alias("sigma_tgt"), ratio.alias("vol_ratio"), "bars", "first_bar",
    )
