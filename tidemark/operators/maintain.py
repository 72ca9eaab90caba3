"""Incremental maintenance of bars: stored and newly fetched bars by symbol, decided and merged for all symbols at once."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ANCHOR

PRICES = ["o", "h", "l", "c", "v"]
KEY = ["symbol", "dt"]
#: Relative difference up to which two closes of one day are the same.
SAME_CLOSE = 1e-9
OVERLAP_DAYS = 30
#: New York time from which a day's bar is settled.
SETTLED_AT = dt.time(16, 5)


def overlap_ok(old: DataFrame, new: DataFrame) -> DataFrame:
    """symbol, ok: the closes of all common days agree; false without a common day. One row per symbol of either."""
    both = old.select(*KEY, F.col("c").alias("a")).join(new.select(*KEY, F.col("c").alias("b")), KEY)
    same = both.groupBy("symbol").agg(F.bool_and(F.coalesce(F.try_divide(F.abs(F.col("a") - F.col("b")), F.abs("a")) <= SAME_CLOSE, F.col("a") == F.col("b"))).alias("ok"))
    every = old.select("symbol").unionByName(new.select("symbol")).distinct()
    return every.join(same, "symbol", "left").select("symbol", F.coalesce("ok", F.lit(False)).alias("ok"))


def merge_by_date(old: DataFrame, new: DataFrame) -> DataFrame:
    """Days of `new` replace those of `old`."""
    return old.join(new.select(*KEY), KEY, "left_anti").unionByName(new)


def missing_cached(old: DataFrame, new: DataFrame, since) -> DataFrame:
    """Stored days from `since` (a column, per symbol or constant) that were not fetched again."""
    return old.where(F.col("dt") >= since).join(new.select(*KEY), KEY, "left_anti")


def append_count(old: DataFrame, new: DataFrame) -> DataFrame:
    """symbol, appended: fetched days after the last stored one; unchanged: whether the merge gives what is stored."""
    last = old.groupBy("symbol").agg(F.max("dt").alias("last"))
    stored = old.select(*KEY, F.struct(*PRICES).alias("was"))
    own = new.select(*KEY, F.struct(*PRICES).alias("now")).join(last, "symbol", "left").join(stored, KEY, "left")
    return own.groupBy("symbol").agg(F.count_if(F.col("last").isNull() | (F.col("dt") > F.col("last"))).alias("appended"), F.bool_and(F.coalesce(F.col("was") == F.col("now"), F.lit(False))).alias("unchanged"))


def settled(bars: DataFrame, today: dt.date, time_et: dt.time, anchor: str | None = ANCHOR) -> DataFrame:
    """bars from the anchor on, less a symbol's last bar if it is today's and the day is not over."""
    kept = bars if anchor is None else bars.where(F.col("dt") >= F.lit(anchor).cast("date"))
    if time_et >= SETTLED_AT:
        return kept
    last = F.max("dt").over(Window.partitionBy("symbol"))
    return kept.withColumn("_last", last).where(~((F.col("dt") == F.col("_last")) & (F.col("dt") == F.lit(today)))).drop("_last")


def decide(symbols: DataFrame, old: DataFrame, new: DataFrame, full: DataFrame, anchor: str = ANCHOR) -> DataFrame:
    """symbol, action, degraded, gap, appended.

    new: bars fetched from OVERLAP_DAYS before each symbol's last stored day; full: bars fetched from the anchor, for
    symbols without stored bars or whose overlap differs. Actions: `append`, `none` (nothing new), `replace` (prices were
    adjusted), `initial`, `cache` (keep what is stored), `failed`. A full fetch that lacks stored days never replaces them.
    """
    since = old.groupBy("symbol").agg(F.date_sub(F.max("dt"), OVERLAP_DAYS).alias("since"))
    recent = missing_cached(old.join(since, "symbol"), new, F.col("since")).groupBy("symbol").agg(F.count("*").alias("gap_new"))
    whole = missing_cached(old, full, F.lit(anchor).cast("date")).groupBy("symbol").agg(F.count("*").alias("gap_full"))
    has = lambda df, name: df.select("symbol").distinct().withColumn(name, F.lit(True))
    out = symbols.select("symbol").distinct()
    for part in (has(old, "has_old"), has(new, "has_new"), has(full, "has_full"), overlap_ok(old, new), recent, whole, append_count(old, new)):
        out = out.join(part, "symbol", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    action = (
        F.when(yes("has_old") & ~yes("has_new"), "cache")
        .when(yes("has_old") & yes("ok"), F.when(yes("unchanged"), "none").otherwise("append"))
        .when(~yes("has_full"), F.when(yes("has_old"), "cache").otherwise("failed"))
        .when(yes("has_old"), F.when(none("gap_full"), "replace").otherwise("cache"))
        .otherwise("initial")
    )
    out = out.withColumn("action", action)
    gap = F.when(F.col("action").isin("append", "none"), F.coalesce("gap_new", F.lit(0))).when(yes("has_new") & yes("has_full") & yes("has_old"), F.coalesce("gap_full", F.lit(0))).otherwise(0)
    degraded = F.col("action").isin("cache", "failed") | (F.col("action").isin("append", "none") & ~none("gap_new"))
    return out.select("symbol", "action", degraded.alias("degraded"), gap.cast("long").alias("gap"), F.when(F.col("action") == "append", F.coalesce("appended", F.lit(0))).otherwise(0).cast("long").alias("appended"))


def update(old: DataFrame, new: DataFrame, full: DataFrame, decisions: DataFrame) -> DataFrame:
    """The bars to store after decide()."""
    by = decisions.select("symbol", "action")
    only = lambda df, *actions: df.join(by.where(F.col("action").isin(*actions)), "symbol", "left_semi")
    kept = only(old, "cache", "none").unionByName(only(full, "replace", "initial"))
    return kept.unionByName(merge_by_date(only(old, "append"), only(new, "append")))
