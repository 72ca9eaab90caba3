"""Stored bars brought up to date: fetch, decide, merge, write, for all requested symbols at once."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import ANCHOR
from .operators import maintain
from .sources import bars, remote

#: What each action of maintain.decide() says of a symbol.
NOTES = {"append": "appended {appended} row(s)", "none": "no new data", "replace": "prices were adjusted, fetched anew", "initial": "first fetch", "cache": "fetch failed or incomplete, stored bars kept", "failed": "fetch failed"}


def stored(spark: SparkSession, place: str) -> tuple[DataFrame, bool]:
    """The bars at place, and whether they are a table: a folder of CSV files by symbol, or a Parquet table; empty if neither."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(place)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return spark.createDataFrame([], bars.BARS), True
    if files.globStatus(hadoop.Path(place, "*.csv")):
        return bars.read_csv(spark, place), False
    return bars.read_table(spark, place), True


def refresh(spark: SparkSession, place: str, symbols: list[str], today: dt.date, transport: Callable, budget: remote.Budget, time_et: dt.time = dt.time(23, 59), anchor: str = ANCHOR) -> dict[str, dict]:
    """Fetches what is new, and everything where prices were adjusted or nothing is stored; writes what is to be stored.

    Returns note, degraded and, where the budget ran out first, error by symbol. What is stored of a symbol changes whole or
    not at all.
    """
    whole, tabular = stored(spark, place)
    asked = spark.createDataFrame([(s,) for s in dict.fromkeys(symbols)], "symbol string")
    old = whole.join(F.broadcast(asked), "symbol", "left_semi").cache()  # of the requested symbols
    stop, first = today + dt.timedelta(days=1), dt.date.fromisoformat(anchor)
    last = {r["symbol"]: r["last"] for r in old.groupBy("symbol").agg(F.max("dt").alias("last")).collect()}
    over = lambda df: maintain.settled(df, today, time_et, None)
    new, notes = remote.bars_frame(spark, sorted(last), {s: d - dt.timedelta(days=maintain.OVERLAP_DAYS) for s, d in last.items()}, stop, transport, budget)
    new = over(new).cache()
    spent = {s: n for s, n in notes.items() if "budget" in n}
    fits = {r["symbol"]: r["ok"] for r in maintain.overlap_ok(old, new).collect()}
    again = [s for s in dict.fromkeys(symbols) if s not in spent and (s not in last or (s in fits and not fits[s]))]
    full, notes = remote.bars_frame(spark, again, first, stop, transport, budget)
    full = over(full).cache()
    spent |= {s: n for s, n in notes.items() if "budget" in n}
    done = maintain.decide(asked, old, new, full, anchor).cache()
    out = {r["symbol"]: {"note": NOTES[r["action"]].format(appended=r["appended"]) + (f"; {r['gap']} stored day(s) missing in the answer" if r["gap"] else ""), "degraded": r["degraded"], "error": None, "action": r["action"]} for r in done.collect()}
    for s, note in spent.items():
        out[s] = {"note": None, "degraded": True, "error": note, "action": "cache"}
    written = [s for s, x in out.items() if x["action"] in ("append", "replace", "initial")]
    if written:
        fresh = maintain.update(old, new, full, done).where(F.col("symbol").isin(written))
        if tabular:
            staging = f"{place.rstrip('/')}-{uuid.uuid4().hex}"  # the table is read while it is made
            bars.write_table(fresh, staging)
            bars.write_table(bars.read_table(spark, staging), place)
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
            hadoop.Path(staging).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop.Path(staging), True)
        else:
            bars.write_csv(fresh, place)
    for df in (old, new, full, done):
        df.unpersist()
    return out
