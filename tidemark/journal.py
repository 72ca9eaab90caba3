"""The forward log as a Parquet table: append a day's snapshots, observe pushes, verify. One writer at a time."""

from __future__ import annotations

import datetime as dt
import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import __version__
from .config import Rule, rule as preset_rule
from .operators import evidence, signals, track
from .sources import remote

FIELDS = ("asof", "symbol", "close", "w", "w_vol", "above_sma200", "sma200", "sigma", "sigma_tgt", "vol_ratio", "params", "rule_version", "bars_through", "runner", "generated_at")
SCHEMA = (
    "asof date, symbol string, close double, w double, w_vol double, above_sma200 boolean, sma200 double, sigma double, sigma_tgt double, vol_ratio double, "
    "params struct<preset: string, vol: boolean, vol_floor: double, below_sma: double, anchor: string, sig_n: int, med_min: int, sma_n: int>, "
    "rule_version string, bars_through date, runner string, generated_at timestamp, log int, seq long, canon string, prev_hash string, row_hash string"
)


class Refused(Exception):
    """The log fails verification, or there is nothing that may be appended."""


def read(spark: SparkSession, path: str) -> DataFrame:
    """The log; empty where there is none."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def error(log: DataFrame) -> str | None:
    """The first failing line: chain, hashes, repeated (asof, symbol), content against the hashed text, bars of another day."""
    changed = ~F.col("canon").eqNullSafe(canon())
    bad = track.verify(log, ["log"], ["asof", "symbol"], {"content does not match": changed, "bars_through is not asof": ~F.col("bars_through").eqNullSafe(F.col("asof"))}).head()
    return f"line {bad.line}: {bad.error}" if bad else None


def canon():
    """Numbers as Spark writes them, timestamps as seconds: the same text for the same stored row."""
    text = lambda c: F.to_json("params") if c == "params" else F.col(c).cast("long") if c == "generated_at" else F.col(c)
    return track.canonical({c: text(c) for c in FIELDS})


def runner() -> str:
    return "ci" if os.environ.get("CI") == "true" else "local"


def append(
    bars: DataFrame, path: str, today: dt.date, symbols=evidence.UNIVERSE, rule: Rule | None = None, generated_at: dt.datetime | None = None, asof: dt.date | None = None, dry_run: bool = False,
) -> dict:
    """Appends the newest day's snapshot of each symbol that has that day and is not in the log for it.

    Symbols of older days are stale and left out; the same day can be filled up later, an earlier one cannot. Returns the
    day, the appended rows, the stale symbols and the day's deadline. Nothing is written if the log fails verification, or
    in a dry run, which alone may ask for an earlier day `asof`.
    """
    if asof is not None and not dry_run:
        raise Refused("an earlier day is for dry runs only")
    spark, rule = bars.sparkSession, rule or preset_rule()
    log = read(spark, path).cache()
    if problem := error(log):
        raise Refused(f"{path}: {problem}")
    order = spark.createDataFrame([(i, s) for i, s in enumerate(symbols)], "ord int, symbol string")
    own = bars.join(F.broadcast(order.select("symbol")), "symbol", "left_semi").where(F.col("dt") >= rule.anchor)
    if asof is not None:
        own = own.where(F.col("dt") <= F.lit(asof))
    last = signals.latest(signals.signals(own, rule)).cache()
    newest = last.agg(F.max("date")).head()[0]
    if newest is None:
        raise Refused("no symbol has settled bars")
    if newest > today:
        raise Refused(f"the newest day {newest} is after today {today}")
    if newest.weekday() >= 5:
        raise Refused(f"the newest day {newest} is no weekday")
    have = {r.symbol: r.date for r in last.select("symbol", "date").collect()}  # one row per requested symbol
    head = log.orderBy(F.desc("seq")).select("seq", "row_hash").head()
    after, previous = (head.seq, head.row_hash) if head else (0, track.ZERO)
    params = F.struct(*[F.lit(v).cast(t).alias(k) for k, v, t in (("preset", rule.preset, "string"), ("vol", rule.vol, "boolean"), ("vol_floor", rule.vol_floor, "double"), ("below_sma", rule.below_sma, "double"), ("anchor", rule.anchor, "string"), ("sig_n", rule.sig_n, "int"), ("med_min", rule.med_min, "int"), ("sma_n", rule.sma_n, "int"))])
    when = generated_at or dt.datetime.now(dt.timezone.utc).replace(microsecond=0)
    rows = track.append_plan(last, log.select("asof", "symbol"), today).join(F.broadcast(order), "symbol")
    rows = rows.withColumns({"params": params, "rule_version": F.lit(__version__), "bars_through": F.col("date"), "runner": F.lit(runner()), "generated_at": F.lit(when).cast("timestamp"), "log": F.lit(0)})
    rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy("log").orderBy("ord")).cast("long") + after)  # at most one row per symbol
    rows = track.seal(rows.select(*FIELDS, "log", "seq", canon().alias("canon")), ["log"], F.lit(previous))
    written = rows.select(*[c.split()[0] for c in ("asof", *FIELDS[1:], "log", "seq", "canon", "prev_hash", "row_hash")]).orderBy("seq").collect()
    if written and not dry_run:
        spark.createDataFrame(written, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    due = spark.range(1).select(F.date_format(track.deadline(F.lit(newest)), "yyyy-MM-dd'T'HH:mm:ss'Z'")).head()[0]
    log.unpersist()
    last.unpersist()
    return {"asof": newest, "deadline": due, "rows": [r.asDict(True) for r in written], "stale": {s: have.get(s) for s in symbols if have.get(s) != newest}}


OBSERVATION = ("event_id", "push_time", "head_sha", "commits", "repo", "observed_at")
OBSERVATIONS = "event_id string, push_time timestamp, head_sha string, commits array<string>, repo string, observed_at timestamp, log int, seq long, canon string, prev_hash string, row_hash string"


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """The observations; empty where there are none."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], OBSERVATIONS)
    return spark.read.schema(OBSERVATIONS).parquet(path)


def observation_canon():
    text = {"push_time": F.col("push_time").cast("long"), "observed_at": F.col("observed_at").cast("long"), "commits": F.array_join("commits", ",")}
    return track.canonical({c: text.get(c, F.col(c)) for c in OBSERVATION})


def observation_error(log: DataFrame) -> str | None:
    changed = ~F.col("canon").eqNullSafe(observation_canon())
    bad = track.verify(log, ["log"], ["event_id"], {"content does not match": changed}).head()
    return f"line {bad.line}: {bad.error}" if bad else None


def observe(spark: SparkSession, path: str, entries: list[dict], repo: str, ref: str, observed_at: dt.datetime | None = None) -> list[dict]:
    """observe_items() of activity entries as they come from the API; returns the appended rows."""
    new = observe_items(remote.activity_frame(spark, entries), path, repo, ref, observed_at)
    return [r.asDict(True) for r in new.orderBy("seq").collect()]


def observe_items(items: DataFrame, path: str, repo: str, ref: str, observed_at: dt.datetime | None = None) -> DataFrame:
    """Appends the pushes to `ref` among activity entries that the log does not have, oldest first; returns the new rows.

    items: id, activity_type, ref, after, timestamp and, where entries share an id and the first one counts, seq.
    """
    spark = items.sparkSession
    log = read_observations(spark, path)
    if problem := observation_error(log):
        raise Refused(f"{path}: {problem}")
    when = observed_at or dt.datetime.now(dt.timezone.utc).replace(microsecond=0)
    parsed = track.parse_activity(items, ref)
    fresh = track.observe(parsed, log, "seq" if "seq" in items.columns else "push_time")
    head = log.orderBy(F.desc("seq")).select("seq", "row_hash").head()
    after, previous = (head.seq, head.row_hash) if head else (0, track.ZERO)
    rows = fresh.select("event_id", "push_time", "head_sha", F.array().cast("array<string>").alias("commits"), F.lit(repo).alias("repo"), F.lit(when).cast("timestamp").alias("observed_at"), F.lit(0).alias("log"))
    rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy("log").orderBy("push_time", "event_id")).cast("long") + after)  # one answer's entries
    rows = track.seal(rows.withColumn("canon", observation_canon()), ["log"], F.lit(previous)).select(*OBSERVATION, "log", "seq", "canon", "prev_hash", "row_hash")
    if not rows.isEmpty():
        rows.coalesce(1).write.mode("append").parquet(path)
    return read_observations(spark, path).where(F.col("seq") > after)


# ---------------------------------------------------------------- the log as JSON lines, for version control
LINE = (*FIELDS, "seq", "prev_hash", "row_hash")


def export_lines(spark: SparkSession, path: str, file: str) -> int:
    """Adds the rows that the file does not have yet to it, one JSON object a line; returns their number."""
    have = 0
    if os.path.exists(file):
        with open(file, "rb") as f:
            have = sum(1 for _ in f)
    rows = read(spark, path).where(F.col("seq") > have).orderBy("seq").select(F.to_json(F.struct(*LINE), {"ignoreNullFields": "false"}).alias("line")).collect()
    remote.append_lines(file, [json.loads(r.line) for r in rows])
    return len(rows)


def verify_lines(spark: SparkSession, file: str) -> dict:
    """rows and the first failing line of an exported file: line end, JSON, keys and their order, then the checks of the chain."""
    lines = track.read_lines(spark, file).cache()
    with open(file, "rb") as f:
        f.seek(0, os.SEEK_END)
        size = f.tell()
        f.seek(max(0, size - 1))
        ends = size == 0 or f.read() == b"\n"
    n = lines.count() if size else 0
    kind = T.StructType([x for x in T.StructType.fromDDL(SCHEMA) if x.name in LINE])
    keys = F.json_object_keys("line")
    text = F.when(~F.lit(ends) & (F.col("seq") == n), "no line end").when(F.expr("try_parse_json(line)").isNull() | keys.isNull(), "not valid JSON").when(keys != F.array(*map(F.lit, LINE)), "other keys or order")
    bad = lines.where(F.lit(size > 0)).withColumn("error", text).where("error is not null").orderBy("seq").select("seq", "error").head()
    sound = lines.where(F.lit(size > 0) & (F.col("seq") < (bad.seq if bad else n + 1)))
    rows = sound.select(F.from_json("line", kind).alias("x")).select("x.*").withColumn("log", F.lit(0)).withColumn("canon", canon())
    problem = error(rows)
    lines.unpersist()
    return {"rows": n, "error": problem or (f"line {bad.seq}: {bad.error}" if bad else None)}


def public_states(spark: SparkSession, path: str, observations: str, repository: str, file: str, ref: str) -> DataFrame:
    """Rows of the log with sha, deadline, published_at and state, by the git history of its exported file.

    file: its path in the repository; ref: what is public.
    """
    log = read(spark, path).select("asof", "symbol", "row_hash")
    versions = remote.file_versions(spark, repository, file)
    held = versions.select("commit_ord", "sha", "committed_at", F.get_json_object("line", "$.row_hash").alias("row_hash")).where("row_hash is not null")
    intro = track.introducing_version(held)
    seen = read_observations(spark, observations)
    heads = seen.select(F.col("head_sha").alias("head")).distinct()
    reach = remote.git_reach(spark, repository, [r["head"] for r in heads.collect()])  # one head a push
    public = remote.git_reach(spark, repository, [ref]).select("sha")
    return track.publication_state(log, intro, public, reach, seen)


def verify(spark: SparkSession, path: str, reference: str | None = None, observations: str | None = None) -> dict:
    """Rows, first error, rows by day, and whether a reference copy of the log is a prefix of it; the observations' likewise."""
    log = read(spark, path)
    out = {"rows": log.count(), "error": error(log), "coverage": {str(r.asof): r.rows for r in track.coverage(log).orderBy("asof").collect()}}
    if reference is not None:
        lines = lambda df: df.select("seq", F.col("row_hash").alias("line"))
        out["is_prefix"] = track.prefix_check(lines(log), lines(read(spark, reference))).head().is_prefix
    if observations is not None:
        seen = read_observations(spark, observations)
        out |= {"observations": seen.count(), "observations_error": observation_error(seen)}
    return out


def earliest_asof(spark: SparkSession, path: str) -> dt.date | None:
    return read(spark, path).agg(F.min("asof")).head()[0]
