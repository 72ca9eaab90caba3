"""Append-only logs: canonical text, hash chains, verification, publication state.

A log is a DataFrame with `seq`, its order; `chain` columns name independent logs in one DataFrame. Only sealing is
sequential, and only over a chain's new rows; verification is one window over each chain.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import ensure_checkpoints

#: The hash before a chain's first row, states of publication, types of activity.
ZERO = "0" * 64
STATES = ("unpublished", "published_unverified", "late", "forward")
ACTIVITY_TYPES = ("push", "force_push", "branch_creation")
ACTIVITY = "array<struct<id: string, activity_type: string, ref: string, after: string, timestamp: string>>"
NEW_YORK = "America/New_York"


# ---------------------------------------------------------------- canonical form and chain
def canonical(columns: dict[str, Column]) -> Column:
    """One text for a row: name=value in order of the names, a null told apart from any value."""
    return F.concat_ws("\x1f", *[F.concat(F.lit(f"{k}="), F.coalesce(F.concat(F.lit("'"), v.cast("string")), F.lit("null"))) for k, v in sorted(columns.items())])


def canonical_json(rows: Column) -> Column:
    """Rows given as JSON text in the canonical JSON form: sorted keys, no spaces, ASCII, no NaN. Python, because number
    texts must be those of Python's writer; only for logs that were written in this form."""

    def write(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: None if s is None else json.dumps(json.loads(s), sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False))

    return F.pandas_udf(write, "string")(rows)


def row_hash(canon: Column, previous: Column) -> Column:
    return F.sha2(F.concat_ws("\x1e", canon, previous).cast("binary"), 256)


def seal(rows: DataFrame, chain: list[str], head: Column | None = None) -> DataFrame:
    """rows (chain, seq, canon) with prev_hash and row_hash; head: the last stored hash of the chain.

    A hash needs the one before, so a chain's new rows pass in order through one task, which keeps one hash: time is linear
    in the rows, and no chain is held whole. Chains are independent.
    """
    own = rows.withColumns({"seq": F.col("seq").cast("long"), "_head": F.lit(ZERO) if head is None else F.coalesce(head, F.lit(ZERO))})
    names = [c for c in own.columns if c != "_head"]
    schema = T.StructType([*(own.schema[c] for c in names), T.StructField("prev_hash", T.StringType()), T.StructField("row_hash", T.StringType())])
    at = [own.columns.index(c) for c in (*chain, "canon", "_head")]
    keep = [own.columns.index(c) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for batch in batches:
            before, after = [], []
            for row in zip(*[batch.column(k).to_pylist() for k in at]):
                if row[:-2] != key:
                    key, last = row[:-2], row[-1]
                before.append(last)
                last = hashlib.sha256("\x1e".join(x for x in (row[-2], last) if x is not None).encode()).hexdigest()
                after.append(last)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(before, pa.string()), pa.array(after, pa.string())], names=[*names, "prev_hash", "row_hash"])

    return own.repartition(*chain).sortWithinPartitions(*chain, "seq").mapInArrow(run, schema)


def verify(rows: DataFrame, chain: list[str], unique: list[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """chain, line, error: the first failing line (from 1) of each chain that has one.

    rows: chain, seq, canon, prev_hash, row_hash, the columns `unique`. Checks of one line in order: the link to the line
    before, the line's own hash, a repeated key, then `extra` (name -> true where it fails).
    """
    order = Window.partitionBy(*chain).orderBy("seq")
    key = Window.partitionBy(*chain, *unique).orderBy("seq")
    own = rows.withColumns({"line": F.row_number().over(order), "before": F.coalesce(F.lag("row_hash").over(order), F.lit(ZERO)), "nth": F.row_number().over(key)})
    checks = [("prev_hash does not match", ~F.col("prev_hash").eqNullSafe(F.col("before"))), ("row_hash does not match", ~row_hash(F.col("canon"), F.col("prev_hash")).eqNullSafe(F.col("row_hash"))), ("duplicate key", F.col("nth") > 1), *(extra or {}).items()]
    error = F.coalesce(*[F.when(failed, name) for name, failed in checks])
    return own.withColumn("error", error).where("error is not null").groupBy(*chain).agg(F.min("line").cast("int").alias("line"), F.min_by("error", "line").alias("error"))


def parse_log(lines: DataFrame, schema: str) -> DataFrame:
    """seq, row and error of text lines (seq, line): broken JSON keeps its line with an error."""
    row = F.from_json("line", schema, {"mode": "PERMISSIVE"})
    bad = F.expr("try_parse_json(line)").isNull()
    return lines.select("seq", F.when(~bad, row).alias("row"), F.when(bad, "not valid JSON").alias("error"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """seq (from 1) and line of one text file, whole: order is part of a log."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n", -1)).alias("seq", "line")).select(F.col("seq") + 1, "line").toDF("seq", "line")


def coverage(rows: DataFrame) -> DataFrame:
    return rows.groupBy("asof").agg(F.count("*").alias("rows"))


def prefix_check(current: DataFrame, reference: DataFrame) -> DataFrame:
    """One row: reference rows, mismatches and whether the reference (seq, line) is a prefix of the log."""
    cur = current.select("seq", F.col("line").alias("now"))
    out = reference.join(cur, "seq", "left").agg(F.count("*").alias("reference_rows"), F.count_if(~F.col("line").eqNullSafe(F.col("now"))).alias("mismatches"))
    return out.withColumn("is_prefix", F.col("mismatches") == 0)


# ---------------------------------------------------------------- calendar
def deadline(asof: Column) -> Column:
    """09:30 New York on the first Monday to Friday after asof, as a UTC timestamp; holidays count as days."""
    step = F.when(F.dayofweek(asof) == 6, 3).when(F.dayofweek(asof) == 7, 2).otherwise(1)
    local = F.to_timestamp(F.concat(F.date_add(asof, step).cast("string"), F.lit(" 09:30:00")))
    return F.to_utc_timestamp(local, NEW_YORK)


# ---------------------------------------------------------------- appending
def through(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.max("dt").alias("bars_through"))


def stale_symbols(bars: DataFrame) -> DataFrame:
    """symbol, bars_through, asof of symbols whose last bar is older than the newest one."""
    last = through(bars).withColumn("asof", F.max("bars_through").over(Window.partitionBy()))  # one row per symbol
    return last.where(F.col("bars_through") < F.col("asof"))


def append_plan(snapshots: DataFrame, existing: DataFrame, today) -> DataFrame:
    """Snapshots to append: those of the newest day whose (asof, symbol) is not in the log.

    A newest day after today or on a weekend is refused. snapshots: symbol, date, ...; existing: asof, symbol.
    """
    newest = F.max("date").over(Window.partitionBy())
    own = snapshots.withColumn("asof", newest)
    refused = F.when(F.col("asof") > F.lit(today), F.raise_error(F.lit("the newest day is after today"))).when(F.dayofweek("asof").isin(1, 7), F.raise_error(F.lit("the newest day is no weekday"))).otherwise(F.lit(None))
    own = own.withColumn("asof", F.coalesce(refused.cast("date"), F.col("asof"))).where(F.col("date") == F.col("asof"))
    return own.join(existing.select("asof", "symbol"), ["asof", "symbol"], "left_anti")


# ---------------------------------------------------------------- publication
def introducing_version(versions: DataFrame) -> DataFrame:
    """row_hash, sha, committed_at of the first version (commit_ord) that holds the row."""
    first = F.min_by(F.struct("sha", "committed_at"), "commit_ord").alias("x")
    return versions.groupBy("row_hash").agg(first).select("row_hash", "x.sha", "x.committed_at")


def ancestors(heads: DataFrame, commits: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """head, sha: every commit that each head reaches, itself included. commits: child, parent.

    One join per level of the frontier, until no head reaches anything new; each level is checkpointed.
    """
    ensure_checkpoints(heads.sparkSession)
    frontier = heads.select("head", F.col("head").alias("sha")).distinct()
    seen = frontier
    for _ in range(max_depth):
        up = frontier.join(commits, frontier["sha"] == commits["child"]).select("head", F.col("parent").alias("sha")).distinct()
        frontier = up.join(seen, ["head", "sha"], "left_anti").checkpoint()
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise ValueError("the history is deeper than max_depth")


def publication_state(rows: DataFrame, intro: DataFrame, public: DataFrame, reach: DataFrame, observations: DataFrame) -> DataFrame:
    """rows with sha, deadline, published_at and state.

    intro: row_hash, sha; public: sha of commits the public head reaches; reach: head, sha; observations: head_sha, push_time,
    commits. A commit is published by the earliest push that names it or whose head reaches it; later than the deadline
    is late, at the deadline still forward.
    """
    named = observations.select("push_time", F.explode("commits").alias("sha"))
    headed = observations.select("push_time", F.col("head_sha").alias("sha"))
    reached = observations.join(reach, observations["head_sha"] == reach["head"]).select("push_time", "sha")
    pushed = named.unionByName(headed).unionByName(reached).groupBy("sha").agg(F.min("push_time").alias("published_at"))
    own = rows.join(intro.select("row_hash", "sha"), "row_hash", "left").join(public.select("sha", F.lit(True).alias("is_public")).distinct(), "sha", "left").join(pushed, "sha", "left")
    visible = F.coalesce("is_public", F.lit(False))
    own = own.withColumns({"deadline": deadline(F.col("asof")), "published_at": F.when(visible, F.col("published_at"))})
    state = F.when(~visible, "unpublished").when(F.col("published_at").isNull(), "published_unverified").when(F.col("published_at") > F.col("deadline"), "late").otherwise("forward")
    return own.withColumn("state", state).drop("is_public")


def state_counts(states: DataFrame) -> DataFrame:
    """One row with the number of rows in each state."""
    return states.agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES])


# ---------------------------------------------------------------- activity
def parse_activity(items: DataFrame, ref: str) -> DataFrame:
    """event_id, push_time, head_sha (and seq, if items have it) of activity entries that moved `ref`; malformed ones are dropped.

    items: id, activity_type, ref, after, timestamp (text with a zone).
    """
    sha = F.lower(F.trim("after"))
    zoned = F.col("timestamp").rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    when = F.when(zoned, F.try_to_timestamp("timestamp"))
    own = items.where(F.col("activity_type").isin(*ACTIVITY_TYPES) & (F.col("ref") == ref) & (F.length("id") > 0))
    return own.select(F.col("id").alias("event_id"), when.alias("push_time"), sha.alias("head_sha"), *(["seq"] if "seq" in items.columns else [])).where(F.col("push_time").isNotNull() & F.col("head_sha").rlike("^[0-9a-f]{40}$"))


def observe(parsed: DataFrame, existing: DataFrame, order: str = "seq") -> DataFrame:
    """New observations: of entries with one event_id the first, none that the log has."""
    first = F.row_number().over(Window.partitionBy("event_id").orderBy(order))
    return parsed.join(existing.select("event_id"), "event_id", "left_anti").withColumn("_nth", first).where("_nth = 1").drop("_nth")
