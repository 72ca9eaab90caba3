"""Queries of the forward log. Logs are made from `orders`: one chain per customer, in order of date and key."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import rule
from ..operators import signals, track
from ..sources import bars as src
from . import sql
from .bar_queries import query_into

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = query_into(QUERIES, ORACLE_SQL)

ZERO = track.ZERO
LOG = """log AS (SELECT o_custkey AS chain, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS seq, CAST(o_orderdate AS date) AS \"asof\", o_orderkey AS symbol, o_orderstatus AS status,
CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)"""
CANON = "'asof=''' || \"asof\" || chr(31) || 'cents=''' || cents || chr(31) || 'status=''' || status || chr(31) || 'symbol=''' || symbol"
HASH = "sha256({c} || chr(30) || {p})"
SEALED = f"""canon AS MATERIALIZED (SELECT *, {CANON} AS canon FROM log),
sealed(chain, seq, prev_hash, row_hash) AS (
  SELECT chain, seq, '{ZERO}', {HASH.format(c='canon', p=f"'{ZERO}'")} FROM canon WHERE seq = 1
  UNION ALL
  SELECT c.chain, c.seq, s.row_hash, {HASH.format(c='c.canon', p='s.row_hash')} FROM sealed s JOIN canon c ON c.chain = s.chain AND c.seq = s.seq + 1)"""


def log(spark, sf_dir) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = src.load(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("chain"), F.row_number().over(order).cast("long").alias("seq"), F.to_date("o_orderdate").alias("asof"), F.col("o_orderkey").alias("symbol"), F.col("o_orderstatus").alias("status"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
    )
    return rows.withColumn("canon", track.canonical({c: F.col(c) for c in ("asof", "symbol", "status", "cents")}))


@query("canonical_row", f"WITH {LOG} SELECT chain, seq, {CANON} AS canon FROM log")
def canonical_row(spark, sf_dir):
    return log(spark, sf_dir).select("chain", "seq", "canon")


@query("row_hash", f"WITH {LOG} SELECT chain, seq, {HASH.format(c=CANON, p=repr(ZERO))} AS row_hash FROM log")
def row_hash(spark, sf_dir):
    return log(spark, sf_dir).select("chain", "seq", track.row_hash(F.col("canon"), F.lit(ZERO)).alias("row_hash"))


@query("seal_chain", f"WITH RECURSIVE {LOG},{SEALED} SELECT chain, seq, prev_hash, row_hash FROM sealed")
def seal_chain(spark, sf_dir):
    return track.seal(log(spark, sf_dir), ["chain"]).select("chain", "seq", "prev_hash", "row_hash")


@query("verify_chain", f"""WITH RECURSIVE {LOG},{SEALED},
broken AS (SELECT s.*, CASE WHEN symbol % 97 = 0 THEN canon || 'x' ELSE canon END AS canon, CASE WHEN symbol % 89 = 0 THEN 0 ELSE symbol END AS ukey FROM sealed s JOIN canon USING (chain, seq) WHERE symbol % 101 <> 0),
b AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY seq) AS line, coalesce(lag(row_hash) OVER (PARTITION BY chain ORDER BY seq), '{ZERO}') AS before, row_number() OVER (PARTITION BY chain, ukey ORDER BY seq) AS nth FROM broken),
e AS (SELECT chain, line, CASE WHEN prev_hash <> before THEN 'prev_hash does not match' WHEN {HASH.format(c='canon', p='prev_hash')} <> row_hash THEN 'row_hash does not match' WHEN nth > 1 THEN 'duplicate key' END AS error FROM b)
SELECT chain, CAST(min(line) AS INT) AS line, arg_min(error, line) AS error FROM e WHERE error IS NOT NULL GROUP BY 1""")
def verify_chain(spark, sf_dir):
    sealed = track.seal(log(spark, sf_dir), ["chain"]).where(F.col("symbol") % 101 != 0)
    broken = sealed.withColumns({"canon": F.when(F.col("symbol") % 97 == 0, F.concat("canon", F.lit("x"))).otherwise(F.col("canon")), "ukey": F.when(F.col("symbol") % 89 == 0, 0).otherwise(F.col("symbol"))})
    return track.verify(broken, ["chain"], ["ukey"])


@query("log_coverage", f"WITH {LOG} SELECT \"asof\", count(*) AS rows FROM log GROUP BY 1")
def log_coverage(spark, sf_dir):
    return track.coverage(log(spark, sf_dir))


@query("log_earliest_asof", f"WITH {LOG} SELECT chain, min(\"asof\") AS earliest FROM log GROUP BY 1")
def log_earliest_asof(spark, sf_dir):
    return log(spark, sf_dir).groupBy("chain").agg(F.min("asof").alias("earliest"))


@query("log_scan", "SELECT event_id AS seq, user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 50 = 0 THEN 'not valid JSON' END AS error FROM (SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 50 <> 0 THEN event_type END AS event_type, CASE WHEN event_id % 50 <> 0 THEN props END AS props FROM events)")
def log_scan(spark, sf_dir):
    whole = F.to_json(F.struct("user_id", "event_type", F.from_json("props", "struct<k: bigint>").alias("props")))
    lines = src.load(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 50 == 0, F.substring(whole, 1, 10)).otherwise(whole).alias("line"))
    parsed = track.parse_log(lines, "struct<user_id: bigint, event_type: string, props: struct<k: bigint>>")
    return parsed.select("seq", "row.user_id", "row.event_type", F.col("row.props.k").alias("k"), "error")


@query("deadline", "SELECT DISTINCT d AS \"asof\", strftime(timezone('UTC', timezone('America/New_York', (d + CASE dayofweek(d) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END)::timestamp + INTERVAL 570 MINUTE)), '%Y-%m-%d %H:%M:%S') AS deadline FROM (SELECT CAST(o_orderdate AS date) AS d FROM orders)")
def deadline(spark, sf_dir):
    days = src.load(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("asof")).distinct()
    return days.select("asof", F.date_format(track.deadline(F.col("asof")), "yyyy-MM-dd HH:mm:ss").alias("deadline"))


BARS = f"WITH {sql.BARS.strip()}"


@query("stale_symbols", f"{BARS}, x AS (SELECT symbol, max(dt) AS bars_through FROM bars WHERE NOT (symbol LIKE '%1' AND dt > DATE '2001-06-29') GROUP BY 1) SELECT symbol, bars_through, \"asof\" FROM (SELECT *, max(bars_through) OVER () AS \"asof\" FROM x) WHERE bars_through < \"asof\"")
def stale_symbols(spark, sf_dir):
    bars = src.synthetic(spark, sf_dir).where(~(F.col("symbol").endswith("1") & (F.col("dt") > "2001-06-29")))
    return track.stale_symbols(bars)


@query("append_plan", f"{BARS},{sql.SIGNALS},{sql.weighted('f')}, cut AS (SELECT * FROM wt WHERE dt <= DATE '2001-06-29'), x AS (SELECT *, max(dt) OVER (PARTITION BY symbol) AS last, max(dt) OVER () AS newest FROM cut) SELECT newest AS \"asof\", symbol, round(c, 6) AS close, w FROM x WHERE dt = last AND last = newest AND symbol NOT LIKE '%2'")
def append_plan(spark, sf_dir):
    sig = signals.trend_signals(src.synthetic(spark, sf_dir).where("dt <= '2001-06-29'"), rule("f"))
    snap = sig.groupBy("symbol").agg(F.max("dt").alias("date"), F.max_by(F.struct("c", "w"), "dt").alias("x"))
    known = snap.where(F.col("symbol").endswith("2")).select(F.lit("2001-06-29").cast("date").alias("asof"), "symbol")
    plan = track.append_plan(snap, known, dt.date(2001, 7, 1))
    return plan.select("asof", "symbol", F.round("x.c", 6).alias("close"), F.col("x.w").alias("w"))


@query("prefix_check", f"WITH {LOG}, cur AS (SELECT symbol AS seq, {CANON} AS line FROM log WHERE symbol % 500 <> 499), ref AS (SELECT symbol AS seq, CASE WHEN symbol % 400 = 0 THEN 'x' ELSE {CANON} END AS line FROM log) SELECT count(*) AS reference_rows, count(*) FILTER (cur.line IS DISTINCT FROM ref.line) AS mismatches, count(*) FILTER (cur.line IS DISTINCT FROM ref.line) = 0 AS is_prefix FROM ref LEFT JOIN cur USING (seq)")
def prefix_check(spark, sf_dir):
    rows = log(spark, sf_dir).select(F.col("symbol").alias("seq"), F.col("canon").alias("line"))
    reference = rows.withColumn("line", F.when(F.col("seq") % 400 == 0, "x").otherwise(F.col("line")))
    return track.prefix_check(rows.where("seq % 500 <> 499"), reference)


# each order's row is introduced by the commit of its date's month and stays in later versions of two months
VERSIONS = """versions AS (SELECT sha256('row' || o_orderkey) AS row_hash, m + k AS commit_ord, substr(sha256('commit' || (m + k)), 1, 40) AS sha, CAST(m + k AS BIGINT) * 1000 AS committed_at
FROM (SELECT o_orderkey, year(o_orderdate) * 12 + month(o_orderdate) AS m FROM orders), (VALUES (0), (1), (2)) v(k))"""


def versions(spark, sf_dir) -> DataFrame:
    own = src.load(spark, sf_dir, "orders").select(F.sha2(F.concat(F.lit("row"), F.col("o_orderkey").cast("string")).cast("binary"), 256).alias("row_hash"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("m"))
    own = own.select("row_hash", F.explode(F.sequence(F.col("m").cast("long"), F.col("m").cast("long") + 2)).alias("commit_ord"))
    return own.select("row_hash", "commit_ord", F.substring(F.sha2(F.concat(F.lit("commit"), F.col("commit_ord").cast("string")).cast("binary"), 256), 1, 40).alias("sha"), (F.col("commit_ord") * 1000).alias("committed_at"))


@query("introducing_version", f"WITH {VERSIONS} SELECT row_hash, arg_min(sha, commit_ord) AS sha, arg_min(committed_at, commit_ord) AS committed_at FROM versions GROUP BY 1")
def introducing_version(spark, sf_dir):
    return track.introducing_version(versions(spark, sf_dir))


@query("ancestry", "WITH RECURSIVE commits AS (SELECT c_custkey AS child, c_custkey // 2 AS parent FROM customer WHERE c_custkey > 0 UNION SELECT c_custkey, c_custkey // 3 FROM customer WHERE c_custkey > 0 AND c_custkey % 5 = 0), reach(head, sha) AS (SELECT c_custkey, c_custkey FROM customer UNION SELECT head, parent FROM reach JOIN commits ON child = sha) SELECT head, sha FROM reach")
def ancestry(spark, sf_dir):
    key = src.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("child"))
    commits = key.where("child > 0").select("child", F.floor(F.col("child") / 2).alias("parent")).unionByName(key.where("child > 0 and child % 5 = 0").select("child", F.floor(F.col("child") / 3).alias("parent"))).distinct()
    return track.ancestors(key.select(F.col("child").alias("head")), commits)


# publication: orders are rows, their commit is their month; commits of even months are public; pushes come from lineitem
STATE_SQL = """o AS (SELECT o_orderkey AS row_hash, CAST(o_orderdate AS date) AS \"asof\", year(o_orderdate) * 12 + month(o_orderdate) AS m FROM orders),
intro AS (SELECT row_hash, m AS sha FROM o WHERE row_hash % 10 <> 3),
push AS (SELECT year(l_shipdate) * 12 + month(l_shipdate) AS sha, min(l_shipdate) AS published_at FROM lineitem GROUP BY 1),
st AS (SELECT o.row_hash, \"asof\", i.sha, CASE WHEN i.sha % 4 <> 0 THEN published_at END AS pub,
  timezone('UTC', timezone('America/New_York', (\"asof\" + CASE dayofweek(\"asof\") WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END)::timestamp + INTERVAL 570 MINUTE)) AS dl, coalesce(i.sha % 4 <> 0, false) AS vis
  FROM o LEFT JOIN intro i USING (row_hash) LEFT JOIN push USING (sha)),
states AS (SELECT row_hash, \"asof\", sha, CASE WHEN NOT vis THEN 'unpublished' WHEN pub IS NULL THEN 'published_unverified' WHEN pub > dl THEN 'late' ELSE 'forward' END AS state FROM st)"""


def states(spark, sf_dir) -> DataFrame:
    month = lambda c: (F.year(c) * 12 + F.month(c)).cast("long")
    rows = src.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_hash"), F.to_date("o_orderdate").alias("asof"), month("o_orderdate").alias("sha"))
    intro = rows.where("row_hash % 10 <> 3").select("row_hash", "sha")
    public = rows.select("sha").distinct().where("sha % 4 <> 0")
    pushes = src.load(spark, sf_dir, "lineitem").select(month("l_shipdate").alias("head_sha"), F.col("l_shipdate").cast("timestamp").alias("push_time"), F.array().cast("array<bigint>").alias("commits"))
    reach = pushes.select(F.col("head_sha").alias("head"), F.col("head_sha").alias("sha")).distinct()
    return track.publication_state(rows.drop("sha"), intro, public, reach, pushes)


@query("publication_state", f"WITH {STATE_SQL} SELECT row_hash, \"asof\", CAST(sha AS BIGINT) AS sha, state FROM states")
def publication_state(spark, sf_dir):
    return states(spark, sf_dir).select("row_hash", "asof", "sha", "state")


@query("state_counts", f"WITH {STATE_SQL} SELECT " + ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in track.STATES) + " FROM states")
def state_counts(spark, sf_dir):
    return track.state_counts(states(spark, sf_dir))


# activity: events are entries; ids repeat, some shas and times are malformed
ITEMS = """items AS (SELECT event_id AS seq, CAST(event_id % 7000 AS VARCHAR) AS id, CASE event_type WHEN 'click' THEN 'push' WHEN 'view' THEN 'force_push' WHEN 'error' THEN 'branch_creation' ELSE event_type END AS activity_type,
CASE WHEN user_id % 3 = 0 THEN 'refs/heads/dev' ELSE 'refs/heads/main' END AS ref, CASE WHEN event_id % 11 = 0 THEN 'bad' ELSE upper(substr(sha256('e' || event_id), 1, 40)) END AS sha, event_id % 13 = 0 AS naive, date_trunc('second', ts) AS happened FROM events),
parsed AS (SELECT seq, id AS event_id, lower(sha) AS head_sha, strftime(happened, '%Y-%m-%d %H:%M:%S') AS push_time FROM items WHERE activity_type IN ('push', 'force_push', 'branch_creation') AND ref = 'refs/heads/main' AND sha <> 'bad' AND NOT naive)"""


def items(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "push").when(F.col("event_type") == "view", "force_push").when(F.col("event_type") == "error", "branch_creation").otherwise(F.col("event_type"))
    sha = F.when(F.col("event_id") % 11 == 0, "bad").otherwise(F.upper(F.substring(F.sha2(F.concat(F.lit("e"), F.col("event_id").cast("string")).cast("binary"), 256), 1, 40)))
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 13 == 0, "").otherwise("Z"))
    return src.load(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), (F.col("event_id") % 7000).cast("string").alias("id"), kind.alias("activity_type"), F.when(F.col("user_id") % 3 == 0, "refs/heads/dev").otherwise("refs/heads/main").alias("ref"), sha.alias("after"), text.alias("timestamp")
    )


def parsed(spark, sf_dir) -> DataFrame:
    """With the entry's place, as several entries share an id."""
    own = items(spark, sf_dir).withColumn("id", F.concat_ws("/", "id", "seq"))
    out = track.parse_activity(own, "refs/heads/main")
    pair = F.split("event_id", "/")
    return out.select(pair[1].cast("long").alias("seq"), pair[0].alias("event_id"), "head_sha", F.date_format("push_time", "yyyy-MM-dd HH:mm:ss").alias("push_time"))


@query("activity_scan", f"WITH {ITEMS} SELECT activity_type, ref, count(*) AS n FROM items GROUP BY 1, 2")
def activity_scan(spark, sf_dir):
    whole = items(spark, sf_dir).select("seq", F.to_json(F.array(F.struct("id", "activity_type", "ref", "after", "timestamp"))).alias("body"))
    entries = whole.select(F.explode(F.from_json("body", track.ACTIVITY)).alias("x")).select("x.*")
    return entries.groupBy("activity_type", "ref").agg(F.count("*").alias("n"))


@query("parse_activity", f"WITH {ITEMS} SELECT seq, event_id, head_sha, push_time FROM parsed")
def parse_activity(spark, sf_dir):
    return parsed(spark, sf_dir)


@query("observe_dedup", f"WITH {ITEMS} SELECT seq, event_id, head_sha, push_time FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY seq) AS k FROM parsed WHERE CAST(event_id AS BIGINT) % 9 <> 0) WHERE k = 1")
def observe_dedup(spark, sf_dir):
    own = parsed(spark, sf_dir)
    known = own.select("event_id").where(F.col("event_id").cast("long") % 9 == 0).distinct()
    return track.observe(own, known)
