"""URL filter: host and path rules, and a character language-model ratio for what no rule decides.

Two variable-order Markov models, one for accepted and one for rejected URLs, give log-likelihoods; a URL is allowed if
their difference, divided by its length, reaches a calibrated threshold. The models mix orders 0 to `ORDER` over the bytes
of the text: an order's estimate is its count plus `PRIOR` times the lower order's probability, over the context's
count plus `PRIOR`.

The models learn from the URLs that the rules decide, and from `SEEDS`, words of hosts of either kind. They must not learn the
rules themselves, so what a rule can look at is masked in every URL: the last labels of the host and the first segments of
the path, as many as the longest rule has (of a host with no more labels, the last). A number in the path or behind it is one
symbol: which page it is says nothing. Each distinct masked host and path counts once, however many URLs it has. A host's URLs are judged by models that have not seen that host: hosts are dealt
to `FOLDS` folds, and the counts of a host's own fold are left out. Seeds make up `SEED_SHARE` of each kind's hosts,
or count once each if that is more. The threshold is the score that no more than `LOSS` of the accepted hosts fall
below, and at most 0.

Counts are kept by 64-bit key of context and symbol, without a limit. Where there are more than `BLOCK_KEYS`, URLs are scored in
several passes, each with the counts of the contexts (by their last two symbols) that fit; a position is scored in one pass.

Null URLs and URLs without `://` have empty host and path; a null or empty text scores 0. Without accepted hosts the threshold
is 0. Repeated URLs get equal results. Extra columns are kept apart from the made ones; names that start with `_u_` are
reserved; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, load, materialise

#: (verdict, rule): a rule is a host and the start of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Words of hosts that are rejected (0) or accepted (1) whatever the rules.
SEEDS = (
    tuple("casino poker bets betting jackpot slots roulette lottery bingo gamble pills pharmacy viagra cialis meds steroids diet cheap discount replica loan loans payday cash profit forex adult porn xxx sex escort webcam dating singles spam ads adserver banner popup clicks track tracker tracking affiliate traffic farm win winner prize free gift coupon crack warez keygen torrent cheats hack malware phishing".split()),
    tuple("news times herald press wiki docs manual library archive journal science physics biology museum gallery school college university research institute lab city council public health clinic hospital history heritage garden cooking recipes weather travel maps music theatre books reading poetry education learning community village church sports football chess cycling nature forest river energy engineering code software open project".split()),
)
SEED_SHARE = 0.5
ORDER = 4
PRIOR = 4.0
SYMBOLS = 256
FOLDS = 4
LOSS = 0.05
#: Shares of the contexts that are dealt to passes, and the most keys of a pass.
SHARDS = 1024
BLOCK_KEYS = 500_000
MASK = "\x03"
NEAR = 1e-9


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decided, text in sorted(rules, key=lambda r: len(r[1])):
        h, slash, rest = text.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decided).otherwise(verdict)
    return rule, verdict


def reach_of(rules=RULES) -> tuple[int, int]:
    """Host labels and path segments of the longest rules."""
    return max([1, *(r.partition("/")[0].count(".") + 1 for _, r in rules)]), max([0, *(r.partition("/")[2].strip("/").count("/") + 1 for _, r in rules if r.partition("/")[2])])


def masked(url: str | None, labels: int, segments: int) -> tuple[str, str]:
    """The host, and the rest, without what rules look at; both empty for an empty text."""
    head, found, rest = (url or "").partition("://")
    host = re.match(r"[^/?#]*", rest)[0] if found else ""
    tail = rest[len(host) :] if found else head
    names = host.lower().split(".")
    shown = names[:-labels] if len(names) > labels else names[:-1]
    first = re.match(r"(?:/[^/?#]*){0,%d}" % segments, tail)[0]
    return ".".join([*shown, MASK]) if host else "", MASK + re.sub("[0-9]+", "0", tail[len(first) :].lower()) if tail else ""


def keys_of(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order, keys of each position's symbol with its context, and of the context alone; each position's shard and
    the texts' lengths. A text is its bytes and an end symbol, after ORDER start symbols."""
    parts = [t.encode("utf-8", "replace") + b"\x02" for t in texts]
    lengths = np.array([len(t) for t in parts], np.int64)
    code = np.frombuffer(b"".join(b"\x01" * ORDER + t for t in parts), np.uint8).astype(np.uint64)
    start = np.cumsum(lengths + ORDER) - lengths
    pos = np.repeat(start - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    grams, contexts, h = [], [], np.zeros(len(pos), np.uint64)
    shard = np.zeros(len(pos), np.int64)
    for n in range(ORDER + 1):
        if n:
            h = (h + code[pos - n] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        if n == 2:
            shard = (h % np.uint64(SHARDS)).astype(np.int64)
        own = (h + np.uint64(n + 1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        own ^= own >> np.uint64(29)
        both = (own + code[pos] + np.uint64(1)) * np.uint64(0x165667B19E3779F9)
        contexts.append(own.view(np.int64))
        grams.append((both ^ both >> np.uint64(32)).view(np.int64))
    return grams, contexts, shard, lengths


def strings(df: DataFrame, rules=RULES) -> DataFrame:
    """text, fold, allow, host: the distinct masked hosts and rests of a frame of (url, allow)."""
    labels, segments = reach_of(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, rests = zip(*[masked(u, labels, segments) for u in batch.column(0).to_pylist()]) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(rests, pa.string()), batch.column(1)], names=["host", "rest", "allow"])

    each = df.mapInArrow(run, "host string, rest string, allow int").where("host <> '' or rest <> ''").withColumn("fold", fold_of(F.col("host")))
    return each.select("fold", "allow", F.explode(F.array(F.struct(F.col("host").alias("text"), F.lit(True).alias("host")), F.struct(F.col("rest").alias("text"), F.lit(False).alias("host")))).alias("x")).select("x.*", "fold", "allow").where("text <> ''").distinct()


def fold_of(host: Column) -> Column:
    """By the first 32 bits of the MD5 digest."""
    return F.pmod(F.conv(F.substring(F.md5(host.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(FOLDS)).cast("int")


def with_seeds(table: DataFrame, seeds=SEEDS) -> DataFrame:
    """text, fold (FOLDS for seeds, which are in no host's own fold), allow, weight."""
    n = {r["allow"]: r["n"] for r in table.where("host").groupBy("allow").agg(F.count("*").alias("n")).collect()}
    rows = [(f"{w}.{MASK}", FOLDS, k, max(1.0, SEED_SHARE / (1 - SEED_SHARE) * n.get(k, 0) / len(own))) for k, own in enumerate(seeds) for w in own]
    more = table.sparkSession.createDataFrame(rows, "text string, fold int, allow int, weight double")
    return table.select("text", "fold", "allow", F.lit(1.0).alias("weight")).unionByName(more)


def count(table: DataFrame) -> DataFrame:
    """shard (-1 for orders 0 and 1, which every pass needs), key, kind (2 * fold + allow) and n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, contexts, shard, lengths = keys_of(batch.column(0).to_pylist())
            kind = np.repeat(2 * batch.column(1).to_numpy().astype(np.int64) + batch.column(2).to_numpy(), lengths)
            weight = np.repeat(batch.column(3).to_numpy(), lengths)
            for n in range(ORDER + 1):
                for keys in (grams[n], contexts[n]):
                    some, first, place = np.unique(keys, return_index=True, return_inverse=True)
                    total = np.bincount(place * 2 * (FOLDS + 1) + kind, weight, len(some) * 2 * (FOLDS + 1))
                    on = np.flatnonzero(total)
                    at = on // (2 * (FOLDS + 1))
                    yield pa.RecordBatch.from_arrays([pa.array(shard[first][at] if n > 1 else np.full(len(on), -1), pa.int64()), pa.array(some[at], pa.int64()), pa.array(on % (2 * (FOLDS + 1)), pa.int64()), pa.array(total[on], pa.float64())], names=["shard", "key", "kind", "n"])

    return table.select("text", "fold", "allow", "weight").mapInArrow(run, "shard long, key long, kind long, n double").groupBy("shard", "key", "kind").agg(F.sum("n").alias("n"))


def passes(counts: DataFrame, block_keys: int = BLOCK_KEYS) -> list[list[int]]:
    """Shards by pass. A shard is not split."""
    sizes = dict(counts.where("shard >= 0").groupBy("shard").agg(F.count_distinct("key").alias("n")).collect())
    out, held = [[]], 0
    for s in range(SHARDS):
        if held and held + sizes.get(s, 0) > block_keys:
            out.append([])
            held = 0
        out[-1].append(s)
        held += sizes.get(s, 0)
    return out


def table_of(counts: DataFrame, shards: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order, their counts by allow and fold, and which shards they are of."""
    rows = counts.where(F.col("shard") < 0) if not shards else counts.where((F.col("shard") < 0) | F.col("shard").between(shards[0], shards[-1]))
    got = rows.select("key", "kind", "n").toPandas()
    keys, place = np.unique(got["key"].to_numpy(np.int64), return_inverse=True)
    n = np.zeros((len(keys) + 1, 2, FOLDS + 1))  # the last row: keys that were never seen
    kind = got["kind"].to_numpy(np.int64)
    n[place, kind % 2, kind // 2] = got["n"].to_numpy()
    on = np.zeros(SHARDS, bool)
    on[shards] = True
    return keys, n, on


def log_ratios(table: tuple[np.ndarray, np.ndarray, np.ndarray], texts: list[str], folds: np.ndarray) -> np.ndarray:
    """Of each text, the sum of the accepted less the rejected model's log-probabilities over positions in the table's shards."""
    if not len(texts):
        return np.zeros(0)
    keys, n, on = table
    grams, contexts, shard, lengths = keys_of(texts)
    fold = np.repeat(folds, lengths)

    def seen(some: np.ndarray) -> np.ndarray:
        at = np.searchsorted(keys, some)
        at[(at == len(keys)) | (keys[np.minimum(at, len(keys) - 1)] != some)] = len(keys)
        own = n[at]
        return own.sum(axis=2) - own[np.arange(len(at)), :, fold]

    if not len(keys):
        return np.zeros(len(texts))
    p = np.full((len(fold), 2), 1.0 / SYMBOLS)
    for g, c in zip(grams, contexts):
        p = (seen(g) + PRIOR * p) / (seen(c) + PRIOR)
    each = np.where(on[shard], np.log(p[:, 1]) - np.log(p[:, 0]), 0.0)
    return np.add.reduceat(each, np.cumsum(lengths) - lengths)


def scored(df: DataFrame, counts: DataFrame, rules=RULES, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """df with score, from its column _u_url."""
    labels, segments = reach_of(rules)
    names, schema = df.columns, T.StructType([*df.schema, T.StructField("_u_sum", T.DoubleType()), T.StructField("_u_n", T.LongType())])
    out = df.withColumns({"_u_sum": F.lit(0.0), "_u_n": F.lit(0).cast("long")})
    out = out.withColumn("_u_fold", fold_of(masked_host(F.col("_u_url"), labels)))
    groups = passes(counts, block_keys)
    for k, shards in enumerate(groups):
        sent = df.sparkSession.sparkContext.broadcast(table_of(counts, shards))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = [masked(u, labels, segments) for u in batch.column("_u_url").to_pylist()]
                folds = batch.column("_u_fold").to_numpy().astype(np.int64)
                total = sum(log_ratios(sent.value, [p[i] for p in parts], folds) * np.array([p[i] != "" for p in parts]) for i in (0, 1))
                length = [sum(len(x.encode("utf-8", "replace")) + 1 for x in p if x) for p in parts]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(batch.column("_u_sum").to_numpy() + total, pa.float64()), pa.array(length, pa.int64()), batch.column("_u_fold")], names=[*names, "_u_sum", "_u_n", "_u_fold"])

        out = out.mapInArrow(run, T.StructType([*schema, T.StructField("_u_fold", T.IntegerType())]))
        if k + 1 < len(groups):
            out = materialise(out, "scores")
    return out.withColumn("score", F.when(F.col("_u_n") > 0, F.col("_u_sum") / F.col("_u_n")).otherwise(0.0)).drop("_u_sum", "_u_n", "_u_fold")


def masked_host(url: Column, labels: int) -> Column:
    """The host of masked(), as a column."""
    names = F.split(F.lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))), r"\.", -1)
    shown = F.slice(names, 1, F.when(F.size(names) > labels, F.size(names) - labels).otherwise(F.size(names) - 1))
    return F.when(F.array_join(names, ".") == "", F.lit("")).otherwise(F.array_join(F.concat(shown, F.array(F.lit(MASK))), "."))


def learn(df: DataFrame, url: str = "url", rules=RULES, seeds=SEEDS) -> DataFrame:
    """Counts from the URLs of df that the rules decide, and from the seeds."""
    _, decided = rule_of(host_of(F.col(url)), path_of(F.col(url)), rules)
    known = df.select(F.col(url).alias("url"), (decided == "allow").cast("int").alias("allow")).where("allow is not null")
    return materialise(count(with_seeds(materialise(strings(known, rules), "strings"), seeds)), "counts")


def judge(df: DataFrame, url: str = "url", rules=RULES, seeds=SEEDS, loss: float = LOSS, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """df with host, path, rule, score, threshold, verdict."""
    made = ("host", "path", "rule", "score", "threshold", "verdict")
    rest = [c for c in df.columns if c not in made]
    counts = learn(df, url, rules, seeds)
    allowed = df.select(F.col(url).alias("_u_url")).where(rule_of(host_of(F.col(url)), path_of(F.col(url)), rules)[1] == "allow").distinct()
    by_host = scored(allowed, counts, rules, block_keys).groupBy(host_of(F.col("_u_url")).alias("host")).agg(F.avg("score").alias("score"))
    least = by_host.agg(F.percentile_approx("score", loss, 10_000)).first()[0]
    threshold = min(0.0, least) if least is not None else 0.0
    own = df.select(*rest, *([] if url in rest else [F.col(url)])).withColumn("_u_url", F.col(url))
    out = scored(own, counts, rules, block_keys).withColumns({"host": host_of(F.col("_u_url")), "path": path_of(F.col("_u_url"))})
    rule, decided = rule_of(F.col("host"), F.col("path"), rules)
    said = F.when(F.col("score") >= threshold - NEAR, "allow").otherwise("block")
    return out.select(*rest, "host", "path", rule.alias("rule"), "score", F.lit(threshold).alias("threshold"), F.coalesce(decided, said).alias("verdict"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(load(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


QUERIES = {"op3_url_filter": op3_url_filter}


def oracle() -> str:
    """The same over the contexts' texts in place of keys."""
    labels, segments = reach_of()
    fits = [(f"(host = '{r.partition('/')[0]}' OR host LIKE '%.{r.partition('/')[0]}') AND starts_with(path, '/{r.partition('/')[2]}')", v, r) for v, r in sorted(RULES, key=lambda x: -len(x[1]))]
    pick = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) + " END"
    seeds = ", ".join(f"('{w}', {k}, {len(own)})" for k, own in enumerate(SEEDS) for w in own)
    return rf"""
WITH cut AS (SELECT page_id, url, strpos(url, '://') AS found_at, substr(url, strpos(url, '://') + 3) AS after FROM pages),
parts AS (SELECT page_id, url, coalesce(found_at > 0, false) AS has, CASE WHEN found_at > 0 THEN regexp_extract(after, '^[^/?#]*') ELSE '' END AS raw, CASE WHEN found_at > 0 THEN after ELSE coalesce(url, '') END AS after FROM cut),
hosts AS (SELECT page_id, url, raw, translate(raw, '{UPPER}', '{LOWER}') AS host, CASE WHEN has THEN substr(after, len(raw) + 1) ELSE after END AS tail, CASE WHEN has THEN regexp_extract(substr(after, len(raw) + 1), '^[^?#]*') ELSE '' END AS path, string_split(lower(raw), '.') AS names FROM parts),
judged AS (SELECT page_id, url, host, path, {pick(2)} AS rule, {pick(1)} AS decided, CASE WHEN raw = '' THEN '' ELSE array_to_string(list_append(names[1:CASE WHEN len(names) > {labels} THEN len(names) - {labels} ELSE len(names) - 1 END], chr(3)), '.') END AS mhost,
  CASE WHEN tail = '' THEN '' ELSE chr(3) || regexp_replace(lower(regexp_replace(tail, '^(/[^/?#]*){{0,{segments}}}', '')), '[0-9]+', '0', 'g') END AS mrest FROM hosts),
folded AS (SELECT *, CAST(('0x' || substr(md5(mhost), 1, 8)) AS BIGINT) % {FOLDS} AS fold FROM judged),
strings AS (SELECT DISTINCT text, is_host, fold, (decided = 'allow')::int AS allow FROM (SELECT mhost AS text, true AS is_host, fold, decided FROM folded UNION ALL SELECT mrest, false, fold, decided FROM folded) WHERE decided IS NOT NULL AND text <> ''),
n_hosts AS (SELECT allow, count(*) AS n FROM strings WHERE is_host GROUP BY 1),
lessons AS (SELECT text, fold, allow, 1.0::double AS weight FROM strings UNION ALL SELECT w || '.' || chr(3), {FOLDS}, k, greatest(1.0::double, {SEED_SHARE / (1 - SEED_SHARE)}::double * coalesce(n, 0) / size) FROM (VALUES {seeds}) s(w, k, size) LEFT JOIN n_hosts ON allow = k),
padded AS (SELECT repeat(chr(1), {ORDER}) || text || chr(2) AS t, fold, allow, weight FROM lessons),
spots AS (SELECT t, fold, allow, weight, unnest(range({ORDER} + 1, len(t) + 1)) AS i FROM padded),
grams AS (SELECT fold, allow, weight, t[i - n:i] AS g, t[i - n:i - 1] AS c FROM spots, (SELECT unnest(range({ORDER + 1})) AS n)),
by_gram AS (SELECT g, sum(weight) FILTER (allow = 0) AS n0, sum(weight) FILTER (allow = 1) AS n1 FROM grams GROUP BY 1),
by_gram_fold AS (SELECT fold, g, sum(weight) FILTER (allow = 0) AS n0, sum(weight) FILTER (allow = 1) AS n1 FROM grams GROUP BY 1, 2),
by_context AS (SELECT len(g) AS size, c, sum(weight) FILTER (allow = 0) AS n0, sum(weight) FILTER (allow = 1) AS n1 FROM grams GROUP BY 1, 2),
by_context_fold AS (SELECT fold, len(g) AS size, c, sum(weight) FILTER (allow = 0) AS n0, sum(weight) FILTER (allow = 1) AS n1 FROM grams GROUP BY 1, 2, 3),
texts AS (SELECT DISTINCT fold, text FROM (SELECT fold, mhost AS text FROM folded UNION ALL SELECT fold, mrest FROM folded) WHERE text <> ''),
asked AS (SELECT fold, text, t, unnest(range({ORDER} + 1, len(t) + 1)) AS i FROM (SELECT *, repeat(chr(1), {ORDER}) || text || chr(2) AS t FROM texts)),
each AS (SELECT fold, text, i, n, t[i - n:i] AS g, t[i - n:i - 1] AS c FROM asked, (SELECT unnest(range({ORDER + 1})) AS n)),
seen AS (SELECT e.fold, e.text, e.i, e.n, coalesce(a.n0, 0) - coalesce(b.n0, 0) AS g0, coalesce(a.n1, 0) - coalesce(b.n1, 0) AS g1, coalesce(x.n0, 0) - coalesce(y.n0, 0) AS c0, coalesce(x.n1, 0) - coalesce(y.n1, 0) AS c1
  FROM each e LEFT JOIN by_gram a ON a.g = e.g LEFT JOIN by_gram_fold b ON b.g = e.g AND b.fold = e.fold LEFT JOIN by_context x ON x.c = e.c AND x.size = e.n + 1 LEFT JOIN by_context_fold y ON y.c = e.c AND y.size = e.n + 1 AND y.fold = e.fold),
mixed AS (SELECT fold, text, i, list_reduce(list_concat([{{'g0': {1 / SYMBOLS}::double, 'g1': {1 / SYMBOLS}::double, 'c0': 0.0::double, 'c1': 0.0::double}}], list({{'g0': g0::double, 'g1': g1::double, 'c0': c0::double, 'c1': c1::double}} ORDER BY n)),
  lambda a, x: {{'g0': (x.g0 + {PRIOR}::double * a.g0) / (x.c0 + {PRIOR}::double), 'g1': (x.g1 + {PRIOR}::double * a.g1) / (x.c1 + {PRIOR}::double), 'c0': 0.0::double, 'c1': 0.0::double}}) AS p FROM seen GROUP BY 1, 2, 3),
logs AS (SELECT fold, text, sum(ln(p.g1) - ln(p.g0)) AS s, count(*) AS n FROM mixed GROUP BY 1, 2),
scores AS (SELECT f.*, CASE WHEN coalesce(h.n, 0) + coalesce(r.n, 0) > 0 THEN (coalesce(h.s, 0) + coalesce(r.s, 0)) / (coalesce(h.n, 0) + coalesce(r.n, 0)) ELSE 0.0::double END AS score FROM folded f LEFT JOIN logs h ON h.fold = f.fold AND h.text = f.mhost LEFT JOIN logs r ON r.fold = f.fold AND r.text = f.mrest),
by_host AS (SELECT host, avg(score) AS score FROM (SELECT DISTINCT url, host, score FROM scores WHERE decided = 'allow') GROUP BY 1),
least_ AS (SELECT least(0.0::double, coalesce(min(score) FILTER (k = need), 0.0::double)) AS t FROM (SELECT score, row_number() OVER (ORDER BY score) AS k, greatest(1, CAST(ceil({LOSS}::double * count(*) OVER ()) AS BIGINT)) AS need FROM by_host))
SELECT page_id, host, path, rule, coalesce(decided, CASE WHEN score >= t - {NEAR}::double THEN 'allow' ELSE 'block' END) AS verdict, round(score, 6) AS score FROM scores, least_"""


ORACLE_SQL = {"op3_url_filter": oracle()}
