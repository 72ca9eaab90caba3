"""Quality rules: hashed n-gram log-likelihood ratio, with DataFrame functions only.

Words are runs of other characters than 0x20 and 0x09-0x0D. Words and word pairs are hashed to `buckets` buckets. One
multinomial is fitted to all rows (raw corpus), one to trusted rows, labelled quality 1 (target). A document's score is the mean over its words
and pairs of the log ratio of their smoothed probabilities, with `PRIOR` more grams of ratio 0, so that a few words do
not decide. It is rejected by the method if the score is below the
threshold, and by the base rules if it has fewer than 10 words or over a fifth of its words stand in 5-word windows
that occur twice or more.

The target is fitted to four fifths of the trusted rows, by crc32 of doc_id: to all, or, if there are more than `trusted_rows`,
to that many of least hash. The threshold is the mean score of all trusted rows of the last fifth, which the fit
has not seen, less `spread` standard deviations (none without such rows: then only the base rules reject). Scores of good texts
have a long lower tail, hence the wide spread; the README gives the figures. The tables that the tasks need have `buckets`
numbers.

Null texts have no words, fail the base rule and score 0. Repeated rows count and are judged one by one; an empty table
gives no rows. Ids may be of any type. Labels with a null doc_id or quality are not read; a doc_id with labels 0 and 1 is
not trusted. Extra columns are kept (by judge() unless it makes one of that name); names that start with `_q_` are reserved.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, load, materialise, set_aside

BUCKETS = 1 << 13
TRUSTED_ROWS = 20_000
SPREAD = 6.0
FOLDS = 5
#: Grams of ratio 0 that each mean includes.
PRIOR = 50
#: Added to each bucket's count.
SMOOTHING = 1.0
WINDOW = 5
#: Columns that judge() makes; in its result they replace columns of these names.
MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "threshold", "method_failed", "kept")


def words(text: str) -> Column:
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACES), "")


def bucket(*parts: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")


def id_type(df: DataFrame, labels: DataFrame) -> str:
    """The type in which ids of both are compared."""
    return "long" if all(isinstance(x.schema["doc_id"].dataType, T.IntegralType) for x in (df, labels)) else "string"


def held_back(doc_id: str) -> Column:
    """Trusted rows that set the threshold; the others fit the target."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == 0


def trusted_ids(labels: DataFrame, kind: str) -> DataFrame:
    """_q_id: the doc_ids labelled quality 1 and not 0."""
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast(kind).alias("_q_id")).agg(F.min("quality").alias("q")).where("q = 1")
    return good.select("_q_id")


def bucket_counts(df: DataFrame, labels: DataFrame, text: str, buckets: int, trusted_rows: int) -> DataFrame:
    """bucket, raw, target: how often all and the fitted trusted rows' words and pairs fall into it."""
    kind = id_type(df, labels)
    few = trusted_ids(labels, kind).where(~held_back("_q_id")).orderBy(F.xxhash64("_q_id"), "_q_id").limit(trusted_rows)
    trusted = F.broadcast(few.withColumn("_q_on", F.lit(1)))  # at most trusted_rows
    each = df.select(F.col("doc_id").cast(kind).alias("_q_doc"), words(text).alias("w")).join(trusted, F.col("_q_doc") == F.col("_q_id"), "left")
    each = each.select("_q_on", "w", F.posexplode("w").alias("i", "a")).select("_q_on", "a", F.get("w", F.col("i") + 1).alias("b"))
    pair = F.when(F.col("b").isNotNull(), bucket("a", "b", buckets=buckets))
    each = each.select("_q_on", F.explode(F.array(bucket("a", buckets=buckets), pair)).alias("bucket")).where("bucket is not null")
    return each.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("_q_on").alias("target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """One row: the log ratios by bucket; all zero without trusted rows."""
    whole = counts.agg(F.collect_list(F.struct("bucket", "raw", "target")).alias("c"))
    total = lambda c, k: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x[k])
    whole = whole.select("c", total(F.col("c"), "raw").alias("raw"), total(F.col("c"), "target").alias("target"))
    seen = F.transform("c", lambda x: x["bucket"])
    missing = F.transform(F.array_except(F.sequence(F.lit(0), F.lit(buckets - 1)), seen), lambda i: F.struct(i.alias("bucket"), F.lit(0).cast("long").alias("raw"), F.lit(0).cast("long").alias("target")))
    whole = whole.withColumn("all", F.sort_array(F.concat("c", missing)))
    ratio = lambda x: F.ln((x["target"] + smoothing) / (F.col("target") + smoothing * buckets)) - F.ln((x["raw"] + smoothing) / (F.col("raw") + smoothing * buckets))
    return whole.select(F.transform("all", lambda x: F.round(F.when(F.col("target") > 0, ratio(x)).otherwise(0.0), 6)).alias("ratios"))


def score(w: str, ratios: Column, buckets: int) -> Column:
    """The length-normalised log ratio of the words and pairs in array column w; 0 for no words."""
    step = lambda s, i: s + F.get(ratios, bucket(F.get(w, i), buckets=buckets)) + F.when(i + 1 < F.size(w), F.get(ratios, bucket(F.get(w, i), F.get(w, i + 1), buckets=buckets))).otherwise(0.0)
    total = F.aggregate(F.sequence(F.lit(0), F.size(w) - 1), F.lit(0.0), step)
    return F.when(F.size(w) > 0, total / (2 * F.size(w) - 1 + PRIOR)).otherwise(0.0)


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """df with _q_w (words) and the base counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    some = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(some, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    out = df.withColumns({"_q_w": words(text), "_q_lines": lines})
    out = out.withColumns({
        "n_words": F.size("_q_w").cast("long"),
        "word_chars": F.length(F.array_join("_q_w", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(some, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        "_q_h": F.when(F.size("_q_w") > WINDOW, F.transform(F.sequence(F.lit(0), F.size("_q_w") - WINDOW), lambda i: F.xxhash64(*[F.get("_q_w", i + k) for k in range(WINDOW)]))),
    })
    # places of windows that occur twice or more, only where there are any: neighbours in the order of their hashes
    out = out.withColumn("_q_s", F.when(F.size(F.array_distinct("_q_h")) < F.size("_q_h"), F.sort_array(F.transform("_q_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("_q_s", lambda x, k: (F.get("_q_s", k + 1)["h"] == x["h"]) | (F.get("_q_s", k - 1)["h"] == x["h"]))
    out = out.withColumn("_q_at", F.when(F.col("_q_s").isNotNull(), F.sort_array(F.transform(twice, lambda x: x["i"]))))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    cover = lambda s, i: F.struct((s["n"] + i + WINDOW - F.greatest(i, s["end"])).alias("n"), (i + WINDOW).alias("end"))
    covered = F.aggregate("_q_at", start, cover)["n"]
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_q_lines", "_q_h", "_q_s", "_q_at")


def judge(df: DataFrame, labels: DataFrame, text: str = "text", buckets: int = BUCKETS, trusted_rows: int = TRUSTED_ROWS, spread: float = SPREAD, keep_text: bool = True) -> DataFrame:
    """df with the base counts, base_failed, score, threshold, method_failed, kept.

    Without the text, the result is small: it is written, and the threshold is taken from it. With it, the scores are computed
    twice, as the texts would have to be written too.
    """
    table = log_ratios(bucket_counts(df, labels, text, buckets, trusted_rows), buckets).first()["ratios"]
    ratios = F.from_json(F.lit(json.dumps(table)), "array<double>")  # folded to a literal: lambdas take no subquery
    kind = id_type(df, labels)
    out = features(df, text).withColumn("score", score("_q_w", ratios, buckets)).drop("_q_w")
    if keep_text:
        known = df.select("doc_id", words(text).alias("_q_w")).where(F.size("_q_w") > 0).select("doc_id", score("_q_w", ratios, buckets).alias("score"))
    else:
        out = materialise(out.drop(text), "judged")
        known = out.where("n_words > 0")
    back = trusted_ids(labels, kind).where(held_back("_q_id"))
    known = known.select(F.col("doc_id").cast(kind).alias("_q_doc"), "score").join(back, F.col("_q_doc") == F.col("_q_id"), "left_semi")
    least = known.agg(F.avg("score") - spread * F.coalesce(F.stddev_pop("score"), F.lit(0.0))).first()[0]
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = out.withColumns({"threshold": F.lit(float("-inf") if least is None else least), "base_failed": base})
    out = out.withColumn("method_failed", F.col("score") < F.col("threshold"))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("method_failed"))


def keep_good(df: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """df without its rejected rows.

    The row number keeps the condition above the judgement: pushed below, its columns would be computed in place,
    arrays inside lambdas among them.
    """
    own, back = set_aside(df, MADE)
    judged = judge(own, labels, **options).withColumn("_q_row", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("_q_row") >= 0)).select(*own.columns).withColumnsRenamed(back)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "labels"), keep_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


QUERIES = {"op5_quality": op5_quality}
ORACLE_SQL: dict[str, str] = {}
