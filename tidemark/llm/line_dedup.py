"""Line dedup by winnowing over line hashes, with DataFrame functions only.

Lines are what stands between newlines, trimmed of separators for comparison; lines without a word never match and
stay where they are. A run is `run_lines` consecutive lines with words; every run that also stands earlier, in order of
(doc_id, line), is deleted with all its lines, so a longer repeated passage goes as a whole: its runs overlap. With
`run_lines` 1, the default, this is every line that stands earlier anywhere.

Winnowing: a window goes over the hashes of grams of `gram_lines` lines and selects the gram of least hash (ties: the
first). Windows that follow each other mostly select the same gram; it is one fingerprint, with the range of its windows.
Equal windows select equal grams, so a fingerprint whose gram is selected nowhere else has no window that repeats, and is
not looked at again. The others are extended from the gram both ways to their whole windows, which are compared by the
SHA-256 digest of their lines; equal digests stand for equal texts.

A window is a run. A run of one line would be a window that selects itself, so with `run_lines` 1 the windows are of
`window_lines` lines and find all repeated passages of that length or more; the lines that they leave are then compared one by one,
which is exact for shorter repeats. A line that goes has an equal one earlier, so the first of each is among what is left.

Only digests and places are shuffled; first occurrences are pre-aggregated, and the join by digest is one that adaptive
execution can split. Texts are shuffled once, by row, for the rewrite.

Null texts stay null and empty texts empty. Ids may be of any type that can be ordered; rows with a null doc_id come last.
Rows that repeat doc_id and text are one document and get the same text. Extra columns are kept; names that start with
`_ld_` or `_row_` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, keyed, load, materialise

#: Lines of the shortest repeated run that is deleted, and of the grams that stand for runs.
RUN_LINES = 1
GRAM_LINES = 1
#: Lines of a window if runs are single lines; it decides which step finds a repeated line, not whether it is found.
WINDOW_LINES = 4


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def lines_of(text: Column) -> Column:
    """The digest of each line, null for one without words."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.when(trimmed(x) != "", digest(trimmed(x))))


def same_row(other: DataFrame) -> tuple[DataFrame, list[Column]]:
    """other with its row key renamed, and the condition that joins it."""
    return other.withColumnsRenamed({c: f"{c}2" for c in ROW}), [F.col(c) == F.col(f"{c}2") for c in ROW]


def fingerprints(lines: DataFrame, run_lines: int, gram_lines: int = GRAM_LINES) -> DataFrame:
    """Row key, gram (the hash that windows of `run_lines` lines select), lo and hi (the first and last of these windows, from 1)."""
    # arrays that lambdas read are columns of their own and used outside them too, or they would be computed once for each element
    starts = lambda of, size: F.sequence(F.lit(1), F.size(of) - (size - 1))
    hashed = lines.select(*ROW, F.array_compact("ds").alias("bare")).where(F.size("bare") >= run_lines)
    hashed = hashed.withColumn("grams", F.transform(starts("bare", gram_lines), lambda i: F.struct(F.xxhash64(F.slice("bare", i, gram_lines)).alias("gram"), i.alias("at"))))
    window = run_lines - gram_lines + 1
    hashed = hashed.select(*ROW, F.transform(starts("grams", window), lambda i: F.array_min(F.slice("grams", i, window))).alias("picks"))
    fresh = F.filter(F.sequence(F.lit(1), F.size("picks")), lambda i: (i == 1) | (F.get("picks", i - 1)["at"] != F.get("picks", i - 2)["at"]))
    hashed = hashed.withColumn("fresh", fresh)
    each = F.transform("fresh", lambda lo, k: F.struct(F.get("picks", lo - 1)["gram"].alias("gram"), lo.alias("lo"), (F.coalesce(F.get("fresh", k + 1), F.size("picks") + 1) - 1).alias("hi")))
    return hashed.select(*ROW, F.explode(each).alias("x")).select(*ROW, "x.*")


def runs_of(lines: DataFrame, run_lines: int, gram_lines: int = GRAM_LINES) -> DataFrame:
    """Row key, d (the run's digest), first (place of its first line) and places (of all its lines), of runs that may repeat."""
    prints = materialise(fingerprints(lines, run_lines, gram_lines), "fingerprints")
    twice = materialise(prints.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "twice")
    met = prints.join(twice, "gram", "left_semi").groupBy(*ROW).agg(F.collect_set(F.struct("lo", "hi")).alias("met"))
    other, same = same_row(met)
    ats = F.filter(places_of("ds"), lambda i: F.get("ds", i).isNotNull())
    held = lines.join(other, same).select(*ROW, "ds", ats.alias("ats"), F.flatten(F.transform("met", lambda x: F.sequence(x["lo"], x["hi"]))).alias("starts"))
    places = lambda i: F.slice("ats", i, run_lines)
    run = lambda i: F.struct(digest(F.concat_ws("", F.transform(places(i), lambda k: F.hex(F.get("ds", k))))).alias("d"), places(i).alias("places"))
    each = held.select(*ROW, F.explode(F.transform("starts", run)).alias("x")).select(*ROW, "x.d", F.col("x.places")[0].alias("first"), "x.places")
    return materialise(each, "runs")


def places_of(lines: str) -> Column:
    return F.sequence(F.lit(0), F.size(lines) - 1)


def rest_of(lines: DataFrame, gone: DataFrame) -> DataFrame:
    """As runs_of, of the single lines that are not gone."""
    other, same = same_row(gone)
    left = lines.join(other, same, "left").select(*ROW, "ds", F.array_except(places_of("ds"), F.coalesce("gone", F.array().cast("array<int>"))).alias("left"))
    each = left.select(*ROW, F.explode(F.transform("left", lambda i: F.struct(F.get("ds", i).alias("d"), i.alias("first")))).alias("x")).select(*ROW, "x.*")
    return materialise(each.where("d is not null"), "rest").withColumn("places", F.array("first"))


def later_places(runs: DataFrame) -> DataFrame:
    """Row key and gone: the places of lines in runs that stand earlier."""
    place = F.struct(*ROW, "first")
    earliest = runs.groupBy("d").agg(F.min(place).alias("earliest"), F.count("*").alias("n")).where("n > 1").select(F.col("d").alias("same"), "earliest")
    earliest = materialise(earliest, "earliest")  # behind an exchange of its own, so that a hot digest's join can be split
    later = runs.join(earliest, F.col("d") == F.col("same")).where(place > F.col("earliest"))
    return later.groupBy(*ROW).agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("gone"))


def repeated_lines(df: DataFrame, text: str = "text", run_lines: int = RUN_LINES, gram_lines: int = GRAM_LINES, window_lines: int = WINDOW_LINES) -> DataFrame:
    """Row key and gone: the places of lines in runs that stand earlier."""
    if not 1 <= gram_lines <= run_lines:
        raise ValueError("a gram has at least one line and at most as many as a run")
    some = df.where(F.col(text).rlike(r"[^\x20\x09-\x0D]"))  # cheap, and leaves no row without lines
    lines = materialise(keyed(some, text).select(*ROW, lines_of(F.col(text)).alias("ds")), "lines")
    if run_lines > 1:
        return later_places(runs_of(lines, run_lines, gram_lines))
    passages = materialise(later_places(runs_of(lines, window_lines)), "passages")
    both = passages.unionByName(later_places(rest_of(lines, passages)))
    return both.groupBy(*ROW).agg(F.flatten(F.collect_list("gone")).alias("gone"))


def dedup_lines(df: DataFrame, text: str = "text", counts: bool = True, length: str | None = None, **options) -> DataFrame:
    """df without later repeated runs of lines; with n_lines and n_deleted of each row in place of columns of these names
    if `counts`. length: a column that holds the text's length and follows it."""
    gone, same = same_row(repeated_lines(df, text, **options).withColumnRenamed("gone", "_ld_gone"))
    joined = keyed(df, text).join(gone, same, "left")
    joined = joined.withColumn("_ld_all", F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1))
    # again: arrays that lambdas read are used outside them too, or they would be computed once for each element
    stay = F.array_except(F.sequence(F.lit(0), F.size("_ld_all") - 1), "_ld_gone")
    cut = F.when(F.col("_ld_gone").isNull(), F.col(text)).otherwise(F.array_join(F.transform(stay, lambda i: F.element_at("_ld_all", i + 1)), "\n"))
    joined = joined.withColumn("_ld_text", cut)
    own = {text: F.col("_ld_text").alias(text)}
    if length:
        own[length] = F.when(F.col("_ld_gone").isNull(), F.col(length)).otherwise(F.length("_ld_text").cast(df.schema[length].dataType)).alias(length)
    if not counts:
        return joined.select(*[own.get(c, F.col(c)) for c in df.columns])
    rest = [own.get(c, F.col(c)) for c in df.columns if c not in ("n_lines", "n_deleted")]
    return joined.select(*rest, F.when(F.col(text).isNull(), 0).otherwise(F.size("_ld_all")).cast("long").alias("n_lines"), F.coalesce(F.size("_ld_gone"), F.lit(0)).cast("long").alias("n_deleted"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op6_line_dedup": op6_line_dedup}
#: The same with the lines themselves as keys.
ORACLE_SQL = {
    "op6_line_dedup": r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
each AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS k FROM docs),
named AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM each),
placed AS (SELECT *, bare <> '' AND row_number() OVER (PARTITION BY bare ORDER BY doc_id NULLS LAST, rid, k) > 1 AS gone FROM named),
cut AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (gone) AS n_deleted, string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone) AS left_over FROM placed GROUP BY 1)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN n_deleted = 0 THEN text ELSE coalesce(left_over, '') END AS text, CASE WHEN text IS NULL THEN 0 ELSE n_lines END AS n_lines, n_deleted
FROM docs JOIN cut USING (rid)""",
}
