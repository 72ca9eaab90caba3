"""License scans by diagonal voting, with DataFrame functions only.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of non-ASCII characters. All rolling word 3-grams of a
text (2-grams where a phrase of two words may begin) are hashed and joined with the templates' grams, which are a fixed small
table and broadcast; equal hashes are verified word by word. A hit at word p of the text and word q of the template votes for
the diagonal p - q; votes are gathered by row, template and diagonal. A base phrase stands where a diagonal has all its
votes.

For templates, the diagonal with the most votes within `band` words to either side (ties: the first) is a center, and the
diagonals in its reach are merged with it; the reach is measured from the center, so it does not drift. `band` is one for each
`BAND_WORDS` words of the template, 2 at least. The merged hits are verified as an alignment: template words in
order, each with the first place in the text that lies behind the one before. A span is kept if its aligned words
are at least `coverage` of the template's words and of the text's words from the first to the last of them; the lesser of the two
shares is its score.

Nothing but hits is shuffled, and the texts are read once for the hits and once for the word counts. Null texts have no words.
Repeated rows get equal results, an empty table gives no rows. Extra columns are kept unless scan() makes one of that name;
names that start with `_row_` are reserved. Templates may have any length from two words on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, NON_ALNUM, ROW, UPPER, ascii_lower, keyed, load, materialise

#: The phrases whose exact places are counted, and their labels.
BASE = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
#: Texts, notices and short forms of well-known licenses, and their labels.
TEMPLATES = (
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "mit",
    ),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("spdx license identifier mit", "mit"),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache-2.0",
    ),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("apache license version 2 0 january 2004", "apache-2.0"),
    ("spdx license identifier apache 2 0", "apache-2.0"),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "bsd",
    ),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("spdx license identifier bsd 3 clause", "bsd"),
    ("spdx license identifier bsd 2 clause", "bsd"),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version",
        "gpl",
    ),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    (
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
        "see the gnu general public license for more details",
        "gpl",
    ),
    ("you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "agpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mpl-2.0"),
    ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "unlicense"),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
        "zlib",
    ),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
)
#: Columns that scan() makes, in place of columns of these names.
MADE = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
GRAM = 3
BAND_WORDS = 16
COVERAGE = 0.8


def words(text: str) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), NON_ALNUM), "")


def band_of(size: int) -> int:
    return max(2, size // BAND_WORDS)


def gram_hash(*w: Column) -> Column:
    return F.xxhash64(F.lit(len(w)), *w)


def numbered(base, templates) -> list[tuple]:
    """number, words, gram size, exact, label of each phrase and template."""
    out = [(t, p.split(), min(GRAM, len(p.split())), exact, label) for t, (p, label, exact) in enumerate([(*x, True) for x in base] + [(*x, False) for x in templates])]
    if any(len(w) < 2 for _, w, *_ in out):
        raise ValueError("a template has at least two words")
    return out


def template_grams(spark: SparkSession, base, templates) -> DataFrame:
    """hash, t0, t1, t2, template (number), q, k (words of a gram), size (of the template), exact (base phrase), band, label."""
    rows = [(w[q], w[q + 1], w[q + 2] if k == 3 else None, t, q, k, len(w), exact, band_of(len(w)), label) for t, w, k, exact, label in numbered(base, templates) for q in range(len(w) - k + 1)]
    grams = spark.createDataFrame(rows, "t0 string, t1 string, t2 string, template int, q int, k int, size int, exact boolean, band int, label string")
    return grams.withColumn("hash", F.when(F.col("t2").isNull(), gram_hash(F.col("t0"), F.col("t1"))).otherwise(gram_hash(F.col("t0"), F.col("t1"), F.col("t2"))))


def votes(df: DataFrame, text: str, base, templates) -> DataFrame:
    """ROW, template, diagonal and qs: the places in the template, in order, of its grams that stand on the diagonal."""
    heads = sorted({w[0] for _, w, k, *_ in numbered(base, templates) if k == 2})
    each = keyed(df, text).select(*ROW, words(text).alias("w")).select(*ROW, "w", F.posexplode("w").alias("p", "w0"))
    each = each.select(*ROW, "p", "w0", F.get("w", F.col("p") + 1).alias("w1"), F.get("w", F.col("p") + 2).alias("w2")).where("w1 is not null")
    three = F.when(F.col("w2").isNotNull(), gram_hash(F.col("w0"), F.col("w1"), F.col("w2")))
    if heads:
        two = F.when(F.col("w0").isin(heads), gram_hash(F.col("w0"), F.col("w1")))
        each = each.select(*ROW, "p", "w0", "w1", "w2", F.explode(F.when(two.isNull(), F.array(three)).otherwise(F.array(three, two))).alias("h"))
    else:
        each = each.withColumn("h", three)
    grams = F.broadcast(template_grams(df.sparkSession, base, templates))  # of a fixed size
    # joined by the hash alone, a long; the few hits are then compared word by word
    hits = each.join(grams, F.col("h") == F.col("hash")).where((F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1")) & ((F.col("k") == 2) | (F.col("w2") == F.col("t2"))))
    place = [*ROW, "template", "k", "size", "exact", "band", "label", (F.col("p") - F.col("q")).alias("diagonal")]
    return hits.groupBy(*place).agg(F.sort_array(F.collect_set("q")).alias("qs"))


def find_licenses(df: DataFrame, text: str = "text", base=BASE, templates=TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """ROW, label, exact, start, end (words, end exclusive), covered (0 to 1): one row per verified span."""
    found = materialise(votes(df, text, base, templates), "votes")
    n_votes = F.size("qs")
    exact = found.where(F.col("exact") & (n_votes == F.col("size") - F.col("k") + 1))
    exact = exact.select(*ROW, "label", "exact", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("size")).alias("end"), F.lit(1.0).alias("covered"))
    # diagonals in units of a thousandth of the band: one frame for bands of any width
    scaled = found.where(~F.col("exact")).withColumn("unit", F.floor(F.col("diagonal") * 1000 / F.col("band")))
    reach = Window.partitionBy(*ROW, "template").orderBy("unit").rangeBetween(-1000, 1000)
    own = F.struct(n_votes.alias("n"), (-F.col("diagonal")).alias("d"))
    near = scaled.withColumns({"best": F.max(own).over(reach), "own": own, "all": F.collect_list(F.struct("diagonal", "qs")).over(reach)}).where(F.col("best") == F.col("own")).drop("best", "own")
    pairs = F.flatten(F.transform("all", lambda x: F.flatten(F.transform(x["qs"], lambda q: F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.struct((q + i).alias("q"), (q + i + x["diagonal"]).alias("p")))))))
    near = near.withColumn("pairs", F.sort_array(F.array_distinct(pairs))).where(F.size(F.array_distinct(F.transform("pairs", lambda x: x["q"]))) >= coverage * F.col("size"))
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("q"), F.lit(-1).alias("p"), F.lit(-1).alias("first"))
    step = lambda s, x: F.when((x["q"] > s["q"]) & (x["p"] > s["p"]), F.struct((s["n"] + 1).alias("n"), x["q"].alias("q"), x["p"].alias("p"), F.when(s["n"] == 0, x["p"]).otherwise(s["first"]).alias("first"))).otherwise(s)
    near = near.withColumn("a", F.aggregate("pairs", start, step))
    near = near.select(*ROW, "label", "exact", F.col("a.first").alias("start"), (F.col("a.p") + 1).alias("end"), F.least(F.col("a.n") / F.col("size"), F.col("a.n") / (F.col("a.p") + 1 - F.col("a.first"))).alias("covered"))
    return exact.unionByName(near.where(F.col("covered") >= coverage))


def scan(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """df (without the text) with n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spans = find_licenses(df, text, **options)
    base = F.col("exact")
    joined = lambda c: F.concat_ws(",", F.sort_array(c))
    each = spans.groupBy(*ROW).agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        joined(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"), joined(F.collect_set("label")).alias("labels"), F.max("covered").alias("score"),
    ).withColumnsRenamed({c: f"{c}2" for c in ROW})
    rest = [c for c in df.columns if c not in (text, *MADE)]
    rows = keyed(df, text).select(*rest, *ROW, F.size(words(text)).cast("long").alias("n_words"))
    out = rows.join(each, [F.col(c) == F.col(f"{c}2") for c in ROW], "left")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select(*rest, "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", empty("base_labels"), empty("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(load(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op4_license_scan": op4_license_scan}


def oracle() -> str:
    """The same in SQL, over gram texts in place of hashes."""
    rows = []
    for t, w, k, exact, label in numbered(BASE, TEMPLATES):
        rows += [f"('{' '.join(w[q : q + k])}', {t}, {q}, {k}, {len(w)}, {str(exact).lower()}, {band_of(len(w))}, '{label}')" for q in range(len(w) - k + 1)]
    return rf"""
WITH grams(g, template, q, k, size, exact, band, label) AS (VALUES {", ".join(rows)}),
docs AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
each AS (SELECT rid, p - 1 AS p, unnest([array_to_string(ws[p:p + 1], ' '), array_to_string(ws[p:p + 2], ' ')]) AS g FROM (SELECT *, unnest(range(1, len(ws))) AS p FROM docs)),
found AS (SELECT rid, template, k, size, exact, band, label, p - q AS diagonal, list_sort(list_distinct(list(q))) AS qs FROM each JOIN grams USING (g) GROUP BY ALL),
base AS (SELECT rid, diagonal AS start, label, 1.0::double AS covered FROM found WHERE exact AND len(qs) = size - k + 1),
near0 AS (SELECT *, CAST(floor(diagonal * 1000 / band::double) AS BIGINT) AS unit FROM found WHERE NOT exact),
near1 AS (SELECT *, max(len(qs) * 1000000000 - diagonal) OVER reach AS best, list(qs) OVER reach AS all_qs, list(diagonal) OVER reach AS all_ds FROM near0 WINDOW reach AS (PARTITION BY rid, template ORDER BY unit RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING)),
near2 AS (SELECT row_number() OVER () AS sid, rid, k, size, label, all_qs, all_ds FROM near1 WHERE best = len(qs) * 1000000000 - diagonal),
pairs AS (SELECT DISTINCT sid, q + i AS q, q + i + d AS p FROM (SELECT sid, k, d, unnest(qs) AS q FROM (SELECT sid, k, unnest(all_qs) AS qs, unnest(all_ds) AS d FROM near2)) JOIN (SELECT unnest([0, 1, 2]) AS i) ON i < k),
aligned AS (SELECT sid, list_reduce(list({{'n': 1, 'q': q, 'p': p, 'first': p}} ORDER BY q, p), lambda s, x: CASE WHEN x.q > s.q AND x.p > s.p THEN {{'n': s.n + 1, 'q': x.q, 'p': x.p, 'first': s.first}} ELSE s END) AS a FROM pairs GROUP BY 1),
near AS (SELECT rid, label, least(a.n / size::double, a.n / (a.p + 1 - a.first)::double) AS covered FROM near2 JOIN aligned USING (sid)),
spans AS (SELECT rid, start, label, covered, true AS exact FROM base UNION ALL SELECT rid, NULL, label, covered, false FROM near WHERE covered >= {COVERAGE}::double),
per AS (SELECT rid, count(*) FILTER (exact) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(covered) AS score FROM spans GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::double) AS score
FROM docs LEFT JOIN per USING (rid)"""


ORACLE_SQL = {"op4_license_scan": oracle()}
