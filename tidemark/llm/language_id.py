"""Language ID by rank-order profiles and out-of-place distance.

Grams are 1 to 3 letters of lower-cased text, where a run of other characters is one boundary; letters of all scripts are
kept as they are. A profile lists grams by falling frequency (ties: by code); a language's profile holds the `TOP` most
frequent grams of all documents to learn from, a document's the `TOP` most frequent of its whole text. The distance
is the sum, over the document's grams, of how far a gram's ranks lie apart; `TOP` for a gram that the language's profile
lacks. The nearest language is predicted (ties: the first by name); the score is one less the ratio of its distance to that
of the next language, 0 if there is only one.

Learned from text and non-null lang of rows whose crc32(doc_id as text) mod 5 is not 0; a null doc_id is neither learned
from nor held out. Null texts and texts without a letter get `und` and 0, and so does every text if there is nothing
to learn from. Repeated rows count each time. Other columns are kept apart from the made ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import load, worker_state

TOP = 400
FOLDS = 5
#: Grams that a task counts before it passes the counts on; the sum by language and gram puts them together.
GRAMS_HELD = 1_000_000
#: Gram codes: triples of code points (0: boundary) in a number system of this base, then pairs, then single letters.
BASE = 0x110000 + 1
PAIRS, SINGLES = 2 * 10**18, 4 * 10**18


def letters() -> np.ndarray:
    """Which code points are letters."""
    kept = worker_state()
    if "letters" not in kept:
        kept["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return kept["letters"]


def grams(text: str, is_letter: np.ndarray) -> np.ndarray:
    """Codes of all grams of the text, in no particular order; empty if it has no letter."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    a = np.concatenate([[0], np.where(is_letter[a], a, 0), [0]]).astype(np.int64)
    a = a[np.concatenate([[True], (a[1:] != 0) | (a[:-1] != 0)])]  # one boundary for a run
    two = a[:-1] * BASE + a[1:]
    three = (two[:-1] * BASE + a[2:])[a[1:-1] != 0]  # none across a boundary
    return np.concatenate([SINGLES + a[a != 0], PAIRS + two, three]) if len(a) > 1 else np.zeros(0, np.int64)


def ranked(codes: np.ndarray, top: int) -> np.ndarray:
    """The `top` most frequent codes, the most frequent first."""
    code, n = np.unique(codes, return_counts=True)
    return code[np.argsort(-n, kind="stable")[:top]]


def learn(df: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP) -> dict[str, list[int]]:
    """Each language's profile, from all rows of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter, held, n_held = letters(), {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            for own, parts in held.items():
                some, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([own] * len(some), pa.string()), pa.array(some, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for own, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                codes = grams(x.as_py(), is_letter)
                held.setdefault(own, []).append(codes)
                n_held += len(codes)
                if n_held >= GRAMS_HELD:
                    yield from flush()
                    n_held = 0
        yield from flush()

    known = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = known.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out: dict[str, list[int]] = {}
    for own, gram, _ in sorted(best.select("lang", "gram", "rank").collect(), key=lambda r: (r[0], r[2])):
        out.setdefault(own, []).append(gram)
    return out


class Profiles:
    """Ranks by gram and language, for all grams of any profile."""

    def __init__(self, profiles: dict[str, list[int]], top: int):
        self.top, self.names = top, sorted(profiles)
        self.codes = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), -1, np.int64)
        for k, own in enumerate(self.names):
            self.ranks[np.searchsorted(self.codes, profiles[own]), k] = np.arange(len(profiles[own]))

    @classmethod
    def of(cls, state: dict) -> Profiles:
        """The profiles of these attributes. They are broadcast, not the object: workers may have no copy of this module."""
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def predict(self, text: str | None, is_letter: np.ndarray) -> tuple[str, float]:
        codes = grams(text, is_letter) if text else np.zeros(0, np.int64)
        if not len(codes) or not self.names:
            return "und", 0.0
        own = ranked(codes, self.top)
        at = np.searchsorted(self.codes, own)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = len(self.codes)
        ranks = self.ranks[at]
        apart = np.where(ranks < 0, self.top, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(apart))
        rest = np.delete(apart, best)
        return self.names[best], float(1 - apart[best] / rest.min()) if len(rest) and rest.min() else 0.0


def identify(df: DataFrame, profiles: dict[str, list[int]], text: str = "text", top: int = TOP) -> DataFrame:
    """df without the text, with lang_pred and score."""
    sent = df.sparkSession.sparkContext.broadcast(vars(Profiles(profiles, top)))
    rest = [c for c in df.columns if c not in (text, "lang_pred", "score")]
    schema = T.StructType([*df.select(*rest).schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter, known = letters(), Profiles.of(sent.value)
        for batch in batches:
            found = [known.predict(x.as_py(), is_letter) for x in batch.column(len(rest))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*rest, "lang_pred", "score"])

    return df.select(*rest, text).mapInArrow(run, schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    profiles = learn(docs.where(fold != 0))
    rows = docs.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "text")
    return identify(rows, profiles)


QUERIES = {"op9_language_id": op9_language_id}
#: The same over gram texts; a space is the boundary, which sorts before every letter. crc32 is written out.
ORACLE_SQL = {
    "op9_language_id": rf"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
docs AS (SELECT row_number() OVER () AS rid, doc_id, lang, text, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % {FOLDS} AS fold FROM documents, crc),
lines AS (SELECT rid, ' ' || trim(regexp_replace(lower(text), '[^\p{{L}}]+', ' ', 'g')) || ' ' AS s FROM docs WHERE regexp_matches(text, '\p{{L}}')),
places AS (SELECT rid, s, unnest(range(1, len(s) + 1)) AS i FROM lines),
found AS (SELECT rid, s[i:i] AS g FROM places WHERE s[i:i] <> ' ' UNION ALL SELECT rid, s[i:i + 1] FROM places WHERE i < len(s) UNION ALL SELECT rid, s[i:i + 2] FROM places WHERE i + 1 < len(s) AND s[i + 1:i + 1] <> ' '),
counts AS (SELECT rid, g, count(*) AS n FROM found GROUP BY ALL),
own AS (SELECT rid, g, row_number() OVER (PARTITION BY rid ORDER BY n DESC, -len(g), g) - 1 AS r FROM counts QUALIFY r < {TOP}),
totals AS (SELECT lang, g, sum(n) AS n FROM counts JOIN docs USING (rid) WHERE fold <> 0 AND lang IS NOT NULL GROUP BY ALL),
profiles AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, -len(g), g) - 1 AS r FROM totals QUALIFY r < {TOP}),
langs AS (SELECT DISTINCT lang FROM profiles),
apart AS (SELECT rid, l.lang, sum(CASE WHEN p.r IS NULL THEN {TOP} ELSE abs(p.r - own.r) END) AS d FROM own CROSS JOIN langs l LEFT JOIN profiles p ON p.lang = l.lang AND p.g = own.g GROUP BY ALL),
best AS (SELECT rid, list(lang ORDER BY d, lang)[1] AS lang_pred, list(d ORDER BY d, lang) AS ds FROM apart GROUP BY 1)
SELECT doc_id, coalesce(fold = 0, false) AS held_out, coalesce(lang_pred, 'und') AS lang_pred, CASE WHEN len(ds) > 1 AND ds[2] > 0 THEN 1 - ds[1] / ds[2]::double ELSE 0.0::double END AS score
FROM docs LEFT JOIN best USING (rid)""",
}
