"""Benchmark decontamination: a broadcast set of normalised test windows, looked up at each training position.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of all non-ASCII characters. A window is `size`
consecutive words of a benchmark item; an item of fewer words, but not none, is one window. The benchmark's word
ids, window hashes and window places are broadcast in blocks of at most about `block_bytes` of item text: the usual
benchmark is one block; for a larger one the rows are written once with a number, scanned block by block, and only the hits
of each pass are written, by row. Every hash hit is verified word by word.

Null texts have no words; empty tables give no hits; a null item id is never reported but its windows hit. Repeated
rows are scanned one by one. Extra columns of the documents are kept, apart from `n_words`, `spans`, `items`, which
are replaced; names that start with `_dc_` are reserved.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import load, materialise, set_aside

SIZE = 10
BLOCK_BYTES = 16_000_000
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Columns that find_leaks() makes, in place of columns of these names.
MADE = ("n_words", "spans", "items")
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def fold_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(_FOLD).split() if text else []


def multipliers(size: int) -> np.ndarray:
    return np.random.default_rng(20_240_117).integers(1, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def hashes(ids: np.ndarray, at: np.ndarray, length: int, mul: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for k in range(length):
        x = (ids[at + k] + 1).astype(np.uint64) * mul[k]
        out += x ^ (x >> np.uint64(29))
    return out


class Index:
    """Windows of benchmark items. `lengths`: by window length, sorted hashes with each window's place and item."""

    def __init__(self, items: list[tuple], size: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items, ids, by_length = [], [], {}
        at = 0
        for item_id, text in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in fold_words(text)]
            if not own:
                continue
            k = len(self.items)
            self.items.append(item_id)
            length = min(size, len(own))
            starts, owners = by_length.setdefault(length, ([], []))
            starts.extend(range(at, at + len(own) - length + 1))
            owners.extend(repeat(k, len(own) - length + 1))
            ids += own
            at += len(own)
        self.ids = np.array(ids, np.int64)
        self.mul = multipliers(size)
        self.lengths = {}
        for length, (starts, owners) in sorted(by_length.items()):
            starts, owners = np.array(starts, np.int64), np.array(owners, np.int64)
            h = hashes(self.ids, starts, length, self.mul)
            order = np.argsort(h, kind="stable")
            self.lengths[length] = (h[order], starts[order], owners[order])

    @classmethod
    def of(cls, state: dict) -> Index:
        """The index of these attributes. They are broadcast, not the object: workers may have no copy of this module."""
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans of hit words, and the items that have occurring windows."""
        n = len(words)
        if not n or not self.items:
            return [], set()
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, n)
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        cover, found = None, set()
        for length, (sorted_h, starts, owners) in self.lengths.items():
            if n < length:
                continue
            at = np.flatnonzero(unknown[length:] == unknown[: n - length + 1])
            if not len(at):
                continue
            h = hashes(ids, at, length, self.mul)
            lo, hi = np.searchsorted(sorted_h, h, "left"), np.searchsorted(sorted_h, h, "right")
            hit = hi > lo
            if not hit.any():
                continue
            at, lo, hi = at[hit], lo[hit], hi[hit]
            real = np.zeros(len(at), bool)
            listed: dict[bytes, bool] = {}  # windows of this text that were compared already
            for k in range(len(at)):
                window = ids[at[k] : at[k] + length]
                key = window.tobytes()
                if key not in listed:
                    same = [j for j in range(lo[k], hi[k]) if (window == self.ids[starts[j] : starts[j] + length]).all()]
                    found.update(self.items[owners[j]] for j in same)
                    listed[key] = bool(same)
                real[k] = listed[key]
            at = at[real]
            if cover is None:
                cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + length, -1)
        if cover is None:
            return [], found
        on = np.concatenate([[0], (np.cumsum(cover)[:n] > 0).astype(np.int8), [0]])
        edge = np.diff(on)
        return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())), found


def blocks(benchmark: DataFrame, block_bytes: int) -> tuple[int, Iterator[list[tuple]]]:
    """Number of blocks, and the benchmark's items in blocks of about block_bytes at most, one at a time."""
    rows = benchmark.select(F.col("item_id").cast("string"), "text").where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = -(-total // block_bytes) if total else 0
    part = lambda b: rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
    return n, ([tuple(r) for r in part(b).collect()] for b in range(n))


def find_leaks(df: DataFrame, benchmark: DataFrame, size: int = SIZE, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """df with n_words, spans (hit words, merged, from 0, end exclusive) and items (distinct ids, sorted)."""
    rest = [c for c in df.columns if c not in MADE]
    out = df.select(*[df[c] for c in rest])
    n, parts = blocks(benchmark, block_bytes)
    if n <= 1:
        return scanned(out, Index(next(parts, []), size), text)
    out = materialise(out.withColumn("_dc_row", F.monotonically_increasing_id()), "rows")
    hits = None
    for items in parts:
        found = scanned(out.select("_dc_row", text), Index(items, size), text).where(F.size("spans") > 0).select("_dc_row", "spans", "items")
        found = materialise(found, "hits")
        hits = found if hits is None else hits.unionByName(found)
    hits = hits.groupBy("_dc_row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return scanned(out.join(hits, "_dc_row", "left").drop("_dc_row"), None, text)


def scanned(df: DataFrame, index: Index | None, text: str) -> DataFrame:
    """df with n_words, spans and items; without an index the spans of columns spans and items, merged."""
    rest = [c for c in df.columns if c not in MADE]
    at = rest.index(text)
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    sent = df.sparkSession.sparkContext.broadcast(vars(index)) if index else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Index.of(sent.value) if sent else None
        for batch in batches:
            n_words, spans, items = [], [], []
            before = repeat(([], [])) if sent else zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist())
            for x, (hit, ids) in zip(batch.column(at), before):
                words = fold_words(x.as_py())
                if own:
                    hit, ids = own.scan(words)
                else:
                    hit, ids = join_spans([(s["start"], s["end"]) for s in hit or []]), ids or []
                n_words.append(len(words))
                spans.append([{"start": s, "end": e} for s, e in hit])
                items.append(sorted(i for i in ids if i is not None))
            arrays = [pa.array(n_words, pa.int64()), pa.array(spans, spans_type), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *arrays], names=[*rest, *MADE])

    return df.mapInArrow(scan, schema)


def join_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def decontaminate(df: DataFrame, benchmark: DataFrame, mode: str = "document", **options) -> DataFrame:
    """df without its leaks: whole documents (`document`) or only the hit words (`span`, the rest stays as it is)."""
    df, back = set_aside(df, MADE)
    leaks = find_leaks(df, benchmark, **options)
    if mode == "document":
        return leaks.where(F.size("spans") == 0).select(*df.columns).withColumnsRenamed(back)
    if mode != "span":
        raise ValueError(mode)
    columns, schema = df.columns, df.schema
    text = options.get("text", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
        for batch in batches:
            texts = []
            for x, spans in zip(batch.column(text).to_pylist(), batch.column("spans").to_pylist()):
                if spans:
                    places = [m.span() for m in word.finditer(x)]
                    kept, done = [], 0
                    for s in spans:
                        kept.append(x[done : places[s["start"]][0]])
                        done = places[s["end"] - 1][1]
                    x = "".join([*kept, x[done:]])
                texts.append(x)
            at = columns.index(text)
            arrays = [pa.array(texts, pa.string()) if i == at else batch.column(c) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return leaks.mapInArrow(cut, schema).withColumnsRenamed(back)


def digest(leaks: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return leaks.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_leaks(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark")))


QUERIES = {"op2_decontamination": op2_decontamination}
#: The same result by joins of windows written out as text.
ORACLE_SQL = {
    "op2_decontamination": r"""
WITH folded AS (SELECT *, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
                FROM (SELECT 'd' AS kind, row_number() OVER () AS rid, CAST(doc_id AS VARCHAR) AS id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), CAST(item_id AS VARCHAR), text FROM benchmark)),
items AS (SELECT id, ws, least(10, len(ws)) AS size FROM folded WHERE kind = 'b' AND len(ws) > 0),
windows AS (SELECT DISTINCT id, size, array_to_string(ws[p:p + size - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS p FROM items)),
docs AS (SELECT rid, CAST(id AS BIGINT) AS doc_id, ws FROM folded WHERE kind = 'd'),
places AS (SELECT rid, size, p, array_to_string(ws[p:p + size - 1], ' ') AS win FROM (SELECT rid, ws, size, unnest(range(1, len(ws) - size + 2)) AS p FROM docs, (SELECT DISTINCT size FROM windows))),
hits AS (SELECT rid, size, p, id FROM places JOIN windows USING (size, win)),
words AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + size)) AS q FROM hits) GROUP BY 1),
found AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, id FROM hits WHERE id IS NOT NULL) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (rid) LEFT JOIN found USING (rid)""",
}
