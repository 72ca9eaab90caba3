"""Token counts by the whole-token shortcut.

Offline, each vocabulary string is tried alone: those that the library gives back as one token are proved. Online,
a text is split into pre-tokens; the proved ones count one each, only the rest are merged.

Null texts count as empty. Repeated rows are counted one by one. Extra columns of the input are kept as they are,
except `n_bytes`, `n_tokens` and `over_limit`, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import load
from .tokenizing import counter, prove_single_tokens, read_tokenizer

LIMIT = 512


def count_tokens(df: DataFrame, text: str = "text", tokenizer_path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """df with n_bytes, n_tokens, over_limit in place of the text column."""
    made = ("n_bytes", "n_tokens", "over_limit")
    spec = read_tokenizer(tokenizer_path)
    sent = df.sparkSession.sparkContext.broadcast((spec, prove_single_tokens(spec)))
    rest = [c for c in df.columns if c != text and c not in made]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(*sent.value)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for x in batch.column(len(rest)):
                x = x.as_py() or ""
                n_bytes.append(len(x.encode("utf-8")))
                n_tokens.append(sum(tokens.of(x)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names=[*rest, "n_bytes", "n_tokens"])

    out = df.select(*[df[c] for c in rest], df[text]).mapInArrow(count, schema)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(load(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op7_token_counts": op7_token_counts}
ORACLE_SQL: dict[str, str] = {}
