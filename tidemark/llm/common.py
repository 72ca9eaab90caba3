"""Helpers shared by the operators: input tables, the shared folder, worker-side state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import discard, materialise, shared_dir

__all__ = ["discard", "materialise", "shared_dir"]

#: ASCII upper-case letters and their lower-case forms, for rules that fold only A-Z.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Java and Python regex for runs of the separators 0x20 and 0x09-0x0D.
SPACES = r"[\x20\x09-\x0D]+"
#: ... and of every ASCII character that is no digit and no lower-case letter.
NON_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker, over all its tasks."""
    import sys
    import types

    return sys.modules.setdefault("_tidemark_worker", types.ModuleType("_tidemark_worker")).__dict__


def words_of(text: Column, separators: str) -> Column:
    """The non-empty pieces between runs of separators; an empty array for null or nothing but separators."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z in whole texts at the speed of lower().

    lower() also folds other scripts, which keeps word boundaries; the two characters that it would turn into
    ASCII letters (U+212A, U+0130) are replaced by other non-ASCII letters first.
    """
    return F.lower(F.replace(F.replace(text, F.lit("K"), F.lit("ĸ")), F.lit("İ"), F.lit("ı")))


#: Columns that name and order rows: null ids last, then by id, then by the text's hash. Rows that repeat doc_id and
#: text share them.
ROW = ["_row_none", "_row_id", "_row_hash"]


def keyed(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the ROW columns, none of them null. Ids that are neither numbers nor texts are ordered as texts."""
    kind = df.schema["doc_id"].dataType
    own = F.col("doc_id").cast("long") if isinstance(kind, T.IntegralType) else F.col("doc_id") if isinstance(kind, T.NumericType) else F.col("doc_id").cast("string")
    nothing = F.lit(0).cast(kind) if isinstance(kind, T.NumericType) else F.lit("")
    return df.withColumns({"_row_none": F.col("doc_id").isNull(), "_row_id": F.coalesce(own, nothing), "_row_hash": F.coalesce(F.xxhash64(text), F.lit(0))})


def set_aside(df: DataFrame, names) -> tuple[DataFrame, dict[str, str]]:
    """df with those of its columns that have one of `names` renamed, and the map to rename them back."""
    back = {f"_aside_{c}": c for c in df.columns if c in names}
    return df.withColumnsRenamed({c: k for k, c in back.items()}), back
