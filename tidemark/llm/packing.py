"""Sum-of-squares online packing of token ids into windows.

A document's full windows are closed at once; its rest goes to the fill level for which the sum, over all levels, of
the squared number of partially filled windows grows least (ties: the fullest window). The counts are held in a
level array. Each task packs its own rows, so nothing is shuffled; open windows hold no more than the ids of a task's rows.
At its end the emptiest windows' pieces are cut to fill the fullest ones. What then remains in a task, less
than one window, is cut at powers of two, which need no padding. `doc_id` may be of any type.

Null texts are empty documents (only the end id). Repeated rows are packed one by one; an empty table gives no rows.
`doc_id` may be null. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import load
from .tokenizing import encoder, read_tokenizer

WINDOW = 1024
END_ID = 0
MADE = [T.StructField(c, T.BinaryType() if c == "ids" else T.LongType()) for c in ("start", "length", "ids", "doc_tokens", "sequence_id", "offset")]


class Packer:
    """A piece is (doc_id, start, ids as little-endian unsigned 32-bit bytes, tokens of its document)."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)  # partially filled windows by fill level
        self.open: list[list[list[tuple]]] = [[] for _ in range(window + 1)]
        self.n_open = 0
        self.closed: list[list[tuple]] = []

    def level_for(self, size: int) -> int:
        """The level h whose window should take `size` more ids; 0 is a new window."""
        top = self.window - size
        before, after = self.count[: top + 1], self.count[size:]
        cost = 2 * (after - before) + 1
        cost[1:] += 1
        cost[top] -= 1  # a full window leaves the array
        cost[1:][before[1:] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(cost[::-1]))

    def add(self, doc_id, ids: bytes) -> None:
        n, w = len(ids) // 4, self.window
        full = n - n % w
        for at in range(0, full, w):
            self.closed.append([(doc_id, at, ids[4 * at : 4 * (at + w)], n)])
        if full == n:
            return
        size = n - full
        h = self.level_for(size)
        bin_ = self.take(h) if h else []
        bin_.append((doc_id, full, ids[4 * full :], n))
        self.put(bin_, h + size)

    def take(self, level: int) -> list[tuple]:
        self.count[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def put(self, bin_: list[tuple], level: int) -> None:
        if level == self.window:
            self.closed.append(bin_)
        elif level:
            self.open[level].append(bin_)
            self.count[level] += 1
            self.n_open += 1

    def settle(self) -> None:
        """Fills the fullest windows with cut pieces of the emptiest, until at most one window is open."""
        lo, hi = 1, self.window - 1
        while self.n_open > 1:
            while not self.count[hi]:
                hi -= 1
            into, room = self.take(hi), self.window - hi
            while room:
                while not self.count[lo]:
                    lo += 1
                    if lo >= self.window:
                        break
                if lo >= self.window:
                    break
                left, level = self.take(lo), lo
                while room and left:
                    doc_id, start, ids, n = left.pop()
                    size = min(room, len(ids) // 4)
                    into.append((doc_id, start, ids[: 4 * size], n))
                    if len(ids) > 4 * size:
                        left.append((doc_id, start + size, ids[4 * size :], n))
                    room -= size
                    level -= size
                self.put(left, level)
                lo = min(lo, level) or 1
            self.put(into, self.window - room)

    def finish(self) -> None:
        self.settle()
        for level in np.flatnonzero(self.count):
            left = self.take(int(level))
            while level:
                room = size = 1 << (int(level).bit_length() - 1)
                into = []
                while room:
                    doc_id, start, ids, n = left.pop()
                    part = min(room, len(ids) // 4)
                    into.append((doc_id, start, ids[: 4 * part], n))
                    if len(ids) > 4 * part:
                        left.append((doc_id, start + part, ids[4 * part :], n))
                    room -= part
                self.closed.append(into)
                level -= size

    def drain(self) -> list[list[tuple]]:
        out, self.closed = self.closed, []
        return out


def pack(df: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece; `ids` holds them as little-endian unsigned 32-bit integers.

    Sequence ids carry the task's partition number, so a task that runs again gives the same ones.
    """
    spec = read_tokenizer(tokenizer_path)
    sent = df.sparkSession.sparkContext.broadcast(spec)
    end = end_id.to_bytes(4, "little")
    schema = T.StructType([df.schema["doc_id"], *MADE])
    id_type = to_arrow_type(df.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer = encoder(sent.value), Packer(window)
        types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        sequence = TaskContext.get().partitionId() << 40

        def rows(done: list[list[tuple]]) -> pa.RecordBatch:
            nonlocal sequence
            out = []
            for bin_ in done:
                offset = 0
                for doc_id, start, ids, n in bin_:
                    out.append((doc_id, start, len(ids) // 4, ids, n, sequence, offset))
                    offset += len(ids) // 4
                sequence += 1
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 7, types)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc_id, tokens.encode(text.as_py() or "") + end)
                if len(packer.closed) >= 4096:
                    yield rows(packer.drain())
        packer.finish()
        yield rows(packer.drain())

    return df.select("doc_id", "text").mapInArrow(run, schema)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(load(spark, sf_dir, "documents")))


QUERIES = {"op8_packing": op8_packing}
ORACLE_SQL: dict[str, str] = {}
