"""Best-fit packing of token sequences: bounded-space online best-fit.

Documents are cut into pieces (only those over the capacity; the first piece takes the remainder), and each piece goes
to the open bin with the least free space that still holds it. The open bins are a bitset keyed by free space: bit f is
set where some open bin has f tokens left, so the best bin is the lowest set bit at or above the piece's length. At
most `open_bins` bins are open; when one more is needed, the fullest closes first.

Distribution. Ids are made once, in the scan; only (id, piece, start, length, checksum) rows are shuffled, by the hash
of the id, to tasks of about `rows_per_task` rows. Within a task the rows arrive longest first, so that what is left
open at its end is one bin or so; tasks share nothing, so a lost one is redone alone with the same result.

Defined results: null and empty texts are one piece, the end mark alone. Null ids are kept as null. Rows that repeat an
id are packed like any others. No rows give no rows. Other input columns are dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, documents

CAPACITY, END_ID = 1024, 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


class BestFit:
    """Packs lengths, one after the other, into (bin, offset)."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.count = self.made = 0

    def add(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece has 1 to {self.capacity} tokens, not {length}")
        above = self.bits >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.count >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest has the least free space
            free, bin_ = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            self.by_free[left].append(bin_)
            self.bits |= 1 << left
            self.count += 1
        return bin_, self.capacity - free

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        bin_ = bins.pop()
        self.count -= 1
        if not bins:
            self.bits &= ~(1 << free)
        return bin_


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
    capacity: int = CAPACITY, end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokenizer import IdEncoder

        encode, end = None, end_id.to_bytes(4, "little")
        for batch in batches:
            encode = encode or IdEncoder(path)
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = memoryview(encode(text.as_py() or "") + end)
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    out.append((doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(run, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = 4096, rows_per_task: int = 200_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (see token_pieces)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        fit, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            places = [fit.add(n) for n in batch["length"].tolist()]
            yield batch.assign(sequence_id=[base + b for b, _ in places], offset=[o for _, o in places])

    rows = pieces.count()
    tasks = max(1, -(-rows // rows_per_task))
    dealt = pieces.repartition(tasks, F.xxhash64("doc_id", "piece", "ids_crc32"))
    order = [F.desc("length"), "doc_id", "piece", "ids_crc32"]
    return dealt.sortWithinPartitions(*order).mapInPandas(run, PACKED)


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, **limits) -> DataFrame:
    capacity = limits.get("capacity", CAPACITY)
    return pack(checkpointed(token_pieces(df, id_col, text_col, path, capacity)), **limits)


def op8(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
