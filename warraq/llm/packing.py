"""Best-fit packing of token sequences into rows of a fixed length.

Bounded-space online best-fit: each task holds at most `open_bins` open bins.  A bitset has a bit for each
amount of free space that some open bin has, so the tightest bin that takes a piece is the lowest set bit
at or above its length.  A piece gets its bin and offset when it comes, so nothing but the open bins is
held; if one bin too many opens, the fullest closes.  Pieces come through a window of `window` pieces in
order of falling length, which leaves fewer gaps than their order of arrival does.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.llm._common import require, short_batches
from warraq.llm.bpe import default_tokenizer, encoder

CAPACITY, OPEN_BINS, WINDOW = 1024, 65_536, 65_536


class OpenBins:
    """Open bins by their free space; ids are counted from `first`."""

    def __init__(self, capacity: int, limit: int, first: int = 0):
        self.capacity, self.limit, self.next_id, self.count = capacity, limit, first, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0

    def _take(self, free: int) -> int:
        bin_id = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits ^= 1 << free
        self.count -= 1
        return bin_id

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of this length."""
        if length >= self.capacity:
            self.next_id += 1
            return self.next_id - 1, 0
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_id = self._take(free)
        else:
            free, bin_id = self.capacity, self.next_id
            self.next_id += 1
            if self.count >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
        rest = free - length
        if rest:
            self.by_free[rest].append(bin_id)
            self.bits |= 1 << rest
            self.count += 1
        return bin_id, self.capacity - free


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n tokens: only the first may be shorter than the capacity."""
    full, rest = divmod(n, capacity)
    return [rest] * (rest > 0) + [capacity] * full


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 2) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every whole text: its ids, then end_id, cut to the capacity."""
    require(docs, id_col, text_col)
    path = tokenizer or default_tokenizer()
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for r, t in enumerate(batch.column(1)):
                raw = np.append(e.encode(t.as_py() or ""), np.uint32(end_id)).astype("<u4").tobytes()
                at = 0
                for k, n in enumerate(cut_lengths(len(raw) // 4, capacity)):
                    row.append(r)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
                    at += n
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["id", "piece", "start", "length", "ids_crc32"])

    out = short_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type.simpleString()}, piece int, start long, length long, ids_crc32 long")
    return out.withColumnRenamed("id", id_col)


def best_fit(items: DataFrame, key_cols: list[str], length_col: str = "length", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, window: int = WINDOW) -> DataFrame:
    """items with (sequence_id long, offset long); lengths must be from 1 to the capacity.

    Only these small rows are shuffled, to partitions of the advised size, as fewer tasks leave fewer bins half
    full; each task numbers its sequences from its
    own partition id times 2^40.  Rows are sorted by their keys in a task, so a task that runs again gives
    the same places.
    """
    columns = [c for c in items.columns if c not in ("sequence_id", "offset")]
    at = columns.index(length_col)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins = OpenBins(capacity, open_bins, TaskContext.get().partitionId() << 40)
        held: list[pd.DataFrame] = []

        def placed() -> pd.DataFrame:
            part = pd.concat(held)
            part = part.iloc[np.argsort(-part.iloc[:, at].to_numpy(), kind="stable")]
            where = np.array([bins.place(n) for n in part.iloc[:, at].tolist()], dtype=np.int64).reshape(-1, 2)
            return part.assign(sequence_id=where[:, 0], offset=where[:, 1])

        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) >= window:
                yield placed()
                held = []
        if held:
            yield placed()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.select(columns).schema)
    dealt = items.select(columns).hint("rebalance", *map(F.col, key_cols)).sortWithinPartitions(F.xxhash64(*key_cols), *key_cols)
    return dealt.mapInPandas(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, end_id: int = 2) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts give one piece of one token (end_id); repeated rows are packed each; a text longer
    than the capacity is cut, its first piece taking the remainder; an empty table gives no rows; other
    columns of docs don't pass.
    """
    return best_fit(pieces(docs, id_col, text_col, tokenizer, capacity, end_id), [id_col, "piece"], "length", capacity, open_bins)
