"""Questions of document batches to a hash-partitioned corpus, without a row for each key.

Documents are dealt into batches by a hash of their id; a batch is a few compressed blobs.  A batch asks
about its distinct keys: they are cut into buckets by their leading bits and each bucket's keys travel as
one packed array.  A bucket sorts the keys of all batches and answers each batch with one packed array in
the order of its question.  A key thus meets at most once per batch, however many documents hold it, so no
task gets more than (batches x 1) entries for the most frequent key, and answers need no keys.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warraq.llm._common import input_bytes, require, short_batches

BATCH_BYTES, BUCKET_BYTES = 4 << 20, 12 << 20
#: Text that a task holds before it packs it, so that a blob has more than a few documents.
HELD_BYTES = 16 << 20
#: Text of a task; the number of tasks follows the input, so none reads more as it grows.
TASK_BYTES = 24 << 20
#: Text bytes for each byte of a compressed columnar file, for the number of batches.
EXPANSION = 2

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits (the public splitmix64 finaliser)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PrefixHash:
    """Polynomial prefix sums modulo 2^64, for the hash of any byte range of a buffer."""

    BASE = 0xD1342543DE82EF95
    _up = np.ones(1, np.uint64)
    _down = np.ones(1, np.uint64)

    @classmethod
    def _powers(cls, n: int) -> None:
        if len(cls._up) < n:
            size = max(n, 1 << 16)
            for name, base in (("_up", cls.BASE), ("_down", pow(cls.BASE, -1, 1 << 64))):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                setattr(cls, name, np.multiply.accumulate(p))

    def __init__(self, raw: np.ndarray):
        self._powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self._up[: len(raw)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self._down[start] + (end - start).astype(np.uint64) * _ODD)

    def fixed(self, length: int) -> np.ndarray:
        """The hash of each range of this length."""
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self._down[:n] + np.uint64(length * int(_ODD) & (1 << 64) - 1)) if n > 0 else np.empty(0, np.uint64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length, each byte plane by itself, compressed."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(raw: bytes, *kinds: str) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(data) // sum(widths), [], 0
    for k, w in zip(kinds, widths, strict=True):
        out.append(np.ascontiguousarray(data[at : at + n * w].reshape(w, n).T).view(k).reshape(n))
        at += n * w
    return out


def sizes(docs: DataFrame, batch_bytes: int = BATCH_BYTES) -> tuple[int, int]:
    """(number of batches, number of buckets) for this input."""
    total = EXPANSION * input_bytes(docs)
    return max(1, -(-total // batch_bytes)), max(1, -(-total // BUCKET_BYTES))


def tasks_for(docs: DataFrame) -> int:
    """Tasks of a step over all texts: so many that each has TASK_BYTES of them at any size, and all cores have work."""
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-EXPANSION * input_bytes(docs) // TASK_BYTES))


def dealt_to(n_batches: int, id_col: str, text_col: str) -> Column:
    """The batch of a row: by its id, or by its text where it has none."""
    return F.pmod(F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col).cast("long"))).otherwise(F.xxhash64(F.col(text_col).cast("string"))), F.lit(n_batches))


def batches(docs: DataFrame, n_batches: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(b long, blob binary): documents of each batch; null ids stay null, null texts are empty."""
    require(docs, id_col, text_col)
    rows = short_batches(docs).select(dealt_to(n_batches, id_col, text_col).alias("b"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        held: list[tuple[int, int | None, bytes]] = []

        def blobs() -> pa.RecordBatch:
            by: dict[int, list[tuple[int | None, bytes]]] = {}
            for b, i, raw in held:
                by.setdefault(b, []).append((i, raw))
            packed = [press.compress(np.array([len(part), *(i or 0 for i, _ in part), *(len(raw) for _, raw in part)], "<i8").tobytes() + bytes(i is None for i, _ in part) + b"".join(raw for _, raw in part)) for part in by.values()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(by), pa.int64()), pa.array(packed, pa.binary())], names=["b", "blob"])

        size = 0
        for frame in frames:
            for b, i, text in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), frame.column(2), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "replace")
                held.append((b, i, raw))
                size += len(raw)
            if size >= HELD_BYTES:
                yield blobs()
                size = 0
        if held:
            yield blobs()

    return rows.mapInArrow(run, "b long, blob binary")


class Batch:
    """Documents of one batch, sorted by id and text: ids, whether they are null (those come first), texts.

    A null id counts as the least number where places are compared; named() gives the ids as they were.
    """

    def __init__(self, blobs) -> None:
        found: list[tuple[bool, int, bytes]] = []
        for blob in blobs:
            raw = zstandard.ZstdDecompressor().decompress(blob)
            n = int.from_bytes(raw[:8], "little")
            head = np.frombuffer(raw, "<i8", 2 * n, 8)
            at = 8 + 17 * n
            for i, length, none in zip(head[:n].tolist(), head[n:].tolist(), raw[at - n : at], strict=True):
                found.append((not none, np.iinfo(np.int64).min if none else i, raw[at : at + length]))
                at += length
        found.sort()
        self.null = np.array([not known for known, _, _ in found], bool)
        self.ids = np.array([i for _, i, _ in found], np.int64)
        self.texts = [t for _, _, t in found]

    def named(self) -> pd.arrays.IntegerArray:
        return pd.arrays.IntegerArray(self.ids, self.null)

    def chunks(self, size: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first document, offsets of each document and the end, bytes) of about this many bytes; a text that is
        longer comes by itself."""

        def joined(first: int, end: int) -> tuple[int, np.ndarray, np.ndarray]:
            part = self.texts[first:end]
            return first, np.concatenate(([0], np.cumsum([len(x) for x in part]))).astype(np.int64), np.frombuffer(b"".join(part), np.uint8)

        first = total = 0
        for k, t in enumerate(self.texts):
            if k > first and total + len(t) > size:
                yield joined(first, k)
                first, total = k, 0
            total += len(t)
        if first < len(self.texts):
            yield joined(first, len(self.texts))


class Question:
    """Distinct sorted keys of a batch, in buckets by their leading bits."""

    def __init__(self, kind: int, keys: np.ndarray, n_buckets: int, *extra: np.ndarray):
        self.kind, self.keys, self.extra = kind, keys, extra
        self.bucket = ((keys >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
        self.cuts = np.concatenate(([0], np.flatnonzero(np.diff(self.bucket)) + 1, [len(keys)])) if len(keys) else np.zeros(1, np.int64)

    def rows(self, b: int) -> list[tuple]:
        spans = zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist(), strict=True)
        return [(int(self.bucket[s]), b, self.kind, pack(np.diff(self.keys[s:e], prepend=np.uint64(0)), *(x[s:e] for x in self.extra))) for s, e in spans]

    def answer(self, answers: pd.DataFrame, dtype: str | tuple[str, ...]) -> np.ndarray:
        """The answers in the order of keys; dtype 'bits' for packed booleans, a tuple for several columns."""
        own = answers[answers.kind == self.kind]
        by = dict(zip(own.bucket.tolist(), own.payload.tolist(), strict=True))
        spans = list(zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist(), strict=True))
        if isinstance(dtype, tuple):
            return np.concatenate([np.empty((0, len(dtype)), dtype[0]), *(np.column_stack(unpack(by[int(self.bucket[s])], *dtype)) for s, _ in spans)])
        parts = []
        for s, e in spans:
            raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(by[int(self.bucket[s])]), np.uint8)
            parts.append(np.unpackbits(raw, count=e - s).astype(bool) if dtype == "bits" else raw.view(dtype))
        return np.concatenate(parts) if parts else np.empty(0, bool if dtype == "bits" else dtype)


QUESTIONS, ANSWERS = "bucket long, b long, kind int, payload binary", "b long, bucket long, kind int, payload binary"


def question_frame(b: int, questions: list[Question]) -> pd.DataFrame:
    return pd.DataFrame([r for q in questions for r in q.rows(b)], columns=["bucket", "b", "kind", "payload"])


def answered(questions: DataFrame, kinds: dict[int, tuple[tuple[str, ...], Callable[..., np.ndarray]] | None], n_tasks: int) -> DataFrame:
    """Answers of each bucket: kinds[k] = (types of the packed arrays, function of the joined arrays).

    The function gets the arrays of all batches end to end and returns an answer for each entry: a boolean
    (packed to bits), a number or a row of numbers.  None passes rows on as they are: notes of a batch to itself.
    """

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        if kinds[key[1]] is None:
            return part[["b", "bucket", "kind", "payload"]]
        types, work = kinds[key[1]]
        arrays = [unpack(p, *types) for p in part.payload]
        for a in arrays:
            a[0] = np.cumsum(a[0], dtype=np.uint64)  # keys travel as the steps between them
        lengths = np.array([len(a[0]) for a in arrays])
        found = work(*(np.concatenate(x) for x in zip(*arrays, strict=True)))
        press, out = zstandard.ZstdCompressor(level=1), []
        for piece in np.split(found, np.cumsum(lengths)[:-1]):
            out.append(pack(*piece.T) if piece.ndim == 2 else press.compress(np.packbits(piece).tobytes() if piece.dtype == bool else piece.tobytes()))
        return pd.DataFrame({"b": part.b, "bucket": key[0], "kind": key[1], "payload": out})

    return questions.repartition(n_tasks, "bucket", "kind").groupBy("bucket", "kind").applyInPandas(run, ANSWERS)


def note(b: int, kind: int, what: object) -> pd.DataFrame:
    """A row by which a batch tells itself something for a later step."""
    return pd.DataFrame({"bucket": [b], "b": [b], "kind": [kind], "payload": [zstandard.ZstdCompressor(level=1).compress(pickle.dumps(what))]})


def noted(answers: pd.DataFrame, kind: int) -> list:
    """What a batch told itself."""
    return [pickle.loads(zstandard.ZstdDecompressor().decompress(p)) for p in answers.payload[answers.kind == kind]]


def is_first(keys: np.ndarray, docs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each entry, whether no entry of the same key has a smaller (document, place)."""
    order = np.lexsort((places, docs, keys))
    first = np.ones(len(keys), bool)
    first[1:] = np.diff(keys[order]) != 0
    out = np.empty(len(keys), bool)
    out[order] = first
    return out


def has_variants(keys: np.ndarray, contents: np.ndarray) -> np.ndarray:
    """For each entry, whether its key has two contents, or one entry (content 0) that stands for several."""
    order = np.argsort(keys, kind="stable")
    k, c = keys[order], contents[order]
    starts = np.flatnonzero(np.concatenate(([True], np.diff(k) != 0)))
    low, high = np.minimum.reduceat(c, starts), np.maximum.reduceat(c, starts)
    many = np.repeat((low != high) | (low == 0), np.diff(np.concatenate((starts, [len(k)]))))
    out = np.empty(len(keys), bool)
    out[order] = many
    return out
