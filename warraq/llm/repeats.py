"""Exact removal of repeated byte strings by depth-limited radix passes over suffixes.

Only the first `threshold` bytes of suffixes are ordered, by digits from the most significant one on; a
suffix leaves as soon as its group holds no other.  Digits are hashes of parts of that prefix:

1. the anchor, the k bytes with the smallest hash in the prefix.  Neighbouring suffixes share anchors, so
   one entry stands for a run of them;
2. the whole text that the suffixes of a run cover.  Equal runs settle all of their suffixes at once;
3. the full prefix of the suffixes of those runs alone whose anchor also occurs in other surroundings.

Groups that are equal after the last digit are exactly the repeated windows; each keeps its first place.
Anchors are chosen by content, so equal windows always have equal digits and none is missed.  Digits are
64 bits wide: a false match needs two different windows of one anchor with equal hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

from warraq.llm._exchange import ANSWERS, QUESTIONS, Batch, PrefixHash, Question, answered, batches, has_variants, is_first, mix, question_frame, sizes, tasks_for

THRESHOLD, ANCHOR = 100, 32
_PLACE_BITS = 24
#: Bytes that are digested at once, whose prefix sums take some 40 times their size; a longer text goes in parts.
PART = 1 << 18
_ANCHORS, _RUNS, _WINDOWS = 0, 1, 2


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbouring values, by doubling."""
    span, low = 1, x
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def runs_of(offsets: np.ndarray, raw: np.ndarray, threshold: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(document, first window's start, number of windows, anchor digit, run digit) of each run in a chunk."""
    empty = np.empty(0, np.int64)
    if len(raw) < threshold:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    prefix = PrefixHash(raw)
    digit = prefix.fixed(anchor)
    place_bits = max(_PLACE_BITS, int(len(digit)).bit_length())
    at = np.arange(len(digit), dtype=np.uint64)
    least = sliding_minimum(mix(digit ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(place_bits) << np.uint64(place_bits) | at, threshold - anchor + 1)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    starts = np.flatnonzero(np.arange(len(least)) + threshold <= offsets[owner + 1])
    if not len(starts):
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    spot = (least[starts] & np.uint64((1 << place_bits) - 1)).astype(np.int64)
    new = np.concatenate(([True], (np.diff(spot) != 0) | (np.diff(starts) != 1)))
    begin, head = starts[new], np.flatnonzero(new)
    count = np.diff(np.concatenate((head, [len(starts)])))
    content = prefix.ranges(begin, begin + count - 1 + threshold)
    doc = owner[begin]
    return doc, begin - offsets[doc], count, digit[spot[new]], content


def runs_in_parts(offsets: np.ndarray, raw: np.ndarray, threshold: int, anchor: int, part: int = PART) -> Iterator[tuple[np.ndarray, ...]]:
    """runs_of() a chunk, a long text in overlapping parts; a run that a part cuts becomes two, with the same windows."""
    if len(offsets) != 2 or len(raw) <= 2 * part:
        yield runs_of(offsets, raw, threshold, anchor)
        return
    for low in range(0, len(raw) - threshold + 1, part):
        piece = raw[low : low + part + threshold - 1]
        doc, start, *rest = runs_of(np.array([0, len(piece)]), piece, threshold, anchor)
        yield doc, start + low, *rest


class Suffixes:
    """Runs of a batch, and what the passes have settled about them."""

    def __init__(self, batch: Batch, n_buckets: int, threshold: int, anchor: int, part: int = PART):
        self.batch, self.n_buckets, self.threshold = batch, n_buckets, threshold
        parts = []
        for first, offsets, raw in batch.chunks(part):
            for doc, start, count, digit, content in runs_in_parts(offsets, raw, threshold, anchor, part):
                parts.append((doc + first, start, count, digit, content))
        empty = [np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64)] * 2
        self.doc, self.start, self.count, self.anchor, content = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else empty
        self.content = mix(content ^ self.anchor) | np.uint64(1)

    def first_questions(self) -> list[Question]:
        anchors, at = np.unique(self.anchor, return_index=True)
        group = np.searchsorted(anchors, self.anchor)
        many = np.zeros(len(anchors), bool)
        np.logical_or.at(many, group, self.content != self.content[at][group])
        contents = np.where(many, np.uint64(0), self.content[at])
        self._group, self._many = group, many
        # runs stand in order of document and start, so the first index of a content is its first place
        runs, self.first_run, self.run_of = np.unique(self.content, return_index=True, return_inverse=True)
        return [Question(_ANCHORS, anchors, self.n_buckets, contents), Question(_RUNS, runs, self.n_buckets, self.batch.ids[self.doc[self.first_run]], self.start[self.first_run].astype(np.uint32))]

    def settle_runs(self, answers: pd.DataFrame) -> None:
        """self.repeated: runs that repeat an earlier run; self.open: first runs whose anchor has other surroundings."""
        anchors, runs = self.first_questions()
        first = runs.answer(answers, "bits")
        holds_first = np.zeros(len(self.doc), bool)
        holds_first[self.first_run] = first
        self.repeated = ~holds_first
        self.open = holds_first & anchors.answer(answers, "bits")[self._group]

    def window_question(self) -> Question:
        """Distinct windows of the open runs with their first place in the batch."""
        runs = np.flatnonzero(self.open)
        keys, at = [], []
        for lo in range(0, len(runs), 1 << 14):
            part = runs[lo : lo + (1 << 14)]
            pieces = [self.batch.texts[d][s : s + c - 1 + self.threshold] for d, s, c in zip(self.doc[part].tolist(), self.start[part].tolist(), self.count[part].tolist(), strict=True)]
            ends = np.cumsum([len(p) for p in pieces])
            inner = np.repeat(ends - [len(p) for p in pieces] - np.concatenate(([0], np.cumsum(self.count[part])[:-1])), self.count[part])
            keys.append(PrefixHash(np.frombuffer(b"".join(pieces), np.uint8)).fixed(self.threshold)[np.arange(len(inner)) + inner])
        self.window_run = np.repeat(runs, self.count[runs])
        offset = np.arange(len(self.window_run)) - np.repeat(np.concatenate(([0], np.cumsum(self.count[runs])[:-1])), self.count[runs]) if len(runs) else np.empty(0, np.int64)
        self.window_start = self.start[self.window_run] + offset
        every = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        windows, self.first_window = np.unique(every, return_index=True)
        w = self.first_window
        return Question(_WINDOWS, windows, self.n_buckets, self.batch.ids[self.doc[self.window_run[w]]], self.window_start[w].astype(np.uint32))

    def repeated_windows(self, answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """(document, first byte, byte after the last) of text covered by repeated windows, as sorted ranges."""
        question = self.window_question()
        again = np.ones(len(self.window_run), bool)
        again[self.first_window] = ~question.answer(answers, "bits")
        runs = np.flatnonzero(self.repeated)
        doc = np.concatenate((self.doc[runs], self.doc[self.window_run[again]]))
        low = np.concatenate((self.start[runs], self.window_start[again]))
        high = np.concatenate((self.start[runs] + self.count[runs] - 1, self.window_start[again])) + self.threshold
        order = np.lexsort((low, doc))
        return doc[order], low[order], high[order]


def merged(low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of ranges sorted by their first byte."""
    out: list[list[int]] = []
    for a, b in zip(low.tolist(), high.tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_KINDS = {
    _ANCHORS: (("u8", "u8"), has_variants),
    _RUNS: (("u8", "i8", "u4"), is_first),
    _WINDOWS: (("u8", "i8", "u4"), is_first),
}


def repeated_spans(docs: DataFrame, output, schema: str, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, anchor: int = ANCHOR) -> DataFrame:
    """output(id, text as bytes, [(first, after last)]) -> a row of schema, for each document.

    Null texts count as empty; a null id stays null and comes before all others.  Rows that repeat an id are documents of their own, ordered by their text.
    Whole documents are shuffled once, compressed; an exchange that several passes read is reused.
    """
    n_batches, n_buckets = sizes(docs)
    n_tasks = tasks_for(docs)
    dealt = batches(docs, n_batches, id_col, text_col).repartition(n_tasks, "b")
    names = [f.split()[0] for f in schema.split(", ")]

    def ask_first(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return question_frame(key[0], Suffixes(Batch(part.blob), n_buckets, threshold, anchor).first_questions())

    def ask_windows(part: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        s = Suffixes(Batch(part.blob), n_buckets, threshold, anchor)
        s.settle_runs(answers)
        return question_frame(int(part.b.iloc[0]), [s.window_question()])

    def finish(part: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        batch = Batch(part.blob)
        s = Suffixes(batch, n_buckets, threshold, anchor)
        s.settle_runs(answers)
        doc, low, high = s.repeated_windows(answers)
        cuts = np.searchsorted(doc, np.arange(len(batch.ids) + 1))
        rows = [output(i, t, merged(low[cuts[k] : cuts[k + 1]], high[cuts[k] : cuts[k + 1]])) for k, (i, t) in enumerate(zip(batch.ids.tolist(), batch.texts, strict=True))]
        out = pd.DataFrame(rows, columns=names)
        out[names[0]] = batch.named()
        return out

    by_batch = dealt.groupBy("b")
    runs = answered(by_batch.applyInPandas(ask_first, QUESTIONS), _KINDS, n_tasks).repartition(n_tasks, "b")
    windows = answered(by_batch.cogroup(runs.groupBy("b")).applyInPandas(ask_windows, QUESTIONS), _KINDS, n_tasks).repartition(n_tasks, "b")
    return by_batch.cogroup(runs.unionByName(windows).groupBy("b")).applyInPandas(finish, schema)


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def span_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of each document."""

    def output(i: int, text: bytes, spans: list[tuple[int, int]]) -> tuple:
        return i, len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept_bytes(text, spans)).hexdigest()

    return repeated_spans(docs, output, f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", id_col, text_col)


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shrunk to whole UTF-8 characters, so that what is left stays valid text."""
    out = []
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def cleaned_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text without its repeated byte strings, before: xxhash64 of the whole text) of each document.

    Rows that repeat an id with other texts are told apart by `before`, which Spark's xxhash64 gives as well.
    """

    def output(i: int, text: bytes, spans: list[tuple[int, int]]) -> tuple:
        return i, kept_bytes(text, whole_characters(text, spans)).decode("utf-8", "replace"), int(np.uint64(xxhash.xxh64_intdigest(text, 42)).view(np.int64))

    return repeated_spans(docs, output, f"{id_col} long, {text_col} string, before long", id_col, text_col)


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<start, end>>) in bytes of each document, for callers that cut by themselves."""

    def output(i: int, text: bytes, spans: list[tuple[int, int]]) -> tuple:
        return i, [[a, b] for a, b in spans]

    return repeated_spans(docs, output, f"{id_col} long, spans array<array<bigint>>", id_col, text_col)
