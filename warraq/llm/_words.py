"""Words of a buffer of whole texts as arrays: places and hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from warraq.llm._exchange import Batch, PrefixHash, mix

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.uint64(0xA24BAED4963EE407)


#: Bytes that are hashed at once; a longer text goes in parts.
PART = 1 << 20
#: Words of so many bytes have a hash of another kind, as prefix sums modulo 2^64 know pairs of strings of 1024 letters apart by nothing.
LONG_WORD = 512


def words_of(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words before each document and in all); a word: `[^\\x20\\x09-\\x0D]+`."""
    if not len(raw):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    ink = ~_BLANK[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    start = ink.copy()
    start[1:] &= ~ink[:-1] | edge[1:-1]
    end = ink.copy()
    end[:-1] &= ~ink[1:] | edge[1:-1]
    begin, after = np.flatnonzero(start), np.flatnonzero(end) + 1
    hashes, k = np.empty(len(begin), np.uint64), 0
    while k < len(begin):
        last = max(k + 1, int(np.searchsorted(after, begin[k] + PART, side="right")))
        low = begin[k]
        hashes[k:last] = PrefixHash(raw[low : after[last - 1]]).ranges(begin[k:last] - low, after[k:last] - low)
        for i in np.flatnonzero(after[k:last] - begin[k:last] >= LONG_WORD) + k:
            hashes[i] = xxhash.xxh3_64_intdigest(raw[begin[i] : after[i]])
        k = last
    return hashes, np.searchsorted(begin, offsets)


def batch_words(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the batch, and the first word of each document and the end."""
    hashes, cuts, n = [np.empty(0, np.uint64)], [np.zeros(1, np.int64)], 0
    for _, offsets, raw in batch.chunks():
        h, c = words_of(offsets, raw)
        hashes.append(h)
        cuts.append(c[1:] + n)
        n += len(h)
    return np.concatenate(hashes), np.concatenate(cuts)


def longer(grams: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of n-grams one word longer: grams[i] ends at word i, the result at index i + 1 (index 0 is void)."""
    out = np.zeros(len(words), np.uint64)
    out[1:] = mix(grams[:-1] * _STEP + words[1:])
    return out


def gram_hashes(words: np.ndarray, order: int) -> list[np.ndarray]:
    """For n from 1 to order: the hash of the n-gram that ends at each word (void before word n - 1)."""
    out = [words]
    while len(out) < order:
        out.append(longer(out[-1], words))
    return out
