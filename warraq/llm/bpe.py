"""Byte-level BPE encoding and decoding, exact on texts of any length.

A text is cut where no pre-token can span (a non-space ASCII character followed by a blank).  A stretch
without such a place may hold one pre-token of unlimited length, for which merging in one go costs more
than its length.  There the two halves are encoded on their own (all leaves of the tree as one parallel
batch) and joined: tokens in a growing window around the join are encoded again until the token pairs on
both edges of the window encode to themselves.  A token sequence in which each adjacent pair encodes to
itself is the encoding of its text, so the join equals one encoding of the whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.llm._common import require, short_batches

#: Characters of a piece of text that is encoded in one go.
LEAF_CHARS = 1 << 14
#: Code points from here on go to the slower library: its Unicode tables decide, and they may be of another version.
PLAIN_BELOW = 0x0250
_NOT_PLAIN = re.compile(f"[^\x00-{chr(PLAIN_BELOW - 1)}‐-‧€]")
_SAFE_CUT = re.compile(r"(?<=[A-Za-z0-9.,;:!?])[ \n](?=[A-Za-z0-9])")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte, by the public byte-level rule."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class ByteBpe:
    """An exact encoder for one tokenizer file; fast where the file's ranks are its ids."""

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS):
        from tokenizers import Tokenizer

        self.leaf_chars = leaf_chars
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bare = Tokenizer(self.whole.model)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.text_of = {i: t for t, i in vocab.items()}
        self.fast = self._ranked(vocab, merges)

    def _ranked(self, vocab: dict, merges: list):
        """The same vocabulary by ranks, or None if ids don't follow the order of merges."""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
            return None
        import public_tokenizers
        import tiktoken

        to_byte = {c: b for b, c in enumerate(_byte_alphabet())}
        own = {bytes(map(to_byte.__getitem__, t)): i for t, i in vocab.items() if t not in self.special}
        return tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens=self.special)

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text as unsigned 32-bit integers."""
        if len(text) <= self.leaf_chars:
            return self._leaf(text)
        parts = [self._leaf(x) if len(x) <= 2 * self.leaf_chars else self._unsplit(x) for x in self._stretches(text)]
        return np.concatenate(parts)

    def _stretches(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > self.leaf_chars:
            cut = _SAFE_CUT.search(text, start + self.leaf_chars)
            if not cut:
                break
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]

    def _leaf(self, text: str) -> np.ndarray:
        if self.fast is None or _NOT_PLAIN.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), dtype=np.uint32)

    def _unsplit(self, text: str) -> np.ndarray:
        """A long stretch without a safe cut: its pre-tokens one by one, long ones by tree concatenation."""
        ids: list[int] = []
        marks = sorted(self.special, key=len, reverse=True)
        pieces = re.split("(" + "|".join(map(re.escape, marks)) + ")", text) if marks else [text]
        for piece in pieces:
            if piece in self.special:
                ids.append(self.special[piece])
                continue
            words = [w for w, _ in self.whole.pre_tokenizer.pre_tokenize_str(piece)]
            short = iter(self._encode_bare([w for w in words if len(w) <= self.leaf_chars]))
            for w in words:
                ids.extend(next(short) if len(w) <= self.leaf_chars else self.tree(w))
        return np.array(ids, dtype=np.uint32)

    def _encode_bare(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.bare.encode_batch_fast(words, add_special_tokens=False)]

    def tree(self, word: str) -> list[int]:
        """One pre-token in the byte alphabet: leaves in parallel, then joins level by level."""
        level = self._encode_bare([word[i : i + self.leaf_chars] for i in range(0, len(word), self.leaf_chars)])
        while len(level) > 1:
            joined = [self.join(a, b) for a, b in zip(level[::2], level[1::2], strict=False)]
            level = joined + level[len(level) - len(level) % 2 :]
        return level[0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        width = 2
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            inner = self._encode_bare(["".join(map(self.text_of.__getitem__, left[a:] + right[:b]))])[0]
            if (a == 0 or self._fits(left[a - 1], inner[0])) and (b == len(right) or self._fits(inner[-1], right[b])):
                return left[:a] + inner + right[b:]
            width *= 2

    def _fits(self, x: int, y: int) -> bool:
        return self._encode_bare([self.text_of[x] + self.text_of[y]])[0] == [x, y]

    def decode(self, ids: np.ndarray) -> str:
        if self.fast is None:
            return self.whole.decode(ids.tolist(), skip_special_tokens=False)
        return self.fast.decode_bytes(ids.tolist()).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str, leaf_chars: int = LEAF_CHARS) -> ByteBpe:
    """One encoder for each Python worker and file."""
    return ByteBpe(path, leaf_chars)


def encode_documents(docs: DataFrame, tokenizer: str | None = None, text_col: str = "text", out_col: str = "ids", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """docs with an array<int> column of token ids for each whole text.

    Null text counts as empty and gives an empty array; repeated rows stay; every other column passes
    unchanged, but for one already named like out_col, which is replaced.
    """
    require(docs, text_col)
    path = tokenizer or default_tokenizer()
    kept = docs.drop(out_col) if out_col != text_col else docs

    @F.pandas_udf("array<int>")
    def ids(texts):
        import pandas as pd

        e = encoder(path, leaf_chars)
        return pd.Series([e.encode(t or "").astype(np.int32) for t in texts])

    return kept.withColumn(out_col, ids(F.col(text_col)))


def decode_documents(encoded: DataFrame, tokenizer: str | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The inverse: text for an array of ids (special tokens kept, null gives an empty text)."""
    require(encoded, ids_col)
    path = tokenizer or default_tokenizer()

    @F.pandas_udf("string")
    def text(rows):
        import pandas as pd

        e = encoder(path)
        return pd.Series([e.decode(np.asarray([] if r is None else r, dtype=np.uint32)) for r in rows])

    return encoded.withColumn(out_col, text(F.col(ids_col)))


def round_trip_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each whole text, encoded and decoded in one pass.

    Only the digests leave the Python worker, so memory is bounded by one Arrow batch and the ids of one text.
    """
    require(docs, id_col, text_col)
    path = tokenizer or default_tokenizer()
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column(1):
                ids = e.encode(t.as_py() or "")
                n.append(len(ids))
                a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                b.append(hashlib.sha256(e.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = short_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
