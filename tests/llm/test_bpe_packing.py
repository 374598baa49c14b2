import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from warraq.llm import bpe, packing

PATH = bpe.default_tokenizer()


def exact(text):
    return bpe.encoder(PATH).whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("leaf", [8, 64])
def test_tree_concatenation_equals_one_encoding(leaf):
    e, rng = bpe.ByteBpe(PATH, leaf), random.Random(leaf)
    for alphabet in ("ab", "abethinor", "é中a 1", " \n", "aaab", "<|endoftext|>x "):
        for n in (0, 1, 9, 300, 2000):
            text = "".join(rng.choice(alphabet) for _ in range(n)) + ("<|endoftext|>" if n % 2 else "")
            assert e.encode(text).tolist() == exact(text)
            assert e.decode(e.encode(text)) == text


def test_fast_ranks_agree_on_all_plain_code_points():
    e = bpe.encoder(PATH)
    for c in range(bpe.PLAIN_BELOW):
        text = f"a{chr(c)}b {chr(c)} 1{chr(c)}1 {chr(c)}{chr(c)}  {chr(c)}'s"
        assert e.fast.encode(text, allowed_special="all") == exact(text), hex(c)


def test_digests_of_odd_texts(odd):
    rows = bpe.round_trip_digests(odd).collect()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    assert len(rows) == odd.count()
    for r in rows:
        ids = exact(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_encode_and_decode_columns(odd, empty):
    back = bpe.decode_documents(bpe.encode_documents(odd))
    assert all((r.text or "") == r.decoded for r in back.collect())
    assert bpe.round_trip_digests(empty).count() == 0


def check_sequences(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_of_odd_texts(odd, empty):
    rows = packing.pack_documents(odd).collect()
    check_sequences(rows, 1024)
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for doc, parts in by.items():
        ids = [*exact(texts[doc]), 2] * (2 if doc == 9 else 1)
        assert sum(p.length for p in parts) == len(ids)
        if doc != 9:
            for p in parts:
                assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
                assert p.length == 1024 or p.piece == 0
    assert packing.pack_documents(empty).count() == 0


def test_few_sequences(spark):
    rng = random.Random(1)
    lengths = [rng.randint(1, 1024) for _ in range(5000)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "k long, length long").coalesce(1)
    used = check_sequences(packing.best_fit(df, ["k"]).collect(), 1024)
    assert used <= -(-sum(lengths) // 1024) * 1.03 + 8


def test_a_full_shelf_closes_its_fullest_bin():
    bins = packing.OpenBins(10, 2)
    assert bins.place(6) == (0, 0) and bins.place(7) == (1, 0)
    assert bins.place(8) == (2, 0)  # the bin with 7 closes
    assert bins.place(3) == (0, 6) and bins.place(2) == (2, 8)
    assert bins.place(10) == (3, 0)
