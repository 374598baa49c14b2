"""Similarity join of documents by the Jaccard index of their word n-grams.

1. Each text becomes the set of its n-gram hashes; texts with equal sets are one node, named by a key of the set.
2. Nodes that agree on a band of MinHash values share a bucket.  Each is compared with the least node of its
   bucket, MinHash values a few at a time: a pair is dropped once the posterior probability (uniform prior) of
   reaching the threshold falls below the tolerance.  What is dropped is compared with the least of what its
   bucket dropped, in a second round, and what a bucket drops twice stays linked without a test, so no similar
   pair ever lies in two components.  Connected components of these links are the areas.
3. An area is cut into blocks, each packed once: its distinct n-grams, and for each set which of them it has, so that
   near copies add little.  Each pair of packed blocks is one task.  There, the same test rules pairs out, and what
   is left is verified on the whole sets.  An area of one block is verified where it is gathered.
4. Tasks return counts of links and spanning links of their components, never all pairs.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import cache, reduce
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.llm._common import require, short_batches
from warraq.llm._exchange import Batch, batches, dealt_to, mix, pack, sizes, tasks_for, unpack
from warraq.llm._words import batch_words, gram_hashes, words_of
from warraq.operators.components import components, cut_lineage

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-7
BANDS, ROWS, STEP = 28, 4, 16
BLOCK, ROUNDS = 400, 2
#: Bytes of whole texts that are signed at once; a longer text comes by itself.
PART = 1 << 18


@cache
def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(29).integers(1 << 62, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def ngram_sets(words: np.ndarray, cuts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each document, sorted, end to end, and where each document begins.

    A text of 1 to n - 1 words has one n-gram, all of its words; a text without words has none.
    """
    grams = gram_hashes(words, n)
    lengths = np.diff(cuts)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(words)) - np.repeat(cuts[:-1], lengths)
    full = place >= n - 1
    short = np.flatnonzero((lengths > 0) & (lengths < n))
    tails = [mix(grams[lengths[d] - 1][cuts[d + 1] - 1 : cuts[d + 1]] + np.uint64(int(lengths[d]))) for d in short]
    keys = np.concatenate([grams[n - 1][full], *tails])
    docs = np.concatenate([owner[full], short])
    order = np.lexsort((keys, docs))
    keys, docs = keys[order], docs[order]
    new = np.ones(len(keys), bool)
    new[1:] = (np.diff(keys) != 0) | (np.diff(docs) != 0)
    return keys[new], np.searchsorted(docs[new], np.arange(len(lengths) + 1))


def minhashes(keys: np.ndarray, cuts: np.ndarray, n: int) -> np.ndarray:
    """[document, function] leading 32 bits of the least value of each function; documents must not be empty."""
    out = np.empty((len(cuts) - 1, n), np.uint32)
    for k, m in enumerate(_multipliers(n)):
        out[:, k] = np.minimum.reduceat(keys * m, cuts[:-1]) >> np.uint64(32)
    return out


def set_keys(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """128 bits that name each set (sets must not be empty), as rows of two numbers."""
    return np.column_stack([np.add.reduceat(mix(keys), starts), np.add.reduceat(mix(keys ^ np.uint64(0x1F83D9ABFB41BD6B)), starts)])


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int, n_batches: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, b, the kept columns as kept0 ..., key, low, bands) of each row: key names its set of n-grams (null if that is empty), low
    holds its MinHash values, bands are keys of groups of them, b is the row's batch."""
    total = bands * rows

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts = [(t.as_py() or "").encode("utf-8", "replace") for t in frame.column(0)]
            ends = np.cumsum([0, *map(len, texts)])
            first = 0
            while first < len(texts):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + PART)))
                last = min(last, len(texts))
                offsets = ends[first : last + 1] - ends[first]
                words, cuts = words_of(offsets, np.frombuffer(b"".join(texts[first:last]), np.uint8))
                keys, at = ngram_sets(words, cuts, n)
                some = np.flatnonzero(np.diff(at))
                name, low, band = (np.full(last - first, None, object) for _ in range(3))
                if len(some):
                    values = minhashes(keys, np.append(at[some], len(keys)), total)
                    key = np.arange(bands, dtype=np.uint64)[None, :] + np.zeros((len(some), 1), np.uint64)
                    for r in range(rows):
                        key = mix(key * np.uint64(0xA24BAED4963EE407) + values.reshape(-1, bands, rows)[:, :, r])
                    for k, own, v, g in zip(some.tolist(), set_keys(keys, at[some]), values, key.view(np.int64), strict=True):
                        name[k], low[k], band[k] = own.tobytes(), v.tobytes(), g
                made = [pa.array(name, pa.binary()), pa.array(low, pa.binary()), pa.array(band, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(c.slice(first, last - first) for c in frame.columns[1:]), *made], names=[*frame.schema.names[1:], "key", "low", "bands"])
                first = last

    rest = short_batches(docs).select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("id"), dealt_to(n_batches, id_col, text_col).alias("b"), *(F.col(c).alias(f"kept{k}") for k, c in enumerate(keep)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields[1:])
    return rest.mapInArrow(run, f"{schema}, key binary, low binary, bands array<long>")


@cache
def least_matches(step: int, total: int, threshold: float, tolerance: float) -> tuple[tuple[int, int], ...]:
    """((values compared, fewest agreements with which a pair stays) ...): P(J >= t | n of m) >= tolerance.

    With a uniform prior the posterior is Beta(n + 1, m - n + 1), whose upper tail at t is the probability of
    at most n successes in m + 1 trials.
    """
    out = []
    for m in range(step, total + 1, step):
        tail, n = 0.0, 0
        while n <= m:
            tail += comb(m + 1, n) * threshold**n * (1 - threshold) ** (m + 1 - n)
            if tail >= tolerance:
                break
            n += 1
        out.append((m, n))
    return tuple(out)


def likely_pairs(x: np.ndarray, y: np.ndarray, same: bool, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that the posterior doesn't rule out (i < j if both sides are the same block)."""
    total = x.shape[1]
    plan = least_matches(STEP, total, threshold, tolerance)
    left, right, agree, done = None, None, None, 0
    for m, fewest in plan:
        if left is None:
            counts = np.zeros((len(x), len(y)), np.int32)
            for k in range(done, m):
                counts += x[:, k][:, None] == y[:, k][None, :]
            left, right = np.nonzero(counts >= fewest)
            if same:
                keep = left < right
                left, right = left[keep], right[keep]
            agree = counts[left, right]
        else:
            for at in range(0, len(left), 1 << 16):
                part = slice(at, at + (1 << 16))
                agree[part] += (x[left[part], done:m] == y[right[part], done:m]).sum(axis=1)
            keep = agree >= fewest
            left, right, agree = left[keep], right[keep], agree[keep]
        done = m
    return left, right


def likely_rows(x: np.ndarray, y: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """For each row, whether the posterior doesn't rule out that x and y are similar."""
    left, agree, done = np.arange(len(x)), np.zeros(len(x), np.int64), 0
    for m, fewest in least_matches(STEP, x.shape[1], threshold, tolerance):
        agree = agree + (x[left, done:m] == y[left, done:m]).sum(axis=1)
        keep = agree >= fewest
        left, agree, done = left[keep], agree[keep], m
    out = np.zeros(len(x), bool)
    out[left] = True
    return out


def likely_links(sets: DataFrame, total: int, threshold: float, tolerance: float) -> DataFrame:
    """(a, b) keys of sets whose components hold both ends of every pair that shares a band and may be similar."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            x, y = (np.frombuffer(b"".join(f.column(c).to_pylist()), np.uint32).reshape(-1, total) for c in (2, 3))
            yield pa.RecordBatch.from_arrays([f.column(0), f.column(1), pa.array(likely_rows(x, y, threshold, tolerance))], names=["a", "b", "ok"])

    low = sets.select("key", "low")
    left = sets.select(F.col("key").alias("a"), F.explode("bands").alias("band"))
    kept = []
    for _ in range(ROUNDS):
        lead = left.groupBy("band").agg(F.min("a").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
        met = cut_lineage(left.join(lead, "band").filter("a <> b"))
        pairs = met.select("a", "b").distinct().join(low.select(F.col("key").alias("a"), F.col("low").alias("x")), "a").join(low.select(F.col("key").alias("b"), F.col("low").alias("y")), "b")
        told = cut_lineage(pairs.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary, ok boolean"))
        kept.append(told.filter("ok").select("a", "b"))
        left = met.join(told.filter("NOT ok"), ["a", "b"], "left_semi").select("a", "band")
    lead = left.groupBy("band").agg(F.min("a").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return reduce(DataFrame.union, kept).union(left.join(lead, "band").filter("a <> b").select("a", "b"))


def shared_counts(a: list[np.ndarray], b: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of the pairs of sorted sets."""
    if len(left) <= 4 * (len(a) + len(b)):
        return np.array([len(np.intersect1d(a[i], b[j], assume_unique=True)) for i, j in zip(left.tolist(), right.tolist(), strict=True)], np.int64)
    rows, cols = np.unique(left), np.unique(right)
    values = np.unique(np.concatenate([b[j] for j in cols]))
    out = np.zeros((len(rows), len(cols)), np.float32)
    for at in range(0, len(values), 8192):
        part = values[at : at + 8192]

        def table(sets: list[np.ndarray], which: np.ndarray, part: np.ndarray = part) -> np.ndarray:
            t = np.zeros((len(which), len(part)), np.float32)
            for r, i in enumerate(which):
                own = sets[i][np.searchsorted(sets[i], part[0]) : np.searchsorted(sets[i], part[-1], side="right")]
                k = np.minimum(np.searchsorted(part, own), len(part) - 1)
                t[r, k[part[k] == own]] = 1
            return t

        out += table(a, rows) @ table(b, cols).T
    return out[np.searchsorted(rows, left), np.searchsorted(cols, right)].astype(np.int64)


def _spanning(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The root of each node (the smallest index of its component)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        root = root[root]
        if (root == before).all():
            return root


def packed_block(node: list[bytes], size: np.ndarray, low: np.ndarray, grams: list[np.ndarray]) -> bytes:
    """Sets of a block in few bytes: n-grams that they share are there once, equal MinHash values side by side."""
    values = np.unique(np.concatenate(grams))
    steps = np.concatenate([np.diff(np.searchsorted(values, g), prepend=0) for g in grams]).astype(np.uint32)
    parts = (node, size, np.ascontiguousarray(low.T), np.array([len(g) for g in grams]), values, pack(steps))
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(parts, protocol=5))


def unpacked_block(raw: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, list[np.ndarray]]:
    node, size, low, lengths, values, steps = pickle.loads(zstandard.ZstdDecompressor().decompress(raw))
    parts = np.split(unpack(steps, "u4")[0].astype(np.int64), np.cumsum(lengths)[:-1])
    return node, size, np.ascontiguousarray(low.T), [values[np.cumsum(p)] for p in parts]


def linked_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, bands: int = BANDS, rows: int = ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, the kept columns, class_id, set_id, n_links, class_key) of each row.

    set_id: the smallest id of a row with the same set of n-grams; class_id: the smallest id that chains of
    links reach; n_links: other rows whose set has a Jaccard index of the threshold or more; class_key: 128 bits that
    name the class, null for a row without a set.  A null, empty or blank text has no set: its class is its own id and
    it has no links.  Rows that repeat an id link to each other like any others, and with unlike texts each has the
    links of its own text (their classes then have the same class_id, but not the same class_key); a null id stays
    null and never names a class that has an id; an empty table gives no rows; columns that are not kept are ignored.
    """
    require(docs, id_col, text_col, *keep)
    n_batches, _ = sizes(docs)
    total = bands * rows
    signed = cut_lineage(signatures(docs, id_col, text_col, n, bands, rows, n_batches, keep))
    named = signed.filter("key IS NOT NULL")
    # the row of a set whose text is fetched, the set's smallest id, and its values
    place = F.struct(F.col("id").isNull().alias("none"), "id", "b")
    sets = named.groupBy("key").agg(F.min(place).alias("at"), F.count("*").alias("size"), F.first("bands").alias("bands"), F.first("low").alias("low"))
    sets = cut_lineage(sets)
    areas = components(likely_links(sets, total, threshold, tolerance))

    # sets that share an area, with their block in it; blocks are filled by a hash, so their number follows the area's size
    members = areas.join(sets.select(F.col("key").alias("node"), "at", "size"), "node")
    wide = members.groupBy("root").agg(F.count("*").alias("n")).select("root", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = members.join(wide, "root").select("node", "root", "size", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "at.none", F.coalesce("at.id", F.lit(0)).alias("id"), "at.b")
    spot = cut_lineage(placed)

    def gather(part: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(part) and len(asked):
            batch = Batch(part.blob)
            # all rows that have a wanted id, as rows that repeat it may hold other texts; the set's key picks the right one
            wanted = set(asked.id[~asked.none].astype(np.int64))
            nameless = bool(asked.none.any())
            at = [k for k, (i, none) in enumerate(zip(batch.ids.tolist(), batch.null, strict=True)) if (nameless if none else i in wanted)]
            batch.texts = [batch.texts[k] for k in at]
            words, cuts = batch_words(batch)
            keys, starts = ngram_sets(words, cuts, n)
            some = np.flatnonzero(np.diff(starts))
            own = {name.tobytes(): k for k, name in zip(some.tolist()[::-1], set_keys(keys, starts[some])[::-1], strict=True)} if len(some) else {}
            for r in asked.itertuples(index=False):
                out.append((r.node, r.root, r.size, r.blocks, r.block, pack(keys[starts[own[r.node]] : starts[own[r.node] + 1]])))
        return pd.DataFrame(out, columns=["node", "root", "size", "blocks", "block", "grams"])

    dealt = batches(docs, n_batches, id_col, text_col).repartition(tasks_for(docs), "b")
    loaded = dealt.groupBy("b").cogroup(spot.groupBy("b")).applyInPandas(gather, "node binary, root binary, size long, blocks int, block int, grams binary")

    def verify(one: tuple, other: tuple | None) -> pd.DataFrame:
        """Links between two blocks, or inside one."""
        (node, size, low, grams), n_one = one, len(one[0])
        a = b = np.arange(n_one)
        if other:
            node, size, low, grams = node + other[0], np.concatenate((size, other[1])), np.concatenate((low, other[2])), grams + other[3]
            b = np.arange(n_one, len(node))
        left, right = likely_pairs(low[a], low[b], not other, threshold, tolerance)
        length = np.array([len(g) for g in grams])
        shared = shared_counts([grams[i] for i in a], [grams[i] for i in b], left, right)
        left, right = a[left], b[right]
        ok = shared >= threshold * (length[left] + length[right] - shared) - 1e-9
        left, right = left[ok], right[ok]
        links = np.bincount(left, size[right], len(node)) + np.bincount(right, size[left], len(node))
        root = _spanning(len(node), left, right)
        some = np.flatnonzero(links > 0)
        return pd.DataFrame({"node": [node[i] for i in some], "links": links[some].astype(np.int64), "top": [node[i] for i in root[some]]})

    def one_block(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        """The block's own links and, if its area has others, the block itself."""
        part = part.sort_values("node", kind="stable")
        grams = [unpack(g, "u8")[0] for g in part.grams]
        low = minhashes(np.concatenate(grams), np.concatenate(([0], np.cumsum([len(g) for g in grams]))), total)
        block = part.node.tolist(), part["size"].to_numpy(), low, grams
        out, blocks = verify(block, None), int(part.blocks.iloc[0])
        if blocks > 1:
            out = pd.concat([out, pd.DataFrame({"root": [key[0]], "blocks": [blocks], "block": [key[1]], "payload": [packed_block(*block)]})])
        return out.reindex(columns=["node", "links", "top", "root", "blocks", "block", "payload"]).astype({c: "Int64" for c in ("links", "blocks", "block")})

    def two_blocks(part: pd.DataFrame) -> pd.DataFrame:
        if len(part) < 2:  # a block may be empty, as they are filled by a hash
            return pd.DataFrame(columns=["node", "links", "top"])
        one, other = (unpacked_block(p) for p in part.sort_values("block").payload)
        return verify(one, other)

    told = "node binary, links long, top binary"
    inside = cut_lineage(loaded.groupBy("root", "block").applyInPandas(one_block, f"{told}, root binary, blocks int, block int, payload binary"))
    # a row for each other block that a block meets
    others = F.transform(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("block")), lambda k: F.struct(F.least(k, F.col("block")).alias("x"), F.greatest(k, F.col("block")).alias("y")))
    pairs = inside.filter("payload IS NOT NULL").select("root", "block", "payload", F.explode(others).alias("p")).select("root", "block", "payload", "p.x", "p.y")
    between = pairs.groupBy("root", "x", "y").applyInPandas(two_blocks, told)
    found = cut_lineage(inside.filter("node IS NOT NULL").select("node", "links", "top").union(between))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("node").alias("a"), F.col("top").alias("b")))
    of_set = sets.select("key", "at.id", "size").join(links.join(classes, "node", "left").withColumnRenamed("node", "key"), "key", "left").withColumn("class_key", F.coalesce("root", "key"))
    of_set = cut_lineage(of_set)
    heads = cut_lineage(of_set.groupBy("class_key").agg(F.min("id").alias("class_id")))  # so that a large class's join can be split
    of_set = of_set.join(heads, "class_key").select("key", "class_key", F.col("id").alias("set_id"), "class_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    every = signed.select("id", *(f"kept{k}" for k in range(len(keep))), "key").join(of_set, "key", "left")
    own = lambda c: F.when(F.col("key").isNotNull(), F.col(c)).otherwise(F.col("id")).alias(c)
    return every.select(F.col("id").alias(id_col), *(F.col(f"kept{k}").alias(c) for k, c in enumerate(keep)), own("class_id"), own("set_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "class_key")
