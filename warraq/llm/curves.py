"""Approximate nearest neighbours by shifted space-filling curves.

Each curve projects the vectors onto a few random orthogonal directions, shifts the grid by a random
offset and orders the cells along a Hilbert curve.  Keys are cut into ranges of equal share, by quantiles that
Spark takes over all keys; a query looks at its own range and at `reach` ranges on both sides in each ordering.
Candidates of all orderings are merged and ranked by their exact inner product.

How wide a window is follows from the vectors: on the fitting sample, the true neighbours of some of its rows give the
share of the ordering within which `target` of them are found.  Vectors with structure need narrow windows,
which stay narrow as the table grows; without any, most of the table has to be looked at for the same recall.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warraq.llm._common import require
from warraq.operators.components import cut_lineage

CURVES, DIRECTIONS, BITS = 16, 8, 7
TARGET, REACH, BLOCK_ROWS, FIT_ROWS, PROBES = 0.97, 2, 20_000, 20_000, 200


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of cell coordinates (integers below 2^bits)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = np.int64(1 << level), np.int64((1 << level) - 1)
        for i in range(n):
            high = (x[i] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip = np.where((x[-1] >> level) & 1, flip ^ ((1 << level) - 1), flip)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


@dataclass
class Curves:
    """Orderings fitted on a bounded sample: directions, offset and scale of the grid, and the bounds of each ordering's ranges."""

    directions: list[np.ndarray]
    low: list[np.ndarray]
    width: list[np.ndarray]
    bounds: list[np.ndarray]
    bits: int
    reach: int = REACH

    @classmethod
    def fit(cls, sample: np.ndarray, curves: int = CURVES, directions: int = DIRECTIONS, bits: int = BITS, seed: int = 11) -> Curves:
        rng, dim = np.random.default_rng(seed), sample.shape[1]
        out = cls([], [], [], [], bits)
        for _ in range(curves):
            d = np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, : min(directions, dim)]
            y = sample @ d
            spread = 6 * y.std(axis=0) + 1e-12
            out.directions.append(d)
            out.low.append(y.mean(axis=0) - spread * (0.5 + 0.5 * rng.random(y.shape[1])))
            out.width.append(1.5 * spread)
        return out

    def keys(self, x: np.ndarray, curve: int) -> np.ndarray:
        cells = (x @ self.directions[curve] - self.low[curve]) / self.width[curve] * (1 << self.bits)
        return hilbert_keys(np.clip(cells, 0, (1 << self.bits) - 1), self.bits)

    def block(self, x: np.ndarray, curve: int) -> np.ndarray:
        return np.searchsorted(self.bounds[curve], self.keys(x, curve), side="right")

    def window(self, sample: np.ndarray, k: int, target: float = TARGET, probes: int = PROBES) -> float:
        """The share of the orderings, on each side, that holds `target` of the k nearest of some rows of the sample."""
        n = len(sample)
        asked = np.arange(0, n, max(1, n // probes))
        near = sample[asked] @ sample.T
        near[np.arange(len(asked)), asked] = -np.inf
        k = min(k, n - 1)
        if k < 1:
            return 1.0
        true = np.argpartition(-near, k - 1, axis=1)[:, :k]
        apart = np.full(true.shape, n)
        for c in range(len(self.directions)):
            place = np.empty(n, np.int64)
            place[np.argsort(self.keys(sample, c), kind="stable")] = np.arange(n)
            apart = np.minimum(apart, np.abs(place[true] - place[asked][:, None]))
        return float(np.quantile(apart, target, method="higher") + 1) / n


def usable(vector: str, dim: int | None = None) -> Column:
    """Not null, of the right length, without null or non-finite components, and not all zero."""
    v = F.col(vector)
    wrong = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = v.isNotNull() & ~wrong & F.exists(v, lambda x: x != 0)
    return F.coalesce(ok & (F.size(v) == dim) if dim else ok, F.lit(False))


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision; equal vectors get equal scores wherever they stand."""
    return np.multiply(x, q).sum(axis=1)


def best_of(q: np.ndarray, x: np.ndarray, first_id: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query (indices of its k best candidates by score, then first_id; their scores)."""
    for at in range(0, len(q), 256):
        part = q[at : at + 256]
        near = part @ x.T
        for row, query in zip(near, part, strict=True):
            chosen = np.arange(len(x))
            if len(x) > k:
                least = np.partition(row, len(x) - k)[len(x) - k]
                chosen = np.flatnonzero(row >= least - 1e-9 * (1 + abs(least)))
            exact = exact_scores(query, x[chosen])
            order = np.lexsort((first_id[chosen], -exact))[:k]
            yield chosen[order], exact[order]


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", curves: int = CURVES, target: float = TARGET, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of each query row, itself left out.

    Ties go to the smaller id; a query with fewer than k candidates gets them all; copies of a vector are
    searched once and only their k + 1 smallest ids can rank, so a vector that fills a third of the table
    costs no more than another; vectors that are null, zero, of another length than most, or that hold null
    or non-finite components take no part; an empty table gives no rows; further columns are ignored.
    Fitting takes at most fit_rows vectors (those with the smallest hash of their id) to the driver; windows are as
    wide as `target` of their true neighbours need.
    """
    require(vectors, id_col, vector_col)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), is_query.alias("is_q")).filter(usable("v") & F.col("id").isNotNull())
    sample = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(fit_rows).collect()
    id_type = rows.schema["id"].dataType.simpleString()
    shape = f"query_id {id_type}, rank int, {id_col} {id_type}, score double"
    if not sample:
        return vectors.sparkSession.createDataFrame([], shape)
    lengths = np.array([len(r["v"]) for r in sample])
    dim = int(np.bincount(lengths).argmax())
    rows = rows.filter(F.size("v") == dim).withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), "v")})
    fitted = np.unique(np.array([r["v"] for r in sample if len(r["v"]) == dim], dtype=float), axis=0)
    model = Curves.fit(fitted, curves)
    share = model.window(fitted, k, target)

    first = Window.partitionBy("k1", "k2").orderBy("id")
    copies = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    things = copies.groupBy("k1", "k2").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids"))
    asked = rows.filter("is_q").groupBy("k1", "k2").agg(F.first("v").alias("v"))

    # ranges: a window is REACH of them on each side, or more where one would hold over BLOCK_ROWS vectors
    things = cut_lineage(things)
    n = things.count()
    blocks = max(1, round(REACH / share), -(-n // BLOCK_ROWS))
    blocks = min(blocks, max(1, n // 64))
    model.reach = max(1, int(np.ceil(share * blocks - 1e-9)))
    model.bounds = [np.empty(0, np.int64)] * curves
    if blocks > 1:

        def key_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                x = np.array(frame.v.tolist(), dtype=float).reshape(len(frame), dim)
                for c in range(curves):
                    yield pd.DataFrame({"curve": c, "key": model.keys(x, c)})

        cuts = [k / blocks for k in range(1, blocks)]
        quantiles = things.select("v").mapInPandas(key_rows, "curve int, key long").groupBy("curve").agg(F.percentile_approx("key", cuts, 10 * blocks).alias("cuts"))
        for r in quantiles.collect():  # a row for each ordering
            model.bounds[r["curve"]] = np.array(r["cuts"], np.int64)

    def deal(reach: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                x = np.array(frame.v.tolist(), dtype=float).reshape(len(frame), dim)
                raw = [r.tobytes() for r in x]
                for c in range(len(model.bounds)):
                    own = model.block(x, c)
                    for step in range(-reach, reach + 1):
                        ok = (own + step >= 0) & (own + step <= len(model.bounds[c]))
                        part = frame.loc[ok].drop(columns="v")
                        yield part.assign(curve=c, block=(own + step)[ok], v=[r for r, t in zip(raw, ok, strict=True) if t])

        return run

    cells = "curve int, block int, v binary"
    candidates = things.select("k1", "k2", "v", F.col("ids")[0].alias("first")).mapInPandas(deal(0), f"k1 long, k2 long, first {id_type}, {cells}")
    queries = asked.select("k1", "k2", "v").mapInPandas(deal(model.reach), f"k1 long, k2 long, {cells}")

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(c.v), dtype=float).reshape(-1, dim)
        y = np.frombuffer(b"".join(q.v), dtype=float).reshape(-1, dim)
        found = list(best_of(y, x, c["first"].to_numpy(), k + 1)) if len(x) and len(y) else []
        k1, k2 = c.k1.to_numpy(), c.k2.to_numpy()
        return pd.DataFrame({"q1": q.k1.to_numpy()[: len(found)], "q2": q.k2.to_numpy()[: len(found)], "c1": pd.Series([k1[i] for i, _ in found], dtype=object), "c2": pd.Series([k2[i] for i, _ in found], dtype=object), "score": pd.Series([s for _, s in found], dtype=object)})

    found = queries.groupBy("curve", "block").cogroup(candidates.groupBy("curve", "block")).applyInPandas(search, "q1 long, q2 long, c1 array<long>, c2 array<long>, score array<double>")

    def merge(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        every = pd.DataFrame({"c1": np.concatenate(parts.c1), "c2": np.concatenate(parts.c2), "score": np.concatenate(parts.score)})
        every = every.drop_duplicates(["c1", "c2"])
        least = every.score.nlargest(k + 1).min()
        return every[every.score >= least].assign(q1=key[0], q2=key[1])[["q1", "q2", "c1", "c2", "score"]]

    merged = found.groupBy("q1", "q2").applyInPandas(merge, "q1 long, q2 long, c1 long, c2 long, score double")
    ids = things.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "ids")
    entries = merged.join(ids, ["c1", "c2"]).select("q1", "q2", "score", F.explode("ids").alias("id"))
    by_query = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "id")
    entries = entries.withColumn("n", F.row_number().over(by_query)).filter(F.col("n") <= k + 1)
    lists = entries.groupBy("q1", "q2").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("found"))
    own = rows.filter("is_q").select(F.col("id").alias("query_id"), F.col("k1").alias("q1"), F.col("k2").alias("q2")).join(lists, ["q1", "q2"])
    others = F.slice(F.filter("found", lambda e: e.id != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("at", "e")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("e.id").alias(id_col), F.col("e.score").alias("score"))
