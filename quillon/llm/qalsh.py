"""Approximate nearest neighbours by collision counting over single projections, with query-centred windows.

Vectors are dealt into blocks of bounded size, queries likewise; each pair of a query block and a vector block is one
task. A block keeps, for each of `projections` random lines, its vectors' projections in sorted order. A query's window
on each line starts at `width` around its own projection and grows by `growth` (virtual rehashing), and a vector's
collisions are the lines on which it lies in the window. Vectors with `collisions` of them or more are verified by exact
inner products in double precision; windows grow until the share `VERIFY` of the block (at least LEAST x k vectors) is verified, or
until all are. The best k of each block are merged.

Largest inner product becomes smallest distance by one more component that gives every vector the block's largest norm.
Equal vectors of a block are indexed once, so groups of copies neither widen nor starve a window.

Defined results: null, zero or non-finite vectors (or components) take no part, nor do null vec_ids or vectors of another
length than the most common one; ties go to the smaller vec_id; with fewer than k candidates all are returned; an empty
table gives an empty one. Repeated rows of one vec_id count once for themselves and never for their own query.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm import common

K = 20
EVERY = 20
#: Rows of a vector block and of a query block.
BLOCK_ROWS = 16_384
QUERY_ROWS = 4_096
PROJECTIONS = 96
GROWTH = 1.1
#: Share of lines on which a verified vector collides.
COLLISIONS = 0.4
#: Half a first window, in standard deviations of a projection.
START = 0.7
#: Share of a block's distinct vectors that is verified per query.
VERIFY = 0.25
#: Times k: the fewest that are verified, which makes small blocks exact.
LEAST = 50
SEED = 11


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    good = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    return table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(good).dropDuplicates(["vec_id"])


class Block:
    """The index of one vector block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int, seed: int):
        order = np.argsort(ids)
        ids, vectors = ids[order], vectors[order]
        _, first, owner = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
        owner = owner.ravel()
        by = np.argsort(owner, kind="stable")
        self.ids, self.first = ids[by], np.searchsorted(owner[by], np.arange(len(first)))
        self.last = np.concatenate([self.first[1:], [len(ids)]])
        self.vectors = vectors[first]
        norms = (self.vectors**2).sum(axis=1)
        lift = np.sqrt(np.maximum(norms.max() - norms, 0))
        self.lines = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, projections))
        self.lines /= np.linalg.norm(self.lines, axis=0)
        self.lifted = np.hstack([self.vectors, lift[:, None]])
        self.radius = math.sqrt(norms.max())
        shadow = self.lifted @ self.lines
        self.order = np.argsort(shadow, axis=0).T.copy()
        self.sorted = np.take_along_axis(shadow, self.order.T, axis=0).T.copy()

    def verified(self, query: np.ndarray, k: int, share: float, collisions: float, growth: float, start: float = START) -> np.ndarray:
        """Distinct vectors whose collisions reach the threshold, in windows grown until there are enough."""
        n, lines = len(self.vectors), len(self.sorted)
        enough = min(n, max(LEAST * k, math.ceil(share * n)))
        if enough == n:
            return np.arange(n)
        norm = math.sqrt((query**2).sum())
        centre = (query * (self.radius / norm)) @ self.lines[:-1]  # the query, scaled to the vectors' sphere
        half = self.radius * start / math.sqrt(len(query))
        need = math.ceil(collisions * lines)
        count = np.zeros(n, np.int64)
        low = high = None
        while True:
            a = np.array([np.searchsorted(s, c - half) for s, c in zip(self.sorted, centre)])
            b = np.array([np.searchsorted(s, c + half, "right") for s, c in zip(self.sorted, centre)])
            parts = [o[i:j] for o, i, j in zip(self.order, a, b)] if low is None else [p for o, i, j, x, y in zip(self.order, a, b, low, high) for p in (o[i:x], o[y:j])]
            count += np.bincount(np.concatenate(parts), minlength=n)
            low, high = a, b
            found = np.flatnonzero(count >= need)
            if len(found) >= enough:
                return found
            half *= growth

    def search(self, qid: int, query: np.ndarray, k: int, share: float, collisions: float, growth: float) -> tuple[np.ndarray, np.ndarray]:
        found = self.verified(query, k, share, collisions, growth)
        rough = self.vectors[found] @ query
        if len(found) > k + 1:  # one may be the query's own; what rounding could confuse with the last stays
            least = np.partition(rough, -(k + 1))[-(k + 1)]
            found = found[rough >= least - 1e-9 * self.radius * math.sqrt((query**2).sum())]
        scores = _products(self.vectors[found], query)
        best = np.arange(len(found))
        ids = [self.ids[self.first[u] : min(self.last[u], self.first[u] + k + 1)] for u in found[best]]  # a copy group's smallest ids; one may be the query's own
        out_ids = np.concatenate(ids)
        out_scores = np.repeat(scores[best], [len(i) for i in ids])
        own = out_ids != qid
        out_ids, out_scores = out_ids[own], out_scores[own]
        top = np.lexsort((out_ids, -out_scores))[:k]
        return out_ids[top], out_scores[top]


def _products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed component by component, so that a score doesn't depend on what else is in the block."""
    out = np.zeros(len(vectors))
    for j in range(vectors.shape[1]):
        out += vectors[:, j] * query[j]
    return out


def search(table: DataFrame, every: int = EVERY, k: int = K, share: float = VERIFY, projections: int = PROJECTIONS, collisions: float = COLLISIONS, growth: float = GROWTH) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each vector whose id `every` divides."""
    vectors = usable(table)
    sizes = vectors.groupBy(F.size("v").alias("n"), (F.col("vec_id") % every == 0).alias("asks")).count().collect()  # one row per vector length
    if not sizes:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    total: dict[int, int] = {}
    for r in sizes:
        total[r["n"]] = total.get(r["n"], 0) + r["count"]
    width = max(total, key=lambda n: (total[n], n))
    asked = sum(r["count"] for r in sizes if r["n"] == width and r["asks"])
    blocks, query_blocks = max(1, -(-total[width] // BLOCK_ROWS)), max(1, -(-asked // QUERY_ROWS))
    vectors = common.stored(vectors.where(F.size("v") == width), "vectors")
    own = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    data = vectors.select(own.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("part"), "vec_id", "v")
    part = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks)).cast("int")
    asks = vectors.where(F.col("vec_id") % every == 0).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), part.alias("part"), "vec_id", "v")

    def run(key, own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple[int, np.ndarray, np.ndarray]] = []
        if len(own) and len(queries):
            block = Block(own.vec_id.to_numpy(), np.stack(own.v.to_numpy()), projections, SEED)
            for qid, v in zip(queries.vec_id.to_numpy(), queries.v.to_numpy()):
                rows.append((qid, *block.search(qid, np.asarray(v), k, share, collisions, growth)))
        return pd.DataFrame(
            {
                "query_id": np.repeat(np.array([r[0] for r in rows], np.int64), [len(r[1]) for r in rows]),
                "vec_id": np.concatenate([r[1] for r in rows]) if rows else np.zeros(0, np.int64),
                "score": np.concatenate([r[2] for r in rows]) if rows else np.zeros(0),
            }
        )

    found = data.groupBy("block", "part").cogroup(asks.groupBy("block", "part")).applyInPandas(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.read(spark, sf_dir, "embeddings"))
