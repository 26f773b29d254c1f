"""Approximate nearest neighbours by collision counting over single projections.

Every vector is indexed by ``PROJECTIONS`` random projections; an index block keeps one sorted array for each. A query's window on
every array is centred on its own projection and grows by virtual rehashing; a vector that falls into the windows of
``THRESHOLD`` arrays or more is verified by its distance. The search of a block ends when the half width of the windows reaches ``REACH`` times the
distance of the ``k``-th nearest found, at any size of the block. A projected difference is the distance times a
normal variable, so a vector as near as that lies in each window with probability 0.87 and collides often enough in 95 cases of 100; nearer ones more
often. Queries meet the blocks in blocks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

PROJECTIONS, THRESHOLD = 80, 64
#: First window (half width, in units of the block's median projected spread), its growth, and its half width at the end, in distances of the k-th found.
START, GROWTH, REACH = 0.25, 1.1, 1.5
#: Vectors of an index block and queries of a query block, about.
BLOCK, QUERIES = 8192, 2048


def usable(vector: Column) -> Column:
    """Neither null nor zero, without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


class Block:
    """Sorted projections of some vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 5):
        self.ids, self.vectors = ids, vectors
        self.directions = np.random.default_rng(seed).normal(size=(PROJECTIONS, vectors.shape[1]))
        shadows = self.directions @ vectors.T
        self.order = np.argsort(shadows, axis=1, kind="stable")
        self.sorted = np.take_along_axis(shadows, self.order, 1)
        spread = np.median(np.std(shadows, axis=1))
        self.unit = float(spread) if spread > 0 else 1.0
        self.verified = 0              # distances taken in all searches

    def search(self, query: np.ndarray, own_id, k: int) -> list[tuple[float, object]]:
        """The ``k`` nearest verified vectors as (distance, id), ties to the smaller id; the query's own id is left out."""
        n = len(self.ids)
        centre = self.directions @ query
        hits = np.zeros(n, np.int64)
        lo = hi = [int(x.searchsorted(c)) for x, c in zip(self.sorted, centre)]
        half = START * self.unit
        distance = np.full(n, np.inf)
        checked = np.zeros(n, bool)
        others = self.ids != own_id
        kth = np.inf
        while True:
            a = [int(x.searchsorted(c - half, "left")) for x, c in zip(self.sorted, centre)]
            b = [int(x.searchsorted(c + half, "right")) for x, c in zip(self.sorted, centre)]
            entered = [o[x:y] for o, x, y in zip(self.order, a, lo)] + [o[x:y] for o, x, y in zip(self.order, hi, b)]
            hits += np.bincount(np.concatenate(entered), minlength=n)
            lo, hi = a, b
            new = np.flatnonzero((hits >= THRESHOLD) & ~checked)
            if len(new):
                diff = self.vectors[new] - query
                distance[new] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
                checked[new] = True
                known = distance[checked & others]
                if len(known) >= k:
                    kth = np.partition(known, k - 1)[k - 1]
            if half >= REACH * kth or all(y - x == n for x, y in zip(lo, hi)):
                break
            half *= GROWTH
        self.verified += int(checked.sum())
        found = np.flatnonzero(checked & others)
        if len(found) > k:
            limit = np.partition(distance[found], k - 1)[k - 1]
            found = found[distance[found] <= limit]
        best = found[np.lexsort((self.ids[found], distance[found]))][:k]
        return [(float(distance[i]), self.ids[i]) for i in best]


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest found vectors of each query row: query_id, rank (from 1), vec_id, score (Euclidean distance).

    Every row but the query's own is a candidate. Vectors that are null, zero, or hold null or non-finite components
    take no part, nor do vectors of another length than the query, nor rows without an id. An id that repeats counts once,
    with the smallest of its vectors, and is a query if one of its rows is. Ties go to the smaller id.
    """
    rows = vectors.filter(usable(F.col(vector)) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).alias("vec_id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    id_type = dict(rows.dtypes)["vec_id"]
    counted = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("q")).first()
    blocks, lots = max(1, -(-counted["n"] // BLOCK)), max(1, -(-counted["q"] // QUERIES))
    base = rows.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"),
                       F.size("v").alias("d"))
    asked = rows.filter("q").select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), F.size("v").alias("d"),
                                    F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(lots)).cast("int").alias("lot"))
    # every block of queries meets every block of vectors once
    base = base.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            block = Block(left["vec_id"].to_numpy(), np.stack(left["v"].to_numpy()))
            for q, v in zip(right["query_id"], right["qv"]):
                out += [(q, d, i) for d, i in block.search(np.asarray(v), q, k)]
        return pd.DataFrame(out, columns=["query_id", "score", "vec_id"])

    found = base.groupBy("block", "lot", "d").cogroup(asked.groupBy("block", "lot", "d")) \
        .applyInPandas(search, f"query_id {id_type}, score double, vec_id {id_type}")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
