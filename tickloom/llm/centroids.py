"""Centroid clustering over subvector dictionaries.

Components become integers. Vectors are gathered in lots; each lot cuts its vectors into blocks of ``WIDTH`` dimensions and keeps
every distinct subvector of a block once, so a vector is a row of codes (lossless). A round computes the squared distances of
the distinct subvectors to the centroids once and sums them by code; centroid sums come from the counts of (code, cluster). Only
one row per centroid and dimension reaches the driver. Integers of any size are exact: lots beyond ``SAFE`` use Python's.

Not kept: null vectors, vectors of another length, with a null or non-finite component, or with one whose 256-fold is no
finite double. Rows without an id are clustered but are no first centroid; repeated rows are vectors of their own. Fewer
vectors than centroids give fewer centroids; a table without a kept vector with an id gives no row. A distance or inertia beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import TEXT_ROWS, arrow_rows, store

SCALE, WIDTH = 256, 2
#: Vectors of a lot; integers up to SAFE keep the squared distance of MAX_DIMENSIONS dimensions within 64 bits.
LOT, SAFE, MAX_DIMENSIONS = 16_384, 1 << 27, 64
#: Lots of one Arrow batch.
LOT_ROWS = 4
#: Sums travel in limbs of so many bits, so that a long holds the sum over 2**33 tasks.
LIMB = 30


def usable(vector: Column, dimensions: int) -> Column:
    """Of the right length, without a component that is null or whose multiple by ``SCALE`` is not finite."""
    scaled = lambda x: x.cast("double") * F.lit(float(SCALE))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(scaled(x)) == float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & ~bad, F.lit(False))


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): 64-bit integers, Python's where one may pass ``SAFE``."""
    floored = np.floor(values * SCALE)
    if floored.size and np.abs(floored).max() > SAFE:
        return np.array([int(x) for x in floored.ravel()], object).reshape(floored.shape)
    return floored.astype(np.int64)


def _encode(kept: DataFrame, dimensions: int, width: int) -> DataFrame:
    """Lots: ids, per block the distinct subvectors, and the codes of every vector."""
    id_type = kept.schema["vec_id"].dataType

    def lot(ids: list, vectors: list) -> pd.DataFrame:
        whole = np.floor(np.asarray(vectors, float) * SCALE)
        words, sizes, codes = [], [], np.empty((len(ids), -(-dimensions // width)), np.int32)
        for b, at in enumerate(range(0, dimensions, width)):
            distinct, code = np.unique(whole[:, at:at + width], axis=0, return_inverse=True)
            words.append(distinct.astype("<f8").tobytes())
            sizes.append(len(distinct))
            codes[:, b] = code.ravel()
        return pd.DataFrame({"ids": [ids], "sizes": [sizes], "words": [words], "codes": [codes.astype("<i4").tobytes()]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors = [], []
        for df in frames:
            for start in range(0, len(df), LOT):
                part = df.iloc[start:start + LOT]
                ids += [None if pd.isna(x) else x for x in part["vec_id"]]
                vectors += list(part["vector"])
                while len(ids) >= LOT:
                    yield lot(ids[:LOT], vectors[:LOT])
                    ids, vectors = ids[LOT:], vectors[LOT:]
        if ids:
            yield lot(ids, vectors)

    schema = T.StructType([T.StructField("ids", T.ArrayType(id_type)), T.StructField("sizes", T.ArrayType(T.IntegerType())),
                           T.StructField("words", T.ArrayType(T.BinaryType())), T.StructField("codes", T.BinaryType())])
    # Ids that may be null travel as text: pandas would turn them into doubles.
    sent = kept.select(F.col("vec_id").cast("string").alias("vec_id"), "vector")
    lots = sent.mapInPandas(run, T.StructType([T.StructField("ids", T.ArrayType(T.StringType())), *schema.fields[1:]]))
    return lots.withColumn("ids", F.col("ids").cast(T.ArrayType(id_type)))


def _lots(df: pd.DataFrame, dimensions: int, width: int):
    """Per row of a batch: the dictionaries as integers and the codes."""
    starts = range(0, dimensions, width)
    for sizes, words, codes in zip(df["sizes"], df["words"], df["codes"]):
        books = [np.frombuffer(w, "<f8").reshape(n, min(width, dimensions - at)) for w, n, at in zip(words, sizes, starts)]
        if max(np.abs(b).max() for b in books) > SAFE:
            books = [np.array([int(x) for x in b.ravel()], object).reshape(b.shape) for b in books]
        else:
            books = [b.astype(np.int64) for b in books]
        yield books, np.frombuffer(codes, "<i4").reshape(-1, len(books))


def _nearest(books: list[np.ndarray], codes: np.ndarray, centroids: list[list[int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every vector, ties to the smaller number, and its squared distance."""
    wide = books[0].dtype == object or max(abs(x) for c in centroids for x in c) > SAFE
    kind = object if wide else np.int64
    centre, total = np.array(centroids, kind), None
    for b, book in enumerate(books):
        apart = book.astype(kind)[:, None, :] - centre[None, :, b * width:b * width + book.shape[1]]
        table = (apart * apart).sum(2)
        total = table[codes[:, b]] if total is None else total + table[codes[:, b]]
    best = total.argmin(1)
    return best, total[np.arange(len(best)), best]


def _sums(lots: DataFrame, centroids: list[list[int]], dimensions: int, width: int) -> tuple[np.ndarray, list[list[int]]]:
    """Vectors and exact component sums of every cluster."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(centroids)
        n, sums = np.zeros(k, np.int64), np.zeros((k, dimensions), object)
        for df in frames:
            for books, codes in _lots(df, dimensions, width):
                best, _ = _nearest(books, codes, centroids, width)
                n += np.bincount(best, minlength=k)
                for b, book in enumerate(books):
                    times = np.bincount(best * len(book) + codes[:, b], minlength=k * len(book)).reshape(k, -1)
                    sums[:, b * width:b * width + book.shape[1]] += (times.astype(book.dtype) @ book).astype(object)
        rows = [(c, -1, 0, int(n[c])) for c in range(k) if n[c]]
        for c in range(k):
            for d in range(dimensions) if n[c] else ():
                rest, limb = abs(int(sums[c, d])), 0
                while rest:
                    rows.append((c, d, limb, (1 if sums[c, d] > 0 else -1) * (rest & ((1 << LIMB) - 1))))
                    rest, limb = rest >> LIMB, limb + 1
        yield pd.DataFrame(rows, columns=["c", "d", "limb", "x"])

    found = lots.mapInPandas(run, "c int, d int, limb int, x long").groupBy("c", "d", "limb").agg(F.sum("x").alias("x"))
    n, sums = np.zeros(len(centroids), np.int64), [[0] * dimensions for _ in centroids]
    with arrow_rows(lots.sparkSession, LOT_ROWS):
        rows = found.collect()
    for r in rows:
        if r.d < 0:
            n[r.c] = r.x
        else:
            sums[r.c][r.d] += r.x << (LIMB * r.limb)
    return n, sums


def _final(lots: DataFrame, centroids: list[list[int]], dimensions: int, width: int, id_type: T.DataType) -> DataFrame:
    """Every vector with its cluster; distances as decimal text, since they may pass 64 bits."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for ids, (books, codes) in zip(df["ids"], _lots(df, dimensions, width)):
                best, far = _nearest(books, codes, centroids, width)
                for at in range(0, len(best), 4096):
                    yield pd.DataFrame({"vec_id": ids[at:at + 4096], "cluster": best[at:at + 4096].astype(np.int32),
                                        "distance": [str(x) for x in far[at:at + 4096]]})

    texts = lots.withColumn("ids", F.col("ids").cast(T.ArrayType(T.StringType())))
    return texts.mapInPandas(run, "vec_id string, cluster int, distance string").withColumn("vec_id", F.col("vec_id").cast(id_type))


def first_centroids(kept: DataFrame, count: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest hash of seed and id, in that order; of one id the smaller vector first."""
    named = kept.filter(F.col("vec_id").isNotNull())
    hashed = named.withColumn("__h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    return [integers(np.asarray(r.vector, float)).tolist() for r in hashed.orderBy("__h", "vector").limit(count).collect()]


def cluster(vectors: DataFrame, column: str = "embedding", dimensions: int = 64, count: int = 40, rounds: int = 5, seed: int = 2,
            width: int = WIDTH) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    if dimensions > MAX_DIMENSIONS:
        raise ValueError(f"at most {MAX_DIMENSIONS} dimensions keep distances within 64 bits")
    id_type = vectors.schema["vec_id"].dataType
    kept = (vectors.filter(usable(F.col(column), dimensions))
            .select("vec_id", F.col(column).cast("array<double>").alias("vector")))
    result = T.StructType([T.StructField("vec_id", id_type), T.StructField("cluster", T.IntegerType()),
                           *(T.StructField(c, T.LongType()) for c in ("distance", "cluster_inertia", "inertia")),
                           T.StructField("centroid_sha256", T.StringType())])
    centroids = first_centroids(kept, count, seed)
    if not centroids:
        return kept.sparkSession.createDataFrame([], result)
    lots = store(_encode(kept, dimensions, width), "vector-lots", TEXT_ROWS)
    for _ in range(rounds):
        n, sums = _sums(lots, centroids, dimensions, width)
        centroids = [[s // int(m) for s in row] if m else old for m, row, old in zip(n, sums, centroids)]
    found = store(_final(lots, centroids, dimensions, width, id_type), "clustered", LOT_ROWS)

    # One row a centroid: exact inertia from the sums of the high and low digits.
    half = 10 ** 15
    digits = F.lpad("distance", 60, "0")
    parts = [F.sum(F.substring(digits, 60 - 15 * (i + 1) + 1, 15).cast("decimal(38,0)")).alias(f"p{i}") for i in range(4)]
    inertia = {r["cluster"]: sum(int(r[f"p{i}"]) * half ** i for i in range(4)) for r in found.groupBy("cluster").agg(*parts).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    whole = fits(sum(inertia.values()))
    ends = kept.sparkSession.createDataFrame(
        [(c, fits(inertia.get(c, 0)), whole, hashlib.sha256(",".join(map(str, m)).encode()).hexdigest()) for c, m in enumerate(centroids)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return (found.join(F.broadcast(ends), "cluster")
            .select("vec_id", "cluster", F.expr("try_cast(distance AS long)").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256"))
