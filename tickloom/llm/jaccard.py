"""Exact Jaccard join of word shingle sets by partitioning the universe of shingles into segments.

Sets are banded by size so that two linked sets lie in one band or in neighbouring ones. A band hashes shingles into as many
segments as pigeonholes need: two sets that differ in at most H shingles agree on segments of more than the skippable
weight. A segment is indexed as a whole (weight 1) or, where one wide segment is cheap for its band, with its
one-deletion neighbourhood (weight 2). By the measured size of each index bucket a set skips its costliest segments,
as many as the spare weight allows. What remains gives candidates, and those are verified exactly.

Within a bucket no pairs are listed that a component already joins: members are first compared with one pivot and linked sets are
merged. Members of different components are compared further, in large buckets block by block, where only links come out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import discard, materialize, small_batches
from .graph import components

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]       # A-Z count as a-z
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
#: Bytes hashed in one go; powers of the hash base are kept for so many.
_CHUNK = 1 << 20
#: Names of sets seen in a task; the keys of a later copy are left out.
SEEN = 500_000
#: Spare share of the segments of large bands and, where keys are few and shared passages weigh more, of bands below the size;
#: the band size from which one segment is indexed with its neighbourhood, and how wide that is.
SPARE, SPARE_SMALL, SMALL = 0.12, 0.40, 320
NEIGHBOURS_FROM, WIDE = 512, 24
#: Buckets of no more members than this have their open pairs listed; larger ones are compared in blocks of about ``BLOCK`` members,
#: ``COLUMNS`` shingles at a time.
PAIRED, BLOCK, COLUMNS = 48, 400, 4096


class _Powers:
    def __init__(self):
        self.up, self.down = np.ones(1, _U), np.ones(1, _U)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = np.full(size, _U(_BASE), _U), np.full(size, _U(pow(_BASE, -1, 1 << 64)), _U)
            self.up[0] = self.down[0] = 1
            self.up, self.down = np.cumprod(self.up, dtype=_U), np.cumprod(self.down, dtype=_U)
        return self.up, self.down


_POWERS = _Powers()


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + _U(salt * _BASE & (1 << 64) - 1)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of UTF-8 bytes, A-Z in lower case."""
    space = np.concatenate(([True], _IS_SPACE[data], [True]))
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    out, at = [], 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _CHUNK, "right")))
        lo, hi = starts[at], ends[to - 1]
        up, down = _POWERS.of(hi - lo + 1)
        total = np.zeros(hi - lo + 1, _U)
        np.cumsum(_BYTE[data[lo:hi]] * up[:hi - lo], out=total[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out.append(mixed((total[e] - total[s]) * down[s] + (e - s).astype(_U)))
        at = to
    return np.concatenate(out) if out else np.zeros(0, _U)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a whole text; a shorter text is one shingle; none without words."""
    if not text:
        return np.zeros(0, _U)
    w = word_hashes(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))
    if not len(w):
        return w
    width = min(size, len(w))
    h = np.full(len(w) - width + 1, width, _U)
    for k in range(width):
        h = h * _U(_BASE) + w[k:len(w) - width + 1 + k]
    return np.unique(mixed(h))


@dataclass(frozen=True)
class Scheme:
    """How a band is split: ``wide`` neighbourhood segments, ``plain`` whole ones, ``spare`` weight that may be skipped."""
    band: int
    wide: int
    plain: int
    spare: int
    share: float  # of the universe in the wide segments


class Bands:
    """Bands of set sizes for a threshold of ``percent`` of the union."""

    def __init__(self, percent: int):
        self.percent, self.step = percent, math.log(100 / percent) * 1.001
        self._schemes: dict[int, Scheme] = {}

    def band(self, size: int) -> int:
        return int(math.log(size) / self.step)

    def scheme(self, band: int) -> Scheme:
        if band not in self._schemes:
            top = int(math.exp((band + 1) * self.step) + 1)   # no set of the band is larger
            apart = top * (100 - self.percent) // self.percent  # most shingles in which a linked pair differs
            spare = math.ceil((SPARE if top >= SMALL else SPARE_SMALL) * (apart + 1)) if apart else 0
            wide = 1 if top >= NEIGHBOURS_FROM else 0
            self._schemes[band] = Scheme(band, wide, apart + 1 + spare - 2 * wide, spare, wide * WIDE / top)
        return self._schemes[band]

    def keys(self, s: np.ndarray, band: int) -> tuple[np.ndarray, int]:
        """Index keys of a set under a band's scheme, those of neighbourhoods first, and their number."""
        sch = self.scheme(band)
        where = (mixed(s, 1) >> _U(11)).astype(np.float64) / 2.0 ** 53
        seg = sch.wide + ((where - sch.share) / (1 - sch.share) * sch.plain).astype(np.int64)
        if sch.wide:
            seg = np.where(where < sch.share, (where / sch.share * sch.wide).astype(np.int64), seg)
        order = np.argsort(seg, kind="stable")
        seg, value = seg[order], mixed(s[order], 2)
        sums = np.concatenate((np.zeros(1, _U), np.cumsum(value, dtype=_U)))
        at = np.searchsorted(seg, np.arange(sch.wide + sch.plain + 1))
        content = sums[at[1:]] - sums[at[:-1]]
        salt = mixed(np.arange(sch.wide + sch.plain, dtype=_U), 3 + band)
        near = slice(0, at[sch.wide])
        gone = content[seg[near]] - value[near]
        keys = np.concatenate((mixed(gone ^ salt[seg[near]]), mixed(content ^ salt)))
        return keys, len(gone) + sch.wide


def _name(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sizes(rows: DataFrame, size: int, id_type: str) -> DataFrame:
    """Per document the size and the 128-bit name of its set; no name for the empty one."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            if len(df):
                sets = [shingles(t, size) for t in df["text"]]
                yield pd.DataFrame({"doc_id": df["doc_id"], "n_shingles": [len(s) for s in sets], "name": [_name(s) if len(s) else None for s in sets]})

    return materialize(rows.mapInPandas(run, f"doc_id {id_type}, n_shingles long, name binary"), "set-sizes")


def _entries(rows: DataFrame, size: int, percent: int, id_type: str) -> DataFrame:
    """Index keys by document and scheme, one set of each name within a task. They are as large as the input, so they go straight on."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands, seen = Bands(percent), set()
        for df in frames:
            out = []
            if not len(df):
                continue
            for d, text in zip(df["doc_id"], df["text"]):
                s = shingles(text, size)
                if not len(s) or (name := _name(s)) in seen:
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(name)
                b = bands.band(len(s))
                found = []
                for band in (b, b - 1) if b else (b,):
                    keys, near = bands.keys(s, band)
                    found.append((bands.scheme(band).spare, near, keys.view(np.int64)))
                out.append((d, len(s), found))
            yield pd.DataFrame(out, columns=["doc_id", "size", "schemes"])

    small_batches(rows.sparkSession)
    schemes = rows.mapInPandas(run, f"doc_id {id_type}, size int, schemes array<struct<spare:int,near:int,keys:array<long>>>")
    return (schemes.select("doc_id", "size", F.posexplode("schemes").alias("scheme", "x"))
            .select("doc_id", "size", "scheme", "x.spare", "x.near", F.posexplode("x.keys").alias("pos", "key"))
            .select("key", "doc_id", "size", F.when(F.col("pos") < F.col("near"), -1).otherwise(F.col("spare") * 2 + F.col("scheme"))
                    .cast("int").alias("skip")))


def _shared_keys(entries: DataFrame) -> DataFrame:
    """Rows whose key also occurs with another document, streamed in the order of the key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, joined = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column("key").to_numpy()
            same = k[1:] == k[:-1]
            opens = tail is not None and tail.column("key")[0].as_py() == int(k[0])
            if tail is not None and (joined or opens):
                yield tail
            shared = np.concatenate((same, [False])) | np.concatenate(([opens], same))
            # the last row waits for its successor
            tail, joined = batch.slice(batch.num_rows - 1), bool(shared[-1])
            shared[-1] = False
            yield batch.filter(pa.array(shared))
        if tail is not None and joined:
            yield tail

    return entries.repartition("key").sortWithinPartitions("key").mapInArrow(run, entries.schema)


def _distinct_buckets(rows: DataFrame) -> DataFrame:
    """Buckets (key, doc_id, size) of two documents or more, one of those with the same members.

    Near copies meet in most of their segments. The new key is the exclusive or of the members' hashes; should two buckets
    clash in it, they become one larger bucket, and no pair is lost.
    """
    bucket = Window.partitionBy("key")
    return rows.repartition("key").distinct() \
        .select("doc_id", "size", F.min("doc_id").over(bucket).alias("lo"), F.max("doc_id").over(bucket).alias("hi"),
                F.bit_xor(F.xxhash64("doc_id", "size")).over(bucket).alias("key")) \
        .filter("lo <> hi").select("key", "doc_id", "size").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with ``linked``: 100 * intersection >= percent * union."""
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a") \
        .join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    n = F.size("sa") + F.size("sb")
    possible = 100 * F.least(F.size("sa"), F.size("sb")) >= percent * F.greatest(F.size("sa"), F.size("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", F.when(possible, 100 * common >= percent * (n - common)).otherwise(F.lit(False)).alias("linked"))


def _large_buckets(members: DataFrame, sets: DataFrame, percent: int, id_type: str) -> DataFrame:
    """Links between the components met in large buckets (pivot, doc_id, c), found without listing pairs.

    The members that share a pivot are dealt into blocks; each pair of blocks is compared by the product of its incidence matrices,
    and only links that join two components come out, fewer than there are members.
    """
    counts = members.groupBy("pivot").agg(F.count(F.lit(1)).alias("m"))
    dealt = members.join(counts, "pivot").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")) \
        .withColumn("k", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")) \
        .withColumn("t", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("pivot", F.least("k", "t").alias("i"), F.greatest("k", "t").alias("j"), "doc_id", "c", "k") \
        .join(sets, "doc_id")

    def compare(df: pd.DataFrame) -> pd.DataFrame:
        sizes = df["s"].map(len).to_numpy()
        flat = np.concatenate([np.asarray(x, np.int64) for x in df["s"]])
        owner = np.repeat(np.arange(len(df)), sizes)
        values, place, times = np.unique(flat, return_inverse=True, return_counts=True)
        order = np.cumsum(times > 1) - 1
        shared = times[place] > 1
        owner, place = owner[shared], order[place[shared]]
        common = np.zeros((len(df), len(df)), np.float32)
        by = np.argsort(place, kind="stable")
        owner, place = owner[by], place[by]
        for at in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
            lo, hi = np.searchsorted(place, (at, at + COLUMNS))
            part = np.zeros((len(df), COLUMNS), np.float32)
            part[owner[lo:hi], place[lo:hi] - at] = 1
            common += part @ part.T
        both = sizes[:, None] + sizes[None, :]
        x, y = np.nonzero(np.triu(100 * common >= percent * (both - common), 1))
        names = {}
        def find(c):
            while names.get(c, c) != c:
                c = names[c]
            return c
        ids, comps, out = df["doc_id"].to_numpy(), df["c"].to_numpy(), []
        for u, v in zip(x, y):
            p, q = find(comps[u]), find(comps[v])
            if p != q:
                names[max(p, q)] = min(p, q)
                out.append((ids[u], ids[v]))
        return pd.DataFrame(out, columns=["a", "b"])

    return dealt.select("pivot", "i", "j", "doc_id", "c", "s").groupBy("pivot", "i", "j") \
        .applyInPandas(compare, f"a {id_type}, b {id_type}")


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id",
                       text: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Words are separated by space and U+0009 to U+000D, A-Z in lower case; two documents link when
    100 * intersection >= ``percent`` * union of their shingle sets. Null texts and texts without words have the empty
    set, n_shingles 0, and link with nothing. Ids should be unique; rows that repeat an id share its component,
    rows without one are left out.
    """
    id_type = dict(docs.dtypes)[doc_id]
    rows = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    index = _sizes(rows, size, id_type)
    shared = materialize(_shared_keys(_entries(rows, size, percent, id_type)), "shared-keys", narrow=True)
    costs = materialize(shared.groupBy("key").agg(F.count(F.lit(1)).alias("cost")), "key-costs")
    ranked = shared.filter("skip >= 0").join(costs, "key")
    costly = Window.partitionBy("doc_id", "skip").orderBy(F.desc("cost"), "key")
    paid = ranked.withColumn("__r", F.row_number().over(costly)).filter("__r > shiftright(skip, 1)")
    buckets = materialize(_distinct_buckets(paid.select("key", "doc_id", "size").unionByName(shared.filter("skip < 0").select("key", "doc_id", "size"))),
                          "buckets")

    discard(shared)
    discard(costs)
    ids = buckets.select("doc_id").distinct()
    wanted = rows.join(materialize(ids, "candidates"), "doc_id")

    def sets_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            if len(df):
                yield pd.DataFrame({"doc_id": df["doc_id"], "s": [shingles(t, size).view(np.int64) for t in df["text"]]})

    sets = materialize(wanted.mapInPandas(sets_of, f"doc_id {id_type}, s array<long>"), "shingle-sets")
    def alike(x: str, y: str):
        return 100 * F.least(x, y).cast("long") >= percent * F.greatest(x, y).cast("long")

    def ordered(near: DataFrame) -> DataFrame:
        return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct()

    # Equal sets are linked by their names over the whole table; only one of them in a task has keys.
    named = index.filter("name IS NOT NULL")
    firsts = named.groupBy("name").agg(F.min("doc_id").alias("first"))
    links = named.join(firsts, "name").filter("first <> doc_id").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    pivots = buckets.groupBy("key").agg(F.min_by(F.struct("doc_id", "size"), "doc_id").alias("p"))
    near = buckets.join(pivots, "key").filter((F.col("doc_id") != F.col("p.doc_id")) & alike("size", "p.size")) \
        .select(F.col("doc_id").alias("x"), F.col("p.doc_id").alias("y"))
    judged = materialize(_verified(ordered(near), sets, percent), "judged")
    links = links.unionByName(judged.filter("linked").select("a", "b"))

    # what is left: members of one bucket in different components
    belongs = components(links)
    rows_now = buckets.join(belongs.withColumnRenamed("node", "doc_id"), "doc_id", "left") \
        .withColumn("c", F.coalesce("component", "doc_id"))
    split = rows_now.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("n"),
                                        F.min("doc_id").alias("pivot")).filter("lo < hi")
    left = materialize(rows_now.join(split.select("key", "n", "pivot"), "key")
                       .select("key", "doc_id", "size", "c", "n", "pivot"), "open-buckets")
    few = left.filter(F.col("n") <= PAIRED)
    other = few.select("key", F.col("doc_id").alias("y"), F.col("c").alias("cy"), F.col("size").alias("sy"))
    pairs = ordered(few.join(other, "key").filter((F.col("c") < F.col("cy")) & alike("size", "sy"))
                    .select(F.col("doc_id").alias("x"), "y"))
    judged = materialize(_verified(pairs.join(judged.select("a", "b"), ["a", "b"], "left_anti"), sets, percent), "judged")
    across = _large_buckets(left.filter(F.col("n") > PAIRED).select("pivot", "doc_id", "c").distinct(), sets, percent, id_type)
    links = links.unionByName(judged.filter("linked").select("a", "b")).unionByName(materialize(across, "across"))
    belongs = components(links)
    for done in (buckets, sets, left):
        discard(done)
    return index.select("doc_id", "n_shingles") \
        .join(belongs.withColumnRenamed("node", "doc_id"), "doc_id", "left") \
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
