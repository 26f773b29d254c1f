"""Removal of byte strings that occur more than once, by prefix doubling over synchronised positions.

Doubling over every byte position would sort many times the input. Instead the first rank is that of ``GRAM`` bytes, and only at
the positions that win a window: every string of ``LENGTH`` bytes is named by its smallest gram, so equal strings meet under
equal ranks. Spark sorts the ranks and drops the unique ones. Neighbouring strings of one name form a block; blocks that
are equal as a whole are settled together. What is left doubles to the full length: positions are sorted by the pair of ranks
of their two halves, and equal neighbours are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import materialize, small_batches
from .jaccard import _POWERS, mixed

_U = np.uint64
LENGTH, GRAM = 200, 40
_WINDOW = LENGTH - GRAM + 1
#: Text is ranked in stretches of this many string starts.
STRETCH = 1 << 20
#: Blocks a task settles among themselves before it sends one of each kind on.
FLUSH = 1_500_000
#: Blocks whose strings are sorted together.
LOT = 4000
_BYTES = np.random.default_rng(31).integers(1, 2**63, 256, dtype=np.uint64)


def _sums(data: np.ndarray) -> np.ndarray:
    """Running hash sums; the hash of bytes i to j is (sums[j] - sums[i]) scaled back by the position i."""
    up, _ = _POWERS.of(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTES[data] * up[:len(data)], out=total[1:])
    return total


def _hash(total: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
    return mixed((total[end] - total[start]) * _POWERS.of(len(total))[1][start], salt)


def _blocks(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks of string starts with one smallest gram: gram rank, content rank, first start, number of starts."""
    out = []
    for at in range(0, len(data) - LENGTH + 1, STRETCH):
        part = data[at:at + STRETCH + LENGTH - 1]
        total, n = _sums(part), len(part)
        i = np.arange(n - GRAM + 1)
        g = _hash(total, i, i + GRAM, 1)
        ranked = (g & ~_U((1 << 24) - 1)) | i.astype(_U)   # the leftmost of equal ranks wins
        size = -(-len(ranked) // _WINDOW) * _WINDOW
        padded = np.full(size, np.iinfo(_U).max, _U)
        padded[:len(ranked)] = ranked
        rows = padded.reshape(-1, _WINDOW)
        before = np.minimum.accumulate(rows, 1).ravel()
        after = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(after[:n - LENGTH + 1], before[_WINDOW - 1:len(ranked)])
        lo = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        hi = np.concatenate((lo[1:], [len(least)])) - 1
        best = (least[lo] & _U((1 << 24) - 1)).astype(np.int64)
        content = _hash(total, lo, hi + LENGTH, 2) ^ mixed(((hi - lo) * LENGTH + best - lo).astype(_U), 3)
        out.append((g[best], content, lo + at, hi - lo + 1))
    return tuple(np.concatenate(x) for x in zip(*out))


def _as_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)



def _first_ranks(rows: DataFrame, id_type: str) -> DataFrame:
    """Blocks by document. Of blocks equal within a task one is sent on; all of them are already known to be copies."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, parts, held = [], [], 0

        def flush() -> pd.DataFrame:
            own = np.repeat(np.arange(len(ids)), [len(p[0]) for p in parts])
            g, content, at, n = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((content, g))
            sg, sc = g[order], content[order]
            same = (sg[1:] == sg[:-1]) & (sc[1:] == sc[:-1])
            twin = np.zeros(len(g), bool)
            twin[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
            follower = np.zeros(len(g), bool)
            follower[order] = np.concatenate(([False], same))
            return pd.DataFrame({"doc_id": pd.Series(ids).iloc[own].to_numpy(), "g": g.view(np.int64),
                                 "content": content.view(np.int64), "at": at, "n": n.astype(np.int32),
                                 "twin": twin, "sent": ~follower})

        for df in frames:
            for d, text in zip(df["doc_id"], df["text"]):
                data = _as_bytes(text)
                if len(data) < LENGTH:
                    continue
                ids.append(d)
                parts.append(_blocks(data))
                held += len(parts[-1][0])
                if held > FLUSH:
                    yield flush()
                    ids, parts, held = [], [], 0
        if held:
            yield flush()

    return rows.mapInPandas(run, f"doc_id {id_type}, g long, content long, at long, n int, twin boolean, sent boolean")


def _runs(df: DataFrame, keys: list[str], inner: list[str]) -> DataFrame:
    """Rows whose keys occur more than once (sorted and streamed), with ``copies``: the inner keys occur more than once too,
    and ``head``: first of its inner run."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail, joined, twin, head = None, False, False, True
        for df in frames:
            if not len(df):
                continue
            if tail is not None:
                df = pd.concat([tail, df], ignore_index=True)
            k = np.stack([df[c].to_numpy() for c in keys], 1)
            same = (k[1:] == k[:-1]).all(1)
            alike = same & (np.stack([df[c].to_numpy() for c in inner], 1)[1:]
                            == np.stack([df[c].to_numpy() for c in inner], 1)[:-1]).all(1) if inner else same
            shared = np.concatenate((same, [False])) | np.concatenate(([joined], same))
            copies = np.concatenate((alike, [False])) | np.concatenate(([twin], alike))
            heads = np.concatenate(([head], ~alike))
            done = df.iloc[:-1].assign(copies=copies[:-1], head=heads[:-1])[shared[:-1]]
            tail, joined, twin, head = df.iloc[-1:], bool(shared[-1]), bool(copies[-1]), bool(heads[-1])
            yield done
        if tail is not None and joined:
            yield tail.assign(copies=twin, head=head)

    fields = ", ".join(f"{c} {t}" for c, t in df.dtypes)
    return df.repartition(*keys).sortWithinPartitions(*keys, *inner) \
        .mapInPandas(run, f"{fields}, copies boolean, head boolean")


def _contexts(df: DataFrame, id_type: str) -> DataFrame:
    """The bytes behind the strings of every wanted block."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = []
            for d, text, blocks in zip(df["doc_id"], df["text"], df["blocks"]):
                data = (text or "").encode("utf-8", "surrogatepass")
                out += [(x["g"], d, x["at"], data[x["at"]:x["at"] + x["n"] + LENGTH - 1]) for x in blocks
                        if x["at"] + x["n"] + LENGTH - 1 <= len(data)]
            if out:
                yield pd.DataFrame(out, columns=["g", "doc_id", "at", "bytes"])

    return df.mapInPandas(run, f"g long, doc_id {id_type}, at long, bytes binary")


def _pairs_of_ranks(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Row number, start, and the ranks of both halves of every string in some contexts."""
    half = LENGTH // 2
    data = np.frombuffer(b"".join(rows["bytes"]), np.uint8)
    size = rows["bytes"].map(len).to_numpy()
    n = size - LENGTH + 1
    row = np.repeat(np.arange(len(rows)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    i = np.repeat(np.cumsum(size) - size, n) + step
    total = _sums(data)
    return row, rows["at"].to_numpy()[row] + step, _hash(total, i, i + half, 4), _hash(total, i + half, i + LENGTH, 4)


def _second_ranks(contexts: DataFrame, id_type: str) -> DataFrame:
    """Strings of the full length that repeat, as (doc_id, at, n) with null ranks.

    Contexts are streamed in the order of their first rank, a bounded lot at a time, and their strings sorted by the pair of ranks of
    their halves. Strings of a first rank that fills more than a lot are handed on with their ranks, one of each kind of a
    lot, to be compared once more.
    """
    def settle(rows: pd.DataFrame, whole: bool) -> pd.DataFrame:
        row, at, a, b = _pairs_of_ranks(rows)
        order = np.lexsort((at, row, b, a))
        same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
        twin, follower = np.zeros(len(a), bool), np.zeros(len(a), bool)
        twin[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
        follower[order] = np.concatenate(([False], same))
        # neighbouring starts of a context make up one row
        k = np.flatnonzero(twin)
        new = np.concatenate(([True], (np.diff(k) > 1) | (np.diff(row[k]) > 0))) if len(k) else np.zeros(0, bool)
        first = k[new]
        n = np.diff(np.concatenate((np.flatnonzero(new), [len(k)])))
        ids = rows["doc_id"].to_numpy()
        done = pd.DataFrame({"doc_id": ids[row[first]], "at": at[first], "n": n.astype(np.int32), "a": None, "b": None})
        if whole:
            return done
        on = np.flatnonzero(~follower)
        more = pd.DataFrame({"doc_id": ids[row[on]], "at": at[on], "n": np.ones(len(on), np.int32),
                             "a": a[on].view(np.int64), "b": b[on].view(np.int64)})
        return pd.concat([done.astype({"a": "Int64", "b": "Int64"}), more.astype({"a": "Int64", "b": "Int64"})])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, split = None, None
        for df in frames:
            held = df if held is None else pd.concat([held, df], ignore_index=True)
            while len(held) >= LOT:
                g = held["g"].to_numpy()
                last = 0 if g[0] == g[-1] else int(np.flatnonzero(g != g[-1])[-1]) + 1
                cut = last or LOT
                lot, held = held.iloc[:cut], held.iloc[cut:].reset_index(drop=True)
                if not last:
                    split = g[-1]
                    yield settle(lot, False)
                    continue
                mine = lot["g"].to_numpy() == split
                if split is not None and mine.any():
                    yield settle(lot[mine], False)
                    lot, split = lot[~mine], None
                if len(lot):
                    yield settle(lot, True)
        if held is not None and len(held):
            mine = held["g"].to_numpy() == split if split is not None else np.zeros(len(held), bool)
            if mine.any():
                yield settle(held[mine], False)
            if not mine.all():
                yield settle(held[~mine], True)

    return contexts.repartition("g").sortWithinPartitions("g") \
        .mapInPandas(run, f"doc_id {id_type}, at long, n int, a long, b long")


def repeated_strings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, at, n): starts ``at`` to ``at + n - 1`` of strings of ``LENGTH`` bytes that also start anywhere else.

    Texts are UTF-8 bytes, null is empty; matches never cross documents. Starts may be listed more than once. Ids should be unique:
    a start is told by its id, so rows that repeat an id share what is found. Rows without an id take no part and stay whole.
    """
    small_batches(docs.sparkSession)
    id_type = dict(docs.dtypes)[doc_id]
    rows = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    first = materialize(_first_ranks(rows, id_type), "first-ranks")
    sent = first.filter("sent").select("g", "content", "doc_id", "at", "n", "twin")
    ranked = materialize(_runs(sent, ["g"], ["content"]), "shared-ranks", narrow=True)
    settled = first.filter("twin").select("doc_id", "at", "n") \
        .unionByName(ranked.filter("copies").select("doc_id", "at", "n"))
    # groups whose blocks differ, unless every kind of block has copies
    mixed_groups = ranked.filter("head").groupBy("g").agg(
        F.count(F.lit(1)).alias("kinds"), F.min((F.col("copies") | F.col("twin")).cast("int")).alias("known")) \
        .filter("kinds > 1 and known = 0").select("g")
    wanted = materialize(ranked.filter("head").join(mixed_groups, "g").groupBy("doc_id")
                         .agg(F.collect_list(F.struct("g", "at", "n")).alias("blocks")), "open-blocks")
    second = materialize(_second_ranks(_contexts(rows.join(wanted, "doc_id"), id_type), id_type), "second-ranks")
    split = second.filter("a is not null").select("a", "b", "doc_id", "at")
    doubled = materialize(_runs(split, ["a", "b"], []).select("doc_id", "at", F.lit(1).alias("n")), "split-ranks", narrow=True)
    return settled.unionByName(second.filter("a is null").select("doc_id", "at", "n")).unionByName(doubled)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (bytes), kept_sha256.

    Removed is every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else, same document included, judged on
    the input. Null texts are empty.
    """
    id_type = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    starts = materialize(repeated_strings(docs, doc_id, text).groupBy("doc_id")
                         .agg(F.collect_list(F.struct("at", "n")).alias("starts")), "repeats", narrow=True)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = []
            for d, text, found in zip(df["doc_id"], df["text"], df["starts"]):
                data = _as_bytes(text)
                if found is None:
                    out.append((d, len(data), 0, 0, data.tobytes(), hashlib.sha256(data).hexdigest()))
                    continue
                edge = np.zeros(len(data) + 1, np.int64)
                for x in found:
                    edge[min(x["at"], len(data))] += 1
                    edge[min(x["at"] + x["n"] + LENGTH - 1, len(data))] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum())
                kept = data[~gone].tobytes()
                out.append((d, len(data), int(gone.sum()), spans, kept, hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return rows.join(starts, "doc_id", "left").mapInPandas(
        cut, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
