"""Words of a corpus under dense ids, by an exchange between lots of texts and shards of the vocabulary.

A lot is some million tokens of neighbouring documents with a dictionary of its own. It sends each of its distinct words once, with its
count, to the shard of the word's hash; the shard knows words of all lots, counts them exactly by the words themselves and
answers with ids and counts. So a frequent word costs a lot one entry, whatever its share of the tokens, and no table of all
words is ever in one place. Arrays travel as compressed byte planes.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import LOWER, UPPER, TEXT_ROWS, store

#: The token that ends a text or a piece: this byte is in no UTF-8 text. Its code in a lot and its id are 0.
MARK = b"\xff"
#: Tokens of a lot; entries of a shard, about; lots of one Arrow batch.
LOT_TOKENS, SHARD_ENTRIES, LOT_ROWS = 1 << 20, 1 << 19, 4
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
LOTS = ("lot long, ids array<string>, sizes binary, flags binary, codes binary, n_tokens long, groups array<string>, words binary, "
        "owner binary, counts binary, n_words long")
ANSWERS = "lot long, shard int, kind int, x binary, y binary, grp string, words binary, total long, n_distinct long"


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 as byte planes, compressed."""
    import zstandard
    values = np.asarray(values)
    width = 4 if not values.size or int(values.max()) < 1 << 32 else 8
    planes = np.ascontiguousarray(values.astype(f"<u{width}")).view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    import zstandard
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two numbers."""
    with np.errstate(over="ignore"):
        h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def gather(docs: DataFrame, breaks: str = "", end: bool = False, keep_ids: bool = False, lot_tokens: int = LOT_TOKENS) -> DataFrame:
    """Lots of ``docs`` (id, text, grp, counted): words between white space, A-Z in lower case, null texts as empty.

    Characters of ``breaks`` become marks, ``end`` puts a mark behind every text. Only words of ``counted`` documents are counted.
    """
    if not set(breaks) <= {chr(c) for c in range(128)}:
        raise ValueError("breaks must be ASCII characters")
    table = bytearray(_LOWER)
    for c in breaks:
        table[ord(c)] = MARK[0]
    table = bytes(table)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        first, number = TaskContext.get().partitionId() << 32, count()
        state = {}

        def start() -> None:
            codes = count(1)
            state.update(books=defaultdict(lambda: defaultdict(codes.__next__, {MARK: 0})), ids=[], flags=[], parts=[], n=0)

        def lot() -> pd.DataFrame:
            groups = sorted(state["books"])
            n = sum(len(b) - 1 for b in state["books"].values())
            words, owner = np.empty(n, object), np.zeros(n, np.int64)
            for k, g in enumerate(groups):
                book = state["books"][g]
                at = np.fromiter(book.values(), np.int64, len(book))
                own = np.empty(len(book), object)
                own[:] = list(book)
                words[at[at > 0] - 1], owner[at[at > 0] - 1] = own[at > 0], k
            counted = [p for p, f in zip(state["parts"], state["flags"]) if f]
            counts = np.bincount(np.concatenate(counted), minlength=n + 1)[1:] if counted else np.zeros(n, np.int64)
            return pd.DataFrame({
                "lot": [first + next(number)], "ids": [state["ids"] if keep_ids else []], "sizes": [pack([len(p) for p in state["parts"]])],
                "flags": [pack(state["flags"])], "codes": [pack(np.concatenate(state["parts"]))], "n_tokens": [state["n"]],
                "groups": [groups], "words": [b" ".join(words)], "owner": [pack(owner)], "counts": [pack(counts)], "n_words": [n]})

        start()
        for df in frames:
            for d, text, g, counted in zip(df["id"], df["text"], df["grp"], df["counted"]):
                data = text.encode("utf-8", "surrogatepass").translate(table) if text else b""
                if breaks:
                    data = data.replace(MARK, b" \xff ")
                tokens = data.split()
                if end:
                    tokens.append(MARK)
                if not tokens:
                    continue
                if not end and tokens[-1] is not MARK:
                    tokens.append(MARK)
                state["parts"].append(np.fromiter(map(state["books"][g].__getitem__, tokens), np.uint32, len(tokens)))
                state["ids"].append(d)
                state["flags"].append(bool(counted))
                state["n"] += len(tokens)
                if state["n"] >= lot_tokens:
                    yield lot()
                    start()
        if state["parts"]:
            yield lot()

    return store(docs.select(F.col("id").cast("string").alias("id"), "text", "grp", "counted").mapInPandas(run, LOTS), "text-lots", TEXT_ROWS)


def shards_for(entries: int | None) -> int:
    return max(1, -(-(entries or 0) // SHARD_ENTRIES))


def _shard_of(words: list[bytes], owner: np.ndarray, groups, shards: int) -> np.ndarray:
    seeds = [zlib.crc32(g.encode("utf-8", "surrogatepass")) for g in groups]
    hashes = map(zlib.crc32, words, map(seeds.__getitem__, owner.tolist()))
    return (np.fromiter(hashes, np.uint32, len(words)) % np.uint32(shards)).astype(np.int64)


def by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions in ascending order) of every shard that occurs."""
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        yield int(shard[part[0]]), part


def look_up(lots: DataFrame, shards: int, least: int = 0, listed: bool = True) -> DataFrame:
    """Answers to the lots (kind 0: ids and counts of a lot's words of a shard, in the lot's order) and, under lot -1, the
    vocabulary of every shard and group: words, ids, counts, with ``total`` tokens and ``n_distinct`` words that are counted.

    Words counted fewer than ``least`` times have the id 0 and are not listed; nor is any word without ``listed``. Ids are from 1, small ones for frequent words.
    """
    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for r in df.itertuples():
                if not r.n_words:
                    continue
                words, owner, counts = r.words.split(b" "), unpack(r.owner), unpack(r.counts)
                objects = np.array(words, object)
                yield pd.DataFrame([(shard, r.lot, b" ".join(objects[at]), pack(owner[at]), list(r.groups), pack(counts[at]))
                                    for shard, at in by_shard(_shard_of(words, owner, r.groups, shards))],
                                   columns=["shard", "lot", "words", "owner", "groups", "counts"])

    def answer(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        shard, codes = int(key[0]), count()
        books, own, numbers = defaultdict(lambda: defaultdict(codes.__next__)), [], []
        for r in df.itertuples():
            words, owner = np.array(r.words.split(b" "), object), unpack(r.owner)
            found = np.empty(len(words), np.int64)
            for k, g in enumerate(r.groups):
                at = np.flatnonzero(owner == k)
                if len(at):
                    found[at] = np.fromiter(map(books[g].__getitem__, words[at]), np.int64, len(at))
            own.append(found)
            numbers.append(unpack(r.counts))
        totals = np.zeros(next(codes), np.int64)
        np.add.at(totals, np.concatenate(own), np.concatenate(numbers))
        ids = np.empty(len(totals), np.int64)
        ids[np.argsort(-totals, kind="stable")] = np.arange(len(totals)) * shards + shard + 1
        ids[totals < least] = 0
        rows = [(int(lot), shard, 0, pack(ids[o]), pack(totals[o]), None, None, None, None) for lot, o in zip(df["lot"], own)]
        for g, book in books.items():
            at = np.fromiter(book.values(), np.int64, len(book))
            words = np.array(list(book), object)
            named = (totals[at] >= max(least, 1)) & listed
            rows.append((-1, shard, 0, pack(ids[at[named]]), pack(totals[at[named]]), g, b" ".join(words[named]),
                         int(totals[at].sum()), int((totals[at] > 0).sum())))
        return pd.DataFrame(rows, columns=["lot", "shard", "kind", "x", "y", "grp", "words", "total", "n_distinct"])

    messages = lots.mapInPandas(send, "shard int, lot long, words binary, owner binary, groups array<string>, counts binary")
    return store(messages.groupBy("shard").applyInPandas(answer, ANSWERS), "word-answers", LOT_ROWS)


def resolved(lot, answers: pd.DataFrame, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts by the lot's codes; the mark's are 0."""
    ids, totals = np.zeros(lot.n_words + 1, np.int64), np.zeros(lot.n_words + 1, np.int64)
    if lot.n_words:
        found = {r.shard: r for r in answers.itertuples() if r.kind == 0}
        for shard, at in by_shard(_shard_of(lot.words.split(b" "), unpack(lot.owner), lot.groups, shards)):
            ids[at + 1], totals[at + 1] = unpack(found[shard].x), unpack(found[shard].y)
    return ids, totals


def vocabulary(answers: DataFrame) -> DataFrame:
    """(grp, id, word, n) of every listed word."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for r in df.itertuples():
                ids = unpack(r.x)
                if len(ids):
                    yield pd.DataFrame({"grp": r.grp, "id": ids, "n": unpack(r.y),
                                        "word": [w.decode("utf-8", "surrogatepass") for w in r.words.split(b" ")]})
    return answers.filter("lot = -1").select("grp", "x", "y", "words").mapInPandas(run, "grp string, id long, n long, word string")
