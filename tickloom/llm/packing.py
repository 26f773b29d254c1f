"""Best-fit packing of tokenised documents into sequences of fixed length, by merging residual bins up a tree.

Documents are tokenised and cut where they lie; the records of the pieces (lengths and checksums, no texts) are dealt evenly over groups of
bounded size, so that every group has the table's mix of lengths whatever the input's order. A group packs its pieces best-fit in
decreasing order. Nearly full bins are final; underfull ones become items of the next round, where fewer groups pack the bins of several,
until one group is left. A bin carries its members, so sequence and offset of a piece need no join.

After best-fit a group has at most one bin of half load or less, as two of them would share one. Only such small bins can still be saved, each by
going into another bin, so with S of them no more than the S emptiest others can receive anything: the rest is final without loss.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize, small_batches

LENGTH = 2048
#: Loads from here on are not carried to another round.
NEARLY_FULL = 2040
#: Pieces of one group of the first round, and bins of one group of a merge round, about. Neither limits what is packed.
GROUP_PIECES, MERGE_BINS = 100_000, 20_000
#: Bins of one load are taken to the next round by whole parts of this many, by hash.
PARTS = 1024
#: Texts of these characters only take the word-by-word way: plain ASCII and accented Latin letters, which every step of the
#: tokeniser treats alike.
_ASCII = re.compile("[\t\n\r\x20-\x7e]*")
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡«»¿À-ÖØ-öø-įı-ňŊ-ž]*")
_LETTERS = "a-zß-öø-įı-ňŊ-ž"
#: The tokeniser's own word pattern, for plain texts in lower case.
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s0-9{_LETTERS}]+")
_FIELDS = ["doc_id", "piece", "start", "length", "ids_crc32"]
_MEMBERS = "array<struct<doc_id:{id},piece:int,start:long,length:long,ids_crc32:long>>"


class WordTokens(dict):
    """Token ids (little-endian unsigned 32-bit, as bytes) of a run of characters between white space, kept for a task.

    No word of the tokeniser spans white space, so a plain text's ids are those of its runs one after the other.
    """

    RUNS = 600_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, run: str) -> bytes:
        ids = []
        for word in (run,) if run.isalpha() else _PIECES.findall(run):
            if not word.isascii():
                word = "".join(w for w, _ in self.bytes.pre_tokenize_str(word))
            ids += [t.id for t in self.model.tokenize(word)]
        found = self[run] = pack_ids(f"<{len(ids)}I", *ids)
        return found

    def of(self, text: str) -> bytes:
        """Ids of a whole text, equal to encoding it in one go."""
        if len(self) > self.RUNS:
            self.clear()
        if "<|" not in text and (_ASCII if text.isascii() else _PLAIN).fullmatch(text):
            return b"".join(map(self.__getitem__, text.lower().split()))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def best_fit(loads: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each item, best-fit in decreasing order (ties in the given order)."""
    bins = np.zeros(len(loads), np.int64)
    room: list[int] = []               # free space of open bins, ascending
    by_room: dict[int, list[int]] = {}
    n = 0
    for i in np.argsort(-loads, kind="stable"):
        need = int(loads[i])
        at = bisect_left(room, need)
        if at == len(room):
            b, free = n, capacity
            n += 1
        else:
            free = room[at]
            b = by_room[free].pop()
            if not by_room[free]:
                del by_room[free], room[at]
        bins[i] = b
        if free > need:
            left = free - need
            if left not in by_room:
                insort(room, left)
                by_room[left] = []
            by_room[left].append(b)
    return bins


def _packer(level: int):
    """Pack the bins of one group (a piece is a bin of its own at first); the members of a bin stay together."""
    def merge(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("bin")
        loads = table["load"].to_numpy().astype(np.int64)
        number = best_fit(loads, LENGTH)
        n = int(number.max()) + 1
        members = table["members"].combine_chunks().take(pa.array(np.argsort(number, kind="stable")))
        sizes = np.bincount(number, table["members"].combine_chunks().value_lengths().to_numpy(), n)
        member = pa.struct([(f.name, f.type) for f in table["members"].type.value_type])
        inside = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), members.flatten().cast(member))
        return pa.table({"bin": (level << 56) + (int(key[0].as_py()) << 32) + np.arange(n),
                         "load": np.bincount(number, loads, n).astype(np.int64), "members": inside.cast(pa.list_(pa.field("element", member)))})
    return merge


def _still_open(bins: DataFrame) -> Column | None:
    """Which bins the next round takes: those of half load or less and as many of the emptiest others, None where nothing can be saved.

    The others are found from the count of bins by load, and by hash part within the last load: at most ``LENGTH`` and ``PARTS`` rows.
    """
    counts = dict(bins.filter(F.col("load") < NEARLY_FULL).groupBy("load").agg(F.count(F.lit(1)).alias("n")).collect())
    small = sum(n for load, n in counts.items() if 2 * load <= LENGTH)
    if not small or small == 1 and LENGTH - min(counts) < min((load for load in counts if 2 * load > LENGTH), default=LENGTH + 1):
        return None
    part = F.pmod(F.xxhash64("bin"), F.lit(PARTS))
    wanted, taken = small, 2 * F.col("load") <= LENGTH
    for load in sorted(load for load in counts if 2 * load > LENGTH):
        if counts[load] > wanted:
            by_part = dict(bins.filter(F.col("load") == load).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
            last = -1
            while wanted > 0:
                last += 1
                wanted -= by_part.get(last, 0)
            return taken | ((F.col("load") == load) & (part <= last))
        wanted -= counts[load]
        taken = taken | (F.col("load") == load)
    return taken


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids end with id 0; null and empty texts are that one id. Only documents longer than ``LENGTH`` are cut.
    ``tokenizer`` is the path of the tokeniser's file, the same on every machine. Rows with equal ids stay separate pieces.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = dict(rows.dtypes)["doc_id"]
    schema = f"bin long, load long, members {_MEMBERS.format(id=id_type)}"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        tokens, slot = WordTokens(tokenizer), TaskContext.get().partitionId() << 32
        for batch in batches:
            found = []
            for at, t in enumerate(batch.column(1).to_pylist()):
                ids = tokens.of(t if t is not None else "") + b"\0\0\0\0"
                for piece, start in enumerate(range(0, len(ids), 4 * LENGTH)):
                    part = ids[start:start + 4 * LENGTH]
                    found.append((at, slot, piece, start // 4, len(part) // 4, zlib.crc32(part)))
                    slot += 1
            at, slots, *fields = np.array(found, np.int64).reshape(-1, 6).T
            fields[0] = fields[0].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(slots), batch.column(0).take(pa.array(at)), *map(pa.array, fields)],
                                             names=["slot", *_FIELDS])

    pieces = materialize(rows.mapInArrow(cut, f"slot long, doc_id {id_type}, piece int, start long, length long, ids_crc32 long"),
                         "pack-pieces")
    whole = pieces.filter(F.col("length") == LENGTH)
    rest = pieces.filter(F.col("length") < LENGTH).select(
        F.col("slot").alias("bin"), F.col("length").alias("load"), F.array(F.struct(*_FIELDS)).alias("members"))
    placed = [whole.select(*_FIELDS, F.col("slot").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]

    def packed_bins(df: DataFrame, per_group: int, level: int) -> tuple[DataFrame, int]:
        groups = max(1, -(-df.count() // per_group))
        dealt = df.groupBy(F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(groups)).alias("g"))
        return materialize(dealt.applyInArrow(_packer(level), schema), f"pack-{level}"), groups

    bins, groups = packed_bins(rest, GROUP_PIECES, 1)
    level = 1
    while groups > 1:
        goes_on = _still_open(bins)
        if goes_on is None:
            break
        placed.append(_places(bins.filter(~goes_on)))
        level += 1
        bins, groups = packed_bins(bins.filter(goes_on), MERGE_BINS, level)
    placed.append(_places(bins))
    packed = placed[0]
    for more in placed[1:]:
        packed = packed.unionByName(more)
    return packed


def _places(bins: DataFrame) -> DataFrame:
    """The members of bins with their sequence and offset."""
    each = bins.select(F.col("bin").alias("sequence_id"), "members", F.posexplode("members").alias("__k", "m"))
    before = F.aggregate(F.slice("members", 1, F.col("__k")), F.lit(0).cast("long"), lambda a, m: a + m["length"])
    return each.select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", before.alias("offset"))
