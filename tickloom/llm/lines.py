"""Line dedup by winnowing: later copies of repeated runs of lines are deleted.

The lines of a text that have a word are hashed. A repeated run counts from ``WINDOW`` lines or ``RUN_WORDS`` words on, so the windows are the stretches
of ``WINDOW`` lines, and the shorter ones that have so many words. Of each window the line of the least hash is selected: equal windows select
equal lines, which is the guarantee of winnowing. The selected lines are the fingerprints. Their positions are joined: a
fingerprint that stands at one position only ends there. At the others the match is extended both ways, line by line, to the windows that selected
it; equal extensions are brought together by the hash of all their lines, and overlapping ones make up the longer runs. The first position, by
(doc_id, line), stays and the later ones go.

A frequent line does not meet in one task: fingerprints repeated within a lot of a task need no join any more, so a lot sends at most one
position of each to it, and extensions are dealt by the hash of their lines.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import materialize, small_batches

WINDOW = 3
RUN_WORDS = 50
#: Windows a task compares among themselves before it sends the first of each kind on.
FLUSH = 1_000_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _digest(data: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def windows(text: str | None, run_words: int = RUN_WORDS) -> list[tuple[int, int, int, int, int, int]]:
    """(fingerprint, its line, match hash in two parts, first line, lines) of each window.

    The fingerprint is the least hash of a line in the window, the last one of equal hashes; the match hash is that of all its lines. A window
    counts its lines from the first to the last one with a word, blank lines between included.
    """
    found, lines = [], []
    for at, line in enumerate((text or "").split("\n")):
        n = len(_WORD.findall(line))
        if n:
            lines.append((_digest(line.encode("utf-8", "surrogatepass")), at, n))
    for k in range(len(lines)):
        n = 0
        for size in range(1, min(WINDOW, len(lines) - k) + 1):
            n += lines[k + size - 1][2]
            if size == WINDOW or n >= run_words:
                part = lines[k:k + size]
                least, at = min((d[0], -at) for d, at, _ in part)
                match = _digest(b"".join(x.to_bytes(8, "little", signed=True) for d, *_ in part for x in d))
                found.append((least, -at, *match, part[0][1], part[-1][1] - part[0][1] + 1))
    return found


_KEYS = ["m1", "m2", "doc_id", "at"]


def _later(df: pd.DataFrame, head: tuple | None) -> tuple[np.ndarray, np.ndarray, tuple]:
    """For rows sorted by ``_KEYS``: is it the first of its match, is it a later one; and the first of the last match."""
    m = df[["m1", "m2"]].to_numpy()
    first = np.concatenate(([head is None or tuple(m[0]) != head[0]], (m[1:] != m[:-1]).any(1)))
    owner = np.maximum.accumulate(np.where(first, np.arange(len(df)), -1))
    d, at = df["doc_id"].to_numpy(), df["at"].to_numpy()
    od = np.where(owner >= 0, d[owner], head[1] if head else d[0])
    oat = np.where(owner >= 0, at[owner], head[2] if head else at[0])
    last = (tuple(m[-1]), od[-1], oat[-1])
    return first, ~first & ~((d == od) & (at == oat)), last


def _repeated_here(fp: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of each row: does its fingerprint stand at two places or more of this lot?"""
    order = np.lexsort((place, fp))
    f, p = fp[order], place[order]
    new = np.concatenate(([True], f[1:] != f[:-1]))
    other = np.concatenate(([False], ~new[1:] & (p[1:] != p[:-1])))
    group = np.cumsum(new) - 1
    out = np.empty(len(fp), bool)
    out[order] = np.bincount(group, other)[group] > 0
    return out


def repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """(doc_id, at, n): ``n`` lines from line ``at`` (from 0) on that also stand at an earlier (doc_id, line)."""
    small_batches(docs.sparkSession)
    rows = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = dict(rows.dtypes)["doc_id"]

    def select(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        before = 0

        def flush() -> pd.DataFrame:
            df = pd.DataFrame(held, columns=["fp", "place", "m1", "m2", "at", "n", "doc_id"]).sort_values(_KEYS, ignore_index=True)
            first, later, _ = _later(df, None)
            sure = _repeated_here(df["fp"].to_numpy(), df["place"].to_numpy())
            lead = first & ~df["fp"].where(first).duplicated().to_numpy()
            return df.drop(columns="place").assign(first=first, later=later, sure=sure, lead=lead)[first | later]

        for df in frames:
            for d, t in zip(df["doc_id"], df["text"]):
                held += [(fp, before + line, *match, d) for fp, line, *match in windows(t, run_words)]
                before += len(t or "") + 1
                if len(held) > FLUSH:
                    yield flush()
                    held = []
        if held:
            yield flush()

    schema = f"fp long, m1 long, m2 long, at int, n int, doc_id {id_type}, first boolean, later boolean, sure boolean, lead boolean"
    found = materialize(rows.mapInPandas(select, schema), "line-windows")
    window = ["m1", "m2", "doc_id", "at", "n"]
    # shuffled joins at every size: no plan rests on how few fingerprints are repeated
    repeated = found.filter("lead").groupBy("fp").agg(F.count(F.lit(1)).alias("lots")).filter("lots > 1").select("fp")
    joined = found.filter("first and not sure").join(repeated.hint("merge"), "fp", "left_semi").select(*window)
    extended = found.filter("first and sure").select(*window).unionByName(joined)

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = None
        for df in frames:
            if len(df):
                _, later, head = _later(df, head)
                yield df.loc[later, ["doc_id", "at", "n"]]

    across = extended.repartition("m1", "m2").sortWithinPartitions(*_KEYS) \
        .mapInPandas(compare, f"doc_id {id_type}, at int, n int")
    return found.filter("later").select("doc_id", "at", "n").unionByName(across)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """The rows of ``docs`` with the repeated runs taken out of ``text``, and n_lines, n_removed and n_runs added.

    A line goes when it lies in a run of consecutive lines with a word that stand in the same order at an earlier (doc_id, line), and the run has
    ``WINDOW`` lines or ``run_words`` words, or more; blank lines inside a run go with it. The
    other lines stay as they are, joined by one ``\\n``. Null texts stay null (no lines), empty ones have one line.
    Rows that repeat an id do not count as copies of each other; what is repeated elsewhere goes from all of them. Rows
    without an id have no place in the order: they take no part and stay as they are.
    Added columns replace columns of the same name.
    """
    kept = docs.drop("n_lines", "n_removed", "n_runs")
    spans = materialize(repeated_runs(docs, doc_id, text, run_words).groupBy(F.col("doc_id").alias("__id"))
                        .agg(F.collect_list(F.struct("at", "n")).alias("__spans")), "line-runs", narrow=True)

    @F.pandas_udf("text string, n_lines long, n_removed long, n_runs long")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, found in zip(texts, spans):
            if t is None:
                out.append((None, 0, 0, 0))
                continue
            lines = t.split("\n")
            gone = np.zeros(len(lines) + 1, bool)
            for s in found if found is not None else ():
                gone[s["at"]:min(s["at"] + s["n"], len(lines))] = True
            runs = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum())
            out.append(("\n".join(x for x, g in zip(lines, gone) if not g) if runs else t,
                        len(lines), int(gone[:-1].sum()), runs))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_removed", "n_runs"])

    # shuffled at every size as well; adaptive execution splits it
    joined = kept.join(spans.hint("merge"), F.col(doc_id) == F.col("__id"), "left") \
        .withColumn("__cut", cut(F.col(text), F.col("__spans")))
    columns = [F.col("__cut.text").alias(c) if c == text else F.col(c) for c in kept.columns]
    return joined.select(*columns, "__cut.n_lines", "__cut.n_removed", "__cut.n_runs")
