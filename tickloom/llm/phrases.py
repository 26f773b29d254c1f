"""Collocations from a weighted de Bruijn graph of word n-grams.

Words, pairs and triples of neighbours that occur fewer than ``least`` times are in no candidate, so pieces are cut there first (exact,
since a phrase occurs at most as often as its parts). What is left are runs: at a rare pair one ends before its second word, at a
rare triple one ends with its second word and the next begins with it, so every longer gram lies in one run. Their longest grams are the edges of the graph, weighted
by their occurrences; an edge leads from the node of its first words to the node of its last. Shorter counts are not taken from the
text: a gram occurs as often as the grams one word longer that it begins, plus the runs that end with it. Unary paths of edges
are joined to passages; the nodes inside one lie in an equally frequent longer phrase and are no results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import lexicon
from .common import discard, materialize, store

BREAKS = ".,;:!?\n\x0b\x0c\r"
LONGEST = 5
_W = [f"w{k}" for k in range(1, LONGEST + 1)]


#: Runs of a lot (kind 0: ids, runs parted by 0) and messages to a shard (kind 1: the words of distinct grams, and their counts).
_STAGE = "kind int, lot long, shard int, parts array<binary>, n binary"


def _distinct(tokens: np.ndarray, reach: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct grams of up to ``size`` words that begin at some places, the one at place p with ``reach[p]`` words:
    a place of each, the gram of every place (-1: none), and how often each occurs."""
    known, code = np.unique(np.concatenate((tokens, np.zeros(size, np.int64))), return_inverse=True)
    places = np.flatnonzero(reach)
    gram = code[places]
    for j in range(1, size):
        gram = np.unique(gram * len(known) + np.where(reach[places] > j, code[places + j], 0), return_inverse=True)[1]
    _, one, back, n = np.unique(gram, return_index=True, return_inverse=True, return_counts=True)
    number = np.full(len(tokens), -1)
    number[places] = back
    return places[one], number, n


def _grams_of(tokens: np.ndarray, size: int, shards: int):
    """The distinct grams of exactly ``size`` words: places, number by place, counts and shards."""
    inside = np.concatenate((tokens > 0, np.zeros(size, bool)))
    whole = np.logical_and.reduce([inside[j:j + len(tokens)] for j in range(size)])
    one, number, n = _distinct(tokens, np.where(whole, size, 0), size)
    h = tokens[one]
    for j in range(1, size):
        h = lexicon.mixed(h, tokens[one + j])
    return one, number, n, (np.asarray(h).astype(np.uint64) % np.uint64(shards)).astype(np.int64)


def _stage(lot, tokens: np.ndarray, size: int, shards: int) -> pd.DataFrame:
    """A lot's runs, and its grams of ``size`` words to their shards."""
    rows = [(0, lot, 0, [lexicon.pack(tokens)], None)]
    one, _, n, shard = _grams_of(tokens, size, shards)
    rows += [(1, lot, s, [lexicon.pack(tokens[one[at] + j]) for j in range(size)], lexicon.pack(n[at])) for s, at in lexicon.by_shard(shard)]
    return pd.DataFrame(rows, columns=["kind", "lot", "shard", "parts", "n"])


def _runs_of_words(lots: DataFrame, answers: DataFrame, word_shards: int, shards: int) -> DataFrame:
    """Runs of words that have an id."""
    def run(lot_df: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame(columns=["kind", "lot", "shard", "parts", "n"])]
        for lot in lot_df.itertuples():
            ids, _ = lexicon.resolved(lot, found, word_shards)
            tokens = ids[lexicon.unpack(lot.codes)]
            near = np.concatenate(([0], tokens, [0]))
            # Words without a neighbour are in no phrase; of several breaks one is enough.
            alone = (tokens > 0) & (near[:-2] == 0) & (near[2:] == 0)
            tokens = tokens[~alone]
            tokens = tokens[(tokens > 0) | np.concatenate(([False], tokens[:-1] > 0))]
            out.append(_stage(lot.lot, tokens, 2, shards))
        return pd.concat(out)
    return store(lots.groupBy("lot").cogroup(answers.groupBy("lot")).applyInPandas(run, _STAGE), "word-runs", lexicon.LOT_ROWS)


def _merged(df: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """The words of a shard's messages, their order, which are new in it, the total of each distinct gram, and the messages' lengths."""
    words = [np.concatenate([lexicon.unpack(p[j]) for p in df["parts"]]) for j in range(len(df["parts"].iloc[0]))]
    each = [lexicon.unpack(x) for x in df["n"]]
    order = np.lexsort(words)
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([w[order][1:] != w[order][:-1] for w in words])
    return words, order, new, np.add.reduceat(np.concatenate(each)[order], np.flatnonzero(new)), [len(x) for x in each]


def _frequent(stage: DataFrame, least: int) -> DataFrame:
    """(lot, shard, bits): for a lot's grams of a shard, in the lot's order, whether they occur ``least`` times in all."""
    def answer(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        _, order, new, totals, each = _merged(df)
        often = np.empty(len(order), bool)
        often[order] = (totals >= least)[np.cumsum(new) - 1]
        parts = np.split(often, np.cumsum(each)[:-1])
        return pd.DataFrame([(lot, int(key[0]), lexicon.pack(p)) for lot, p in zip(df["lot"], parts) if p.any()], columns=["lot", "shard", "bits"])

    answers = stage.filter("kind = 1").groupBy("shard").applyInPandas(answer, "lot long, shard int, bits binary")
    return store(answers, "gram-answers", lexicon.LOT_ROWS)


def _often(tokens: np.ndarray, answers: pd.DataFrame, size: int, shards: int) -> np.ndarray:
    """For every place whether a frequent gram of ``size`` words begins there."""
    one, number, _, shard = _grams_of(tokens, size, shards)
    often = np.zeros(len(one) + 1, bool)
    bits = dict(zip(answers["shard"], answers["bits"]))
    for s, at in lexicon.by_shard(shard):
        if s in bits:
            often[at] = lexicon.unpack(bits[s]) > 0
    return often[number]


def _runs_of_pairs(stage: DataFrame, answers: DataFrame, shards: int, next_shards: int) -> DataFrame:
    """Runs of frequent pairs, cut between the words of the others."""
    def run(lot_df: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame(columns=["kind", "lot", "shard", "parts", "n"])]
        for lot in lot_df.itertuples():
            tokens = lexicon.unpack(lot.parts[0])
            goes_on = _often(tokens, found, 2, shards)
            kept = goes_on | np.concatenate(([False], goes_on[:-1]))
            tokens = np.insert(tokens[kept], np.flatnonzero(~goes_on[kept]) + 1, 0)
            out.append(_stage(lot.lot, tokens, 3, next_shards))
        return pd.concat(out)
    runs = stage.filter("kind = 0").groupBy("lot").cogroup(answers.groupBy("lot")).applyInPandas(run, _STAGE)
    return store(runs, "pair-runs", lexicon.LOT_ROWS)


def _grams(stage: DataFrame, answers: DataFrame, shards: int) -> DataFrame:
    """Edges (``LONGEST`` words) and the shorter grams that end a run of frequent triples, with their counts; absent words are 0."""
    def send(lot_df: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for lot in lot_df.itertuples():
            tokens = lexicon.unpack(lot.parts[0])
            triple = np.concatenate((_often(tokens, found, 3, shards), np.zeros(LONGEST, bool)))
            padded, m = np.concatenate((tokens, np.zeros(LONGEST, np.int64))), len(tokens)
            goes_on = (tokens > 0) & (padded[1:m + 1] > 0)
            reach = np.where(goes_on, 2, 0)
            for j in range(LONGEST - 2):
                goes_on = goes_on & triple[j:j + m]
                reach = reach + goes_on
            one, _, n = _distinct(tokens, reach, LONGEST)
            words = [np.where(reach[one] > j, padded[one + j], 0) for j in range(LONGEST)]
            shard = (reduce(lexicon.mixed, words).astype(np.uint64) % np.uint64(shards)).astype(np.int64)
            rows += [(s, [lexicon.pack(w[at]) for w in words], lexicon.pack(n[at])) for s, at in lexicon.by_shard(shard)]
        return pd.DataFrame(rows, columns=["shard", "parts", "n"])

    def add(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        words, order, new, totals, _ = _merged(df)
        return pd.DataFrame({c: w[order[new]] for c, w in zip(_W, words)} | {"n": totals})

    messages = (stage.filter("kind = 0").groupBy("lot").cogroup(answers.groupBy("lot"))
                .applyInPandas(send, "shard int, parts array<binary>, n binary"))
    return messages.groupBy("shard").applyInPandas(add, ", ".join(f"{w} long" for w in [*_W, "n"]))


def flows(grams: DataFrame) -> list[DataFrame]:
    """Counts of the grams of 2, 3, ... words: node flow from the grams one word longer, plus the runs that end there."""
    level = grams.filter(F.col(_W[-1]) > 0)
    found = [level]
    for k in range(LONGEST - 1, 1, -1):
        ends = grams.filter((F.col(_W[k]) == 0) & (F.col(_W[k - 1]) > 0))
        level = (level.select(*_W[:k], "n").unionByName(ends.select(*_W[:k], "n"))
                 .groupBy(*_W[:k]).agg(F.sum("n").alias("n")))
        found.append(level)
    return [f.select(*_W[:k], "n") for k, f in zip(range(LONGEST, 1, -1), found)][::-1]


def passages(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Unary paths: (path, place, edge's words, n). ``edges`` and ``nodes`` are those with at least the least count.

    Two edges belong together where the node between them occurs only before the one and behind the other: all three are
    equally frequent. Paths are told by their first edge, found by doubled jumps to the edges before.
    """
    spark = edges.sparkSession
    rows = materialize(edges.withColumn("edge", F.monotonically_increasing_id()), "edges")
    node = [f"v{k}" for k in range(1, LONGEST)]
    before = rows.select("edge", "n", *(F.col(w).alias(v) for w, v in zip(_W[1:], node)))
    after = rows.select(F.col("edge").alias("next"), "n", *(F.col(w).alias(v) for w, v in zip(_W, node)))
    flow = nodes.select("n", *(F.col(w).alias(v) for w, v in zip(_W, node)))
    links = before.join(flow, [*node, "n"]).join(after, [*node, "n"]).select(F.col("next").alias("edge"), F.col("edge").alias("prev"))
    jumps = materialize(rows.select("edge").join(links, "edge", "left")
                        .select("edge", F.coalesce("prev", "edge").alias("head"), F.col("prev").isNotNull().cast("long").alias("place")), "jumps")
    while True:
        ahead = jumps.select(F.col("edge").alias("head"), F.col("head").alias("far"), F.col("place").alias("more"))
        moved = materialize(jumps.join(ahead, "head").select("edge", F.col("far").alias("head"), (F.col("place") + F.col("more")).alias("place"),
                                                             (F.col("more") > 0).alias("moved")), "jumps")
        jumps = moved.drop("moved")
        if not moved.filter("moved").take(1):
            break
    return rows.join(jumps, "edge").select(F.col("head").alias("path"), "place", *_W, "n")


def _key(columns: list[Column]) -> Column:
    return F.array(*columns)


def phrases(docs: DataFrame, group: str = "lang", least: int = 100, share: int = 100, top: int | None = 2000, null_group: str = "und") -> DataFrame:
    """(group, rank, phrase, a, l, r, n, score, path_words) of the best ``top`` phrases of every group, all for None.

    ``path_words`` are the words of the passage that a phrase of ``LONGEST`` words is part of, else null. Candidates inside a longer one
    with at least ``share`` per cent of their count go. Null texts are empty, null groups are ``null_group``; repeated rows count as
    often as they occur; ties go to the more frequent, then to the smaller phrase in byte order. Ids are not used. An empty
    table gives no row.
    """
    if not 0 < share <= 100:
        raise ValueError("share is a percentage")
    rows = docs.select(F.lit(None).cast("string").alias("id"), F.col("text"), F.coalesce(F.col(group).cast("string"), F.lit(null_group)).alias("grp"),
                       F.lit(True).alias("counted"))
    lots = lexicon.gather(rows, breaks=BREAKS)
    sizes = lots.agg(F.sum("n_words"), F.sum("n_tokens")).first()
    word_shards, gram_shards = lexicon.shards_for(sizes[0]), lexicon.shards_for((sizes[1] or 0) // 4)
    answers = lexicon.look_up(lots, word_shards, least)
    words = materialize(lexicon.vocabulary(answers), "vocabulary")
    sums = answers.filter("lot = -1").groupBy("grp").agg(F.sum("total").alias("all"))
    of_words = _runs_of_words(lots, answers.filter("lot >= 0"), word_shards, gram_shards)
    discard(lots)
    of_pairs = _runs_of_pairs(of_words, _frequent(of_words, least), gram_shards, gram_shards)
    discard(of_words)
    grams = _grams(of_pairs, _frequent(of_pairs, least), gram_shards)
    grams = materialize(grams, "de-bruijn")

    frequent = [materialize(f.filter(F.col("n") >= least), f"grams-{k}") for k, f in enumerate(flows(grams), 2)]
    paths = materialize(passages(frequent[-1], frequent[-2]), "passages")
    longest = paths.groupBy("path").agg((F.max("place") + LONGEST).cast("int").alias("path_words"))
    results = [paths.join(longest, "path").select(_key([F.col(w) for w in _W]).alias("g"), F.col("n").alias("a"), "path_words")]
    for k in range(LONGEST - 1, 1, -1):
        here, longer = frequent[k - 2], frequent[k - 1]
        g, inside = _key([F.col(w) for w in _W[:k]]), []
        if k == LONGEST - 1:  # nodes inside a passage, and those at an end of one
            inside.append(paths.filter("place > 0").select(g.alias("g"), F.col("n").alias("most")))
        inside += [longer.select(_key([F.col(w) for w in part]).alias("g"), F.col("n").alias("most")) for part in (_W[:k], _W[1:k + 1])]
        most = reduce(DataFrame.unionByName, inside).groupBy("g").agg(F.max("most").alias("most"))
        own = here.select(g.alias("g"), F.col("n").alias("a")).join(most, "g", "left")
        results.append(own.filter(F.coalesce(F.lit(100) * F.col("most") < F.lit(share) * F.col("a"), F.lit(True)))
                       .select("g", "a", F.lit(None).cast("int").alias("path_words")))
    kept = reduce(DataFrame.unionByName, results)

    # Every cut of a candidate: its two parts are frequent grams themselves.
    counts = materialize(reduce(DataFrame.unionByName, [words.select(_key([F.col("id")]).alias("g"), "n")] + [
        f.select(_key([F.col(w) for w in _W[:k]]).alias("g"), "n") for k, f in enumerate(frequent, 2)]), "gram-counts")
    kept = materialize(kept, "candidates")
    cuts = (kept.select("g", "a", F.explode(F.sequence(F.lit(1), F.size("g") - 1)).alias("k"))
            .select("g", "a", "k", F.slice("g", F.lit(1), F.col("k")).alias("first"), F.expr("slice(g, k + 1, size(g) - k)").alias("rest"))
            .join(counts.select(F.col("g").alias("first"), F.col("n").alias("l")), "first")
            .join(counts.select(F.col("g").alias("rest"), F.col("n").alias("r")), "rest"))
    named = (kept.select("g", "path_words", F.posexplode("g").alias("at", "id")).join(words.select("grp", "id", "word"), "id")
             .groupBy("g").agg(F.max("grp").alias("grp"), F.max("path_words").alias("path_words"),
                               F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase")))
    scored = (cuts.join(named, "g").join(sums, "grp")
              .withColumn("score", F.expr("(1000BD * cast(a AS decimal(16,0)) * cast(all AS decimal(18,0))) div (cast(l AS decimal(18,0)) * cast(r AS decimal(18,0)))")))
    best = scored.groupBy("g").agg(F.min_by(F.struct("grp", "phrase", "a", "l", "r", F.col("all").alias("n"), "score", "path_words"),
                                            F.struct("score", "k")).alias("b")).select("b.*")
    order = Window.partitionBy("grp").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order))
    ranked = ranked if top is None else ranked.filter(F.col("rank") <= top)
    return ranked.select(F.col("grp").alias(group), "rank", "phrase", "a", "l", "r", "n", "score", "path_words")
