"""Language-model scores of texts from an n-gram trie in Elias-Fano levels.

Words get ids and exact counts through ``lexicon``. A lot then sends every distinct pair of neighbours once to the shard of its context: the
count in training texts, the code of the word's own probability and the documents it occurs in. The shard merges the
counts of all lots into a level of the trie (contexts, monotone pointers, successors, smoothed probabilities in 16 bits), looks
every pair up by a successor search within its context, and sends back sums by document. A frequent context is
dealt over several shards by its next word.

With ``order`` 3 the second level answers the lots instead: with the node of every pair, its count, its code, and the number of its
word among the successors of the context. These are the third level's entries: contexts are nodes, words go by that number
(context-based ids), and the code of the second level is what a triple falls back on. The third level sends back the sums.

Smoothing: the word's share in all training tokens with 0.1 added to each count, then the pair's count plus ``PRIOR`` times that
share, over the context's count plus ``PRIOR``; triples likewise over the probability of the pair. Log probabilities are stored in steps of 1/``STEPS`` (base 10).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import lexicon
from .common import discard, store
from .lexicon import pack, unpack

ADDED, PRIOR, STEPS = 0.1, 20.0, 2048
#: Tokens of a lot, a quarter fewer where it sends triples, too; tokens behind a context from which on it is dealt over one more shard.
LOT_TOKENS, SPLIT = 1 << 21, 1 << 18
#: Rounds in which the lots send their triples.
ROUNDS = 3
#: kind 0: documents of a lot (parts: tokens, known words, sums of codes settled in the lot; base scores); kind 1: pairs.
_MESSAGES = "shard int, kind int, lot long, ids array<string>, parts array<binary>, base array<double>"


def code_of(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-np.log10(p) * STEPS), 65535).astype(np.int64)


def probability(code: np.ndarray) -> np.ndarray:
    return np.power(10.0, -np.asarray(code) / STEPS)


def part_of(word: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Over how many parts the successors of a context with that count are dealt, and the part of a word."""
    parts = 1 + np.asarray(total, np.int64) // SPLIT
    return parts, (lexicon.mixed(word, word * 0 + 1) % parts.astype(np.uint64)).astype(np.int64)


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in the order of the key, where each key begins there, and how often it occurs."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return order, first, np.diff(np.append(first, len(key)))


def _in_order(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The order of context and word, by one number where both fit in: sorted stretches are merged then."""
    bits = int(word.max()).bit_length() if len(word) else 0
    if len(word) and bits + int(context.max()).bit_length() < 64:
        return np.argsort((context << bits) | word, kind="stable")
    return np.lexsort((word, context))


def _by_shard(shard: np.ndarray, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The order of shard, context and word, and the stretch of each shard in it."""
    order = _in_order(context, word)
    small = shard.astype(np.uint16) if len(shard) and shard.max() < 1 << 16 else shard
    order = order[np.argsort(small[order], kind="stable")]
    bounds = np.append(np.flatnonzero(np.concatenate(([True], np.diff(shard[order]) != 0))), len(order)).tolist() if len(order) else [0]
    return order, list(zip(bounds[:-1], bounds[1:]))


def _send(lots: DataFrame, answers: DataFrame, word_shards: int, shards: int, n: int, v: int, ends: int, order_of_model: int) -> DataFrame:
    total = n + ADDED * (v + 1)

    def run(lot_df: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for lot in lot_df.itertuples():
            ids, counts = lexicon.resolved(lot, found, word_shards)
            counts[0] = ends
            sizes, codes = unpack(lot.sizes), unpack(lot.codes)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            share = (counts + ADDED) / total
            base = np.add.reduceat(np.log10(share)[codes], np.cumsum(sizes) - sizes)
            known = np.add.reduceat((counts > 0)[codes].astype(np.int64), np.cumsum(sizes) - sizes)
            own = code_of(share)
            before = np.concatenate(([0], codes[:-1]))
            # A word or context without training tokens is in no pair: settled here.
            sent = (counts[before] > 0) & (counts[codes] > 0)
            lone = ~sent
            less = code_of(PRIOR / (counts + PRIOR))
            settled = np.bincount(doc[lone], np.minimum(own[codes[lone]] + np.where(counts[before[lone]] > 0, less[before[lone]], 0), 65535),
                                  len(sizes)).astype(np.int64)
            places = np.flatnonzero(sent)
            by, first, times = _distinct(before[places] * len(ids) + codes[places])
            places = places[by]
            context, word = before[places[first]], codes[places[first]]
            trained = np.add.reduceat(unpack(lot.flags)[doc[places]], first) if len(first) else times
            # Pairs in the order of shard, context, word, and the documents of their places beside them.
            split = part_of(ids[word], counts[context])[1].astype(np.uint64)
            shard = (lexicon.mixed(ids[context], split) % np.uint64(shards)).astype(np.int64)
            order, stretches = _by_shard(shard, ids[context], ids[word])
            state = [pack(sizes), pack(known), pack(settled)]
            if order_of_model > 2:
                # The next level needs every token's pair, by its place in the order sent, and the codes of the tokens without one.
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                pair = np.zeros(len(codes), np.int64)
                pair[places] = np.repeat(rank, times) + 1
                alone = own[codes[lone]] + np.where(counts[before[lone]] > 0, less[before[lone]], 0)
                state = [pack(sizes), pack(known), lot.flags, pack(pair), pack(np.minimum(alone, 65535))]
            rows.append((int(lot.lot % shards), 0, lot.lot, list(lot.ids), state, base.tolist()))
            starts, documents = first[order], doc[places]
            for a, b in stretches:
                at, t = order[a:b], times[order[a:b]]
                c = ids[context[at]]
                new = np.concatenate(([True], c[1:] != c[:-1]))
                parts = [pack(np.diff(c, prepend=0)), pack(counts[context[at]][new]), pack(ids[word[at]]), pack(trained[at]), pack(own[word[at]])]
                if order_of_model == 2:
                    spread = np.repeat(starts[a:b] - np.cumsum(t) + t, t) + np.arange(t.sum())
                    parts += [pack(t), pack(documents[spread])]
                rows.append((int(shard[at[0]]), 1, lot.lot, None, parts, None))
        return pd.DataFrame(rows, columns=["shard", "kind", "lot", "ids", "parts", "base"])

    return lots.groupBy("lot").cogroup(answers.groupBy("lot")).applyInPandas(run, _MESSAGES)


def build(context: np.ndarray, word: np.ndarray, n: np.ndarray, total: np.ndarray, own: np.ndarray) -> bytes:
    """A level of the trie from pairs in ascending order: their counts, their contexts' counts and their words' codes."""
    from .trie import Level
    codes = code_of((n + PRIOR * probability(own)) / (total + PRIOR))
    new = np.concatenate(([True], context[1:] != context[:-1])) if len(context) else np.zeros(0, bool)
    return Level.encode(context, word, codes, context[new], code_of(PRIOR / (total[new] + PRIOR)))


def _answer(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
    return _looked_up(df, int(key[0]), last=True)


def _node(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
    return _looked_up(df, int(key[0]), last=False)


def _looked_up(df: pd.DataFrame, shard: int, last: bool) -> pd.DataFrame:
    """Sums of codes by document of the entries of a shard; rows of kind 0 pass.

    Before the ``last`` level, by entry instead: its node of the trie (as gaps), its count, its code and the number that its word has
    among the successors of the context.
    """
    from .trie import Level
    out = df[df["kind"] == 0][["kind", "lot", "ids", "parts", "base"]]
    pairs = df[df["kind"] == 1]
    if not len(pairs):
        return out
    columns = [[], [], [], [], []]
    for p in pairs["parts"]:
        deltas, totals = unpack(p[0]), unpack(p[1])
        c = np.cumsum(deltas)
        new = np.concatenate(([True], deltas[1:] != 0))
        for column, x in zip(columns, (c, unpack(p[2]), unpack(p[3]), totals[np.cumsum(new) - 1], unpack(p[4]))):
            column.append(x)
    sizes = [len(x) for x in columns[0]]
    context, word, n, total, own = (np.concatenate(x) for x in columns)
    del columns
    order = _in_order(context, word)
    new = np.concatenate(([True], (context[order][1:] != context[order][:-1]) | (word[order][1:] != word[order][:-1])))
    first = order[new]
    n = np.add.reduceat(n[order], np.flatnonzero(new))
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    context, word, total, own = context[first], word[first], total[first], own[first]
    seen = n > 0
    level = Level(build(context[seen], word[seen], n[seen], total[seen], own[seen]))
    numbers, place = level.find(context, word)
    missing = np.minimum(own + code_of(PRIOR / (total + PRIOR)), 65535)
    codes = np.where(place >= 0, level.codes[place].astype(np.int64), missing) if level.codes.size else missing
    rows = []
    if not last:
        parts, part = part_of(word, total)
        begin = level.pointers.access(np.maximum(numbers, 0)) if level.contexts.size else 0
        among = np.where(place >= 0, (place - begin) * parts + part, 0)
        for lot, at in zip(pairs["lot"], np.split(number, np.cumsum(sizes)[:-1])):
            nodes = np.maximum.accumulate(np.maximum(place[at], 0))
            rows.append((1, lot, [str(shard)], [pack(np.diff(nodes, prepend=0)), pack(n[at]), pack(codes[at]), pack(among[at])], None))
        return pd.concat([out, pd.DataFrame(rows, columns=["kind", "lot", "ids", "parts", "base"])])
    for lot, p, at in zip(pairs["lot"], pairs["parts"], np.split(number, np.cumsum(sizes)[:-1])):
        docs = unpack(p[6])
        sums = np.bincount(docs, np.repeat(codes[at], unpack(p[5]))).astype(np.int64)
        there = np.unique(docs)
        rows.append((1, lot, None, [pack(there), pack(sums[there])], None))
    return pd.concat([out, pd.DataFrame(rows, columns=["kind", "lot", "ids", "parts", "base"])])


def _send_triples(shards: int):
    """Messages of the third level from the answers of the second: the node of a pair is the context, and the word goes by its number among
    the successors of the word before (small, whatever the vocabulary)."""
    def run(df: pd.DataFrame) -> pd.DataFrame:
        lot = next(df[df["kind"] == 0].itertuples())
        sizes, known, flags, pair, alone = (unpack(x) for x in lot.parts)
        found = sorted((int(r.ids[0]), r.parts) for r in df[df["kind"] == 1].itertuples())
        # Entry 0 stands for no pair.
        node, n, code, among = (np.concatenate([np.zeros(1, np.int64), *x]) for x in (
            [np.cumsum(unpack(p[0])) * shards + s for s, p in found], *([unpack(p[k]) for _, p in found] for k in (1, 2, 3))))
        pair = pair.astype(np.int32)
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        before = np.concatenate((np.zeros(1, np.int32), pair[:-1]))
        before[np.cumsum(sizes) - sizes] = 0
        sent = (n > 0)[before] & (n > 0)[pair]
        less = np.where(n > 0, code_of(PRIOR / (n + PRIOR)), 0)
        second = code.astype(np.int32)[pair]
        second[pair == 0] = alone
        lone = np.flatnonzero(~sent)
        settled = np.bincount(doc[lone], np.minimum(second[lone] + less[before[lone]], 65535), len(sizes)).astype(np.int64)
        del second, alone, lone
        number = lot.lot
        rows = [(int(number % shards), 0, number, list(lot.ids), [pack(sizes), pack(known), pack(settled)], lot.base)]
        places = np.flatnonzero(sent)
        by, first, times = _distinct(before[places].astype(np.int64) * len(n) + pair[places])
        places = places[by]
        context, word, documents = before[places[first]], pair[places[first]], doc[places]
        del by, places, before, pair, doc, sent, lot, found
        trained = np.add.reduceat(flags[documents], first) if len(first) else times
        split = part_of(among[word], n[context])[1].astype(np.uint64)
        shard = (lexicon.mixed(node[context], split) % np.uint64(shards)).astype(np.int64)
        order, stretches = _by_shard(shard, node[context], among[word])
        starts = first[order]
        for a, b in stretches:
            at, t = order[a:b], times[order[a:b]]
            spread = np.repeat(starts[a:b] - np.cumsum(t) + t, t) + np.arange(t.sum())
            c = node[context[at]]
            new = np.concatenate(([True], c[1:] != c[:-1]))
            rows.append((int(shard[at[0]]), 1, number, None,
                         [pack(np.diff(c, prepend=0)), pack(n[context[at]][new]), pack(among[word[at]]), pack(trained[at]), pack(code[word[at]]),
                          pack(t), pack(documents[spread])], None))
        return pd.DataFrame(rows, columns=["shard", "kind", "lot", "ids", "parts", "base"])
    return run


def _total(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
    own = next(df[df["kind"] == 0].itertuples())
    tokens, known, sums = (unpack(x) for x in own.parts)
    for p in df[df["kind"] == 1]["parts"]:
        sums[unpack(p[0])] += unpack(p[1])
    return pd.DataFrame({"doc_id": own.ids, "n_tokens": tokens, "n_known": known, "base_score": own.base, "score": -sums / STEPS})


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", order: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, under a model of pairs or (``order`` 3) triples.

    ``held_out`` rows are scored but not learnt from; where it is null, the row is learnt from. Null texts are empty: their only token is the
    end. Rows without an id and rows with equal ids are scored each by itself. Without training rows every token is
    unknown (probability 1). An empty table gives no row.
    """
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    id_type = docs.schema[doc_id].dataType
    # The fold goes in front of the id, so that no join by id is needed.
    rows = docs.select(F.concat(F.when(F.coalesce(held_out, F.lit(False)), "1").otherwise("0"), F.coalesce(F.concat(F.lit("="), F.col(doc_id).cast("string")), F.lit("")))
                       .alias("id"), F.col(text).alias("text"), F.lit("").alias("grp"), (~F.coalesce(held_out, F.lit(False))).alias("counted"))
    lots = lexicon.gather(rows, end=True, keep_ids=True, lot_tokens=LOT_TOKENS if order == 2 else LOT_TOKENS * 3 // 4)
    sizes = lots.agg(F.sum("n_words"), F.sum("n_tokens")).first()
    word_shards, shards = lexicon.shards_for(sizes[0]), lexicon.shards_for(sizes[1])
    answers = lexicon.look_up(lots, word_shards, listed=False)
    ends = rows.filter("counted").count()
    counted = answers.filter("lot = -1").agg(F.sum("total"), F.sum("n_distinct")).first()
    n, v = (counted[0] or 0) + ends, (counted[1] or 0) + (ends > 0)
    answered = "kind int, lot long, ids array<string>, parts array<binary>, base array<double>"
    messages = _send(lots.drop("counts", "groups").withColumn("groups", F.array(F.lit(""))), answers.filter("lot >= 0"), word_shards, shards, n, v, ends, order)
    if order > 2:
        # Written before the next exchange, so that the former one is off the disks by then.
        sent = store(messages, "lm-pairs", lexicon.LOT_ROWS, by="kind")
        for done in (lots, answers):
            discard(done)
        nodes = store(sent.filter("kind = 1").groupBy("shard").applyInPandas(_node, answered),
                      "lm-nodes", lexicon.LOT_ROWS)
        discard(sent, "kind=1")
        both = sent.filter("kind = 0").select(*nodes.columns).unionByName(nodes)
        # The lots meet their answers in rounds, so that a part of this exchange is on the disks at a time.
        sent_on = [store(both.filter(F.pmod(F.xxhash64("lot"), F.lit(ROUNDS)) == k).groupBy("lot").applyInPandas(_send_triples(shards), _MESSAGES),
                         "lm-triples", lexicon.LOT_ROWS) for k in range(ROUNDS)]
        for done in (sent, nodes):
            discard(done)
        messages = reduce(DataFrame.unionByName, sent_on)
    sums = store(messages.groupBy("shard").applyInPandas(_answer, answered),
                 "lm-sums", lexicon.LOT_ROWS)
    scored = store(sums.groupBy("lot").applyInPandas(_total, "doc_id string, n_tokens long, n_known long, base_score double, score double"),
                   "lm-scores", lexicon.LOT_ROWS)
    for done in (*((lots, answers) if order == 2 else sent_on), sums):
        discard(done)
    return scored.select(F.expr("substring(doc_id, 3)").alias("text_id"), "*").select(
        F.when(F.length("doc_id") > 1, F.col("text_id")).cast(id_type).alias("doc_id"), (F.substring("doc_id", 1, 1) == "1").alias("held_out"),
        "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
