"""Phrases, language-model scores and centroids against brute force, with nulls, ties, repeats, long texts and clashing names."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import centroids, lexicon, phrases, queries, scoring
from tickloom.llm.trie import EliasFano, Level

from .conftest import prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string"
CLASH = ["id", "grp", "n", "a", "l", "r", "score", "rank", "phrase", "lot", "kind", "x", "cluster", "distance", "vector", "counted", "held_out"]


def clashing(df):
    return df.withColumns({c: F.lit("?") for c in CLASH if c not in df.columns})


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    fixed = "the State of the art, in short: a thing of beauty is a joy for ever"
    rows = [(i, f"{prose(rng, int(rng.integers(0, 60)))} {fixed}. {prose(rng, 5)}", ("en", "de", None, "und")[i % 4]) for i in range(120)]
    rows += [(200, None, "en"), (201, "", None), (202, " \t\n..;", "en"), (203, "x y x y x y x y x y", "de"), (203, "x y x y x y x y x y", "de"),
             (None, "No id, but words of the art", "en"), (204, "Ä ö É \U0001f600 日本 \x1f a\x1fb \xa0 of the art", "en"),
             (205, prose(rng, 40_000), "en"), (206, "w" * 100_000, "de"), (207, "yes " * 300, "de"), (208, "!" * 5000, "en")]
    return spark.createDataFrame(rows, SCHEMA)


def collocations(rows, least, share, top):
    count, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 6):
                count[lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, f in count.items():
        candidates = [g for g in f if len(g) > 1 and f[g] >= least]
        inside = defaultdict(int)
        for g in candidates:
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    inside[g[i:i + k]] = max(inside[g[i:i + k]], f[g])
        found = []
        for g in candidates:
            if 100 * inside[g] >= share * f[g]:
                continue
            score, k = min((1000 * f[g] * n[lang] // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -f[g], " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out |= {(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)}
    return out


@pytest.mark.parametrize("least, share, top", [(2, 100, 10_000), (5, 80, 10_000), (30, 100, 7)])
def test_phrases_by_brute_force(spark, docs, least, share, top, monkeypatch):
    monkeypatch.setattr(lexicon, "SHARD_ENTRIES", 300)
    got = [tuple(r)[:8] for r in phrases.phrases(clashing(docs).repartition(5), least=least, share=share, top=top).collect()]
    assert len(got) == len(set(got)) and set(got) == collocations([tuple(r) for r in docs.collect()], least, share, top)


def test_phrases_on_a_passage_and_empty_tables(spark, docs):
    words = [f"p{i}" for i in range(40)]
    df = spark.createDataFrame([(i, " ".join(words)) for i in range(9)], "doc_id long, text string").withColumn("lang", F.lit("en"))
    out = phrases.phrases(df, least=9).collect()
    assert {r["phrase"] for r in out} == {" ".join(words[i:i + 5]) for i in range(36)}
    assert {r["path_words"] for r in out} == {40}
    assert phrases.phrases(docs.limit(0)).count() == 0 and phrases.phrases(docs, least=10 ** 6).count() == 0


def test_elias_fano_round_trip_and_successor():
    rng = np.random.default_rng(0)
    for top in (1, 7, 1000, 1 << 40):
        for n in (0, 1, 63, 64, 500):
            x = np.sort(rng.integers(0, top, n))
            e = EliasFano(EliasFano.encode(x))
            assert e.size == n and (e.access(np.arange(n)) == x).all()
            q = rng.integers(0, top + 5, 200)
            lo = rng.integers(0, n + 1, 200)
            hi = np.maximum(lo, rng.integers(0, n + 1, 200))
            want = [next((i for i in range(a, b) if x[i] >= v), b) for v, a, b in zip(q, lo, hi)]
            assert e.successor(q, lo, hi).tolist() == want


def test_trie_level_finds_what_it_holds():
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 60, (700, 2)), axis=0)
    context, word = pairs[:, 0] * 1000, pairs[:, 1]
    contexts = np.unique(context)
    level = Level(Level.encode(context, word, np.arange(len(pairs)), contexts, np.arange(len(contexts))))
    number, place = level.find(context, word)
    assert (level.codes[place] == np.arange(len(pairs))).all() and (contexts[number] == context).all()
    known = set(map(tuple, np.stack((context, word), 1).tolist()))
    others = [(c, w) for c in range(0, 62_000, 500) for w in range(62) if (c, w) not in known]
    assert (level.find(*map(np.array, zip(*others)))[1] == -1).all()


def lm(rows, held):
    toks = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None] for _, t, _ in rows]
    train = [t for t, h in zip(toks, held) if not h]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    pairs = Counter(p for t in train for p in zip([None, *t[:-1]], t))
    code = lambda p: min(65535, int(np.rint(-np.log10(p) * scoring.STEPS)))
    out = []
    for t in toks:
        base, total = 0.0, 0
        for u, w in zip([None, *t[:-1]], t):
            share = (c[w] + 0.1) / (n + 0.1 * (v + 1))
            own, prior = code(share), scoring.PRIOR
            base += math.log10(share)
            if pairs[u, w]:
                total += code((pairs[u, w] + prior * 10 ** (-own / scoring.STEPS)) / (c[u] + prior))
            else:
                total += min(65535, own + code(prior / (c[u] + prior))) if c[u] else own
        out.append((len(t), sum(c[w] > 0 for w in t), n, round(base, 6), -total / scoring.STEPS))
    return out


@pytest.mark.parametrize("shard, split", [(1 << 19, 1 << 18), (200, 50)])
def test_scores_by_brute_force(spark, docs, shard, split, monkeypatch):
    """Also where a frequent context is dealt over several shards."""
    monkeypatch.setattr(lexicon, "SHARD_ENTRIES", shard)
    monkeypatch.setattr(scoring, "SPLIT", split)
    rows = [tuple(r) for r in docs.collect()]
    held = [d is not None and zlib.crc32(str(d).encode()) % 3 == 0 for d, _, _ in rows]
    got = scoring.score(clashing(docs), F.crc32(F.col("doc_id").cast("string")) % 3 == 0).collect()
    assert {r["held_out"] for r in got} == {True, False} and got[0].asDict().keys() == {
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}
    want = Counter((d, h, *x) for (d, _, _), h, x in zip(rows, held, lm(rows, held)))
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), r["score"]) for r in got) == want


def lm3(rows, held):
    """Triples over the codes of pairs; a text's first token has no pair before it."""
    toks = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None] for _, t, _ in rows]
    train = [t for t, h in zip(toks, held) if not h]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    pairs = Counter(p for t in train for p in zip([None, *t[:-1]], t))
    triples = Counter(p for t in train for p in zip([None, *t[:-2]], t[:-1], t[1:]))
    code = lambda p: min(65535, int(np.rint(-np.log10(p) * scoring.STEPS)))
    prior, back = scoring.PRIOR, lambda own, total: min(65535, own + code(scoring.PRIOR / (total + scoring.PRIOR)))
    mixed = lambda seen, own, total: code((seen + prior * 10 ** (-own / scoring.STEPS)) / (total + prior)) if seen else back(own, total)
    out = []
    for t in toks:
        total = 0
        for i, w in enumerate(t):
            u = t[i - 1] if i else None
            second = code((c[w] + 0.1) / (n + 0.1 * (v + 1)))
            if c[u]:
                second = mixed(pairs[u, w], second, c[u])
            if i and (before := pairs[context := (t[i - 2] if i > 1 else None, u)]):
                second = mixed(triples[*context, w], second, before)
            total += second
        out.append((len(t), -total / scoring.STEPS))
    return out


@pytest.mark.parametrize("shard, split", [(1 << 19, 1 << 18), (200, 50), (150, 3)])
def test_scores_of_triples_by_brute_force(spark, docs, shard, split, monkeypatch):
    """Also over many lots and shards, and where frequent words and pairs are dealt over several."""
    monkeypatch.setattr(lexicon, "SHARD_ENTRIES", shard)
    monkeypatch.setattr(scoring, "SPLIT", split)
    monkeypatch.setattr(scoring, "LOT_TOKENS", 1 << 21 if split > 50 else 700)
    rows = [tuple(r) for r in docs.collect()]
    held = [d is not None and zlib.crc32(str(d).encode()) % 3 == 0 for d, _, _ in rows]
    got = scoring.score(clashing(docs), F.crc32(F.col("doc_id").cast("string")) % 3 == 0, order=3).collect()
    want = Counter((d, h, *x) for (d, _, _), h, x in zip(rows, held, lm3(rows, held)))
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["score"]) for r in got) == want
    assert scoring.score(docs.limit(0), F.lit(False), order=3).count() == 0
    assert all(r["score"] == 0 for r in scoring.score(docs, F.lit(True), order=3).collect())


def test_the_query_scores_by_triples(spark, tmp_path):
    docs = spark.createDataFrame([(i, "a b c " * 40) for i in range(40)] + [(100 + i, "a b d e b f " * 20) for i in range(40)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = [tuple(r) + (None,) for r in docs.collect()]
    held = [zlib.crc32(str(d).encode()) % 10 == 0 for d, _, _ in rows]
    got = queries.op12_lm_scoring(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["score"]) for r in got} == {d: x for (d, _, _), x in zip(rows, lm3(rows, held))}


def test_scores_without_rows_or_training(spark, docs):
    assert scoring.score(docs.limit(0), F.lit(False)).count() == 0
    out = scoring.score(docs, F.lit(True)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] == 0 == r["base_score"] for r in out)


def test_held_out_documents_score_above_their_base(spark):
    out = queries.op12_lm_scoring(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert out[0] > 0.85 * out[1] and out[2] > 10_000


def kmeans(vectors, count, rounds, seed):
    kept = [(i, [math.floor(x * 256) for x in v]) for i, v in vectors]
    named = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centre = [v for _, v in named[:count]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        best = [min((far(v, c), k) for k, c in enumerate(centre)) for _, v in kept]
        if turn < rounds:
            for k in range(len(centre)):
                own = [v for (_, v), (_, b) in zip(kept, best) if b == k]
                centre[k] = [sum(x) // len(own) for x in zip(*own)] if own else centre[k]
    total, fits = Counter(), lambda x: x if x < 1 << 63 else None
    for d, k in best:
        total[k] += d
    return Counter((i, k, fits(d), fits(total[k]), fits(sum(total.values())), hashlib.sha256(",".join(map(str, centre[k])).encode()).hexdigest())
                   for (i, _), (d, k) in zip(kept, best))


@pytest.mark.parametrize("scale", [1.0, 1e9, 1e30])
@pytest.mark.parametrize("width", [1, 2, 5])
def test_centroids_by_brute_force(spark, scale, width, monkeypatch):
    monkeypatch.setattr(centroids, "LOT", 37)
    rng = np.random.default_rng(4)
    v = (rng.normal(size=(150, 8)) * scale).round(2).tolist()
    rows = list(enumerate(v)) + [(7, v[7]), (1 << 60, v[3]), (None, v[9]), (-5, [0.0] * 8), (900, v[0]), (901, v[0])]
    bad = [(300, None), (301, []), (302, v[0][:7]), (303, [None, *v[0][1:]]), (304, [float("nan"), *v[0][1:]]), (305, [float("inf"), *v[0][1:]])]
    df = clashing(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").repartition(3))
    out = centroids.cluster(df, dimensions=8, count=6, rounds=3, width=width)
    assert Counter(tuple(r) for r in out.collect()) == kmeans(rows, 6, 3, 2)


def test_centroids_of_few_vectors(spark):
    df = spark.createDataFrame([(1, [0.5] * 4), (2, [0.5] * 4), (3, [-2.0] * 4)], "vec_id int, embedding array<float>")
    out = {r["vec_id"]: r for r in centroids.cluster(df, dimensions=4).collect()}
    assert out[1]["cluster"] == out[2]["cluster"] != out[3]["cluster"] and {r["distance"] for r in out.values()} == {0}
    assert centroids.cluster(df.limit(0), dimensions=4).count() == 0
    assert centroids.cluster(df.withColumn("vec_id", F.lit(None).cast("int")), dimensions=4).count() == 0
    with pytest.raises(ValueError):
        centroids.cluster(df, dimensions=65)
