"""The registered queries over whole small tables: contract columns, SQL and brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from tickloom.llm import queries as Q

from ..oracle import compare, duck

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(spark, name):
    return [r.asDict() for r in Q.in_utc(Q.QUERIES[name])(spark, SF_DIR).collect()]


def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


def test_all_are_registered():
    names = contract.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and [s for s, _ in corpus_pipeline.STAGES] == [
        "language_id", "line_dedup", "ngram_jaccard", "mix_sources", "best_fit_packing"]


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_matches_sql(spark, name):
    assert compare(Q.in_utc(Q.QUERIES[name])(spark, SF_DIR), duck(SF_DIR), Q.SQL[name]) is None


def test_url_filters(spark):
    found = rows(spark, "op1_url_filters")
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "url").collect()}
    assert len(found) == len(urls)
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
             ("block", "com", "/de/")]
    for r in found:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", urls[r["page_id"]] or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == (max(fits)[1] if fits else None)
        if fits:
            assert r["verdict"] == max(fits)[2]
        assert r["verdict"] in ("allow", "block")


def test_html_extraction(spark):
    import html
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    found = rows(spark, "op2_html_extraction")
    assert len(found) == len(pages)
    for r in found:
        inner = re.search(r"(?s)<article>(.*?)(?:</article>|$)", pages[r["page_id"]] or "")
        blocks = re.sub(r"</?(?:h1|p)>", "\0", inner[1]) if inner else ""
        blocks = re.sub(r"<[^>]*>", "", blocks.replace("<br>", " ")).split("\0")
        want = "\n".join(b for b in (" ".join(html.unescape(x).split()) for x in blocks) if b)
        assert (r["text"], r["n_chars"]) == (want, len(want))


def test_language_id_is_right_on_held_out_texts(spark):
    found = rows(spark, "op3_language_id")
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert len(found) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found) and np.mean([r["rejected"] for r in found]) < 0.02


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(Q.tokenizer_path())
    found = rows(spark, "op4_best_fit_packing")
    ids = {d: np.array(tokenizer.encode(t, add_special_tokens=False).ids + [0], "<u4") for d, t in texts(spark).items()}
    assert sum(r["length"] for r in found) == sum(len(x) for x in ids.values())
    for r in found:
        assert zlib.crc32(ids[r["doc_id"]][r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        assert r["length"] == 2048 or r["start"] + r["length"] == len(ids[r["doc_id"]])
        assert r["start"] == 2048 * r["piece"]
    by = {}
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == by.get(r["sequence_id"], 0)
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by.values()) <= 2048
    assert len(by) <= 1.01 * -(-sum(by.values()) // 2048) + 1


def test_nearest_neighbours_recall(spark):
    vectors = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    ids, v = np.array([r["vec_id"] for r in vectors]), np.array([r["embedding"] for r in vectors], float)
    found, hit, total = {}, 0, 0
    for r in rows(spark, "op6_nearest_neighbours"):
        found.setdefault(r["query_id"], []).append(r)
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(1))
        want = [i for i in ids[np.lexsort((ids, d))] if i != q][:10]
        got = sorted(found[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, len(want) + 1))
        assert np.allclose([r["score"] for r in got], [d[ids == r["vec_id"]][0] for r in got], rtol=1e-12)
        hit += len(set(want) & {r["vec_id"] for r in got})
        total += len(want)
    assert hit / total >= 0.9


def test_suffix_dedup_by_brute_force(spark):
    docs = {d: t.encode() for d, t in texts(spark).items()}
    seen = Counter(b[k:k + 200] for b in docs.values() for k in range(len(b) - 199))
    found = rows(spark, "op7_suffix_array_dedup")
    assert len(found) == len(docs)
    for r in found:
        b = docs[r["doc_id"]]
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k:k + 200]] > 1:
                gone[k:k + 200] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (
            len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def components(sets, percent):
    """Smallest reachable id of each document, by comparing all pairs that share a shingle."""
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    where = {}
    for i, s in sets.items():
        common = Counter(j for g in s for j in where.get(g, ()))
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for g in s:
            where.setdefault(g, []).append(i)
    return {i: find(i) for i in sets}


def shingles(text, size):
    w = WORD.findall(text.translate(LOWER))
    return {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def test_jaccard_components_by_brute_force(spark):
    sets = {d: shingles(t, 4) for d, t in texts(spark).items()}
    want = components(sets, 85)
    found = rows(spark, "op8_ngram_jaccard")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == {d: (len(s), want[d]) for d, s in sets.items()}


def test_quality_by_brute_force(spark):
    docs = texts(spark)
    for r in rows(spark, "op9_quality_rules"):
        text = docs[r["doc_id"]]
        w = WORD.findall(text)
        grams = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        covered = {k + i for k in range(len(w) - 7) if grams[tuple(w[k:k + 8])] > 1 for i in range(8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        n = len(w)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (n < 20 or 100 * len(covered) > 30 * n)
        assert not (r["base_failed"] and r["kept"])


def test_pipeline_by_brute_force(spark):
    """Each stage against plain Python on its own input."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    identified = stage["language_id"](spark, docs, SF_DIR)
    assert identified.columns == corpus_pipeline.COLUMNS
    assert identified.count() >= 0.98 * docs.count()

    cut = {r["doc_id"]: r["text"] for r in stage["line_dedup"](spark, docs, SF_DIR).collect()}
    seen, want = set(), {}
    for d, t in sorted(texts(spark).items()):
        lines = t.split("\n")
        body = [i for i, x in enumerate(lines) if WORD.search(x)]
        gone, new = set(), set()
        for k, i in enumerate(body):
            runs = [body[k:k + 3]] if k + 3 <= len(body) else []
            runs += [body[k:k + n] for n in (1, 2) if k + n <= len(body) and sum(len(WORD.findall(lines[j])) for j in body[k:k + n]) >= 50]
            for run in runs:
                key = tuple(lines[j] for j in run)
                if key in seen or key in new:
                    gone |= set(range(run[0], run[-1] + 1))
                new.add(key)
        seen |= new
        left = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        if WORD.search(left) or not gone:
            want[d] = left
    assert cut == want

    kept = {r["doc_id"] for r in stage["ngram_jaccard"](spark, docs, SF_DIR).collect()}
    groups = components({d: shingles(t, 5) for d, t in texts(spark).items()}, 80)
    assert kept == {d for d, c in groups.items() if c == d}

    mixed = stage["mix_sources"](spark, docs, SF_DIR)
    words = F.size(F.split(F.trim("text"), "[\\x20\\x09-\\x0D]+"))
    share = mixed.agg(F.sum(words)).first()[0] / docs.agg(F.sum(words)).first()[0]
    assert 0.75 < share < 0.9 and mixed.columns == corpus_pipeline.COLUMNS


def test_the_whole_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    assert out.count() > 0 and "sequence_id" in out.columns
