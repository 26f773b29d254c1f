"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm import graph, jaccard, language, lines, mixing, neighbours, packing, pages, quality, queries, suffix, urls

from tickloom.llm.common import materialize, store

from .conftest import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(1)
    a, b = prose(rng, 120), prose(rng, 400)
    rows = [(1, a, "en", "s0", 9), (2, a, "en", "s0", 9), (3, None, "en", None, None), (4, "", None, "s1", 0), (5, " \n\t ", "de", "s1", 4),
            (6, "!!! 123", None, "s1", 7), (7, b + "\n" + a, "de", "s0", None), (8, b, None, "s2", 3), (8, b, None, "s2", 3),
            (None, "no id at all", "en", "s2", 12), (9, "ÄÖ é 日本語 \U0001f600 <|endoftext|> it's", "fr", "s1", 1),
            (10, "ab" * 60_000, "de", "s3", 1), (11, prose(rng, 30_000), "en", "s3", 1), (12, "x" * 300, "en", "s3", 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


#: Names that operators use inside or give to their results.
CLASH = ["score", "rejected", "lang_pred", "n_lines", "n_removed", "n_runs", "size", "key", "rank", "epoch", "bin", "load", "members",
         "component_id", "first", "g", "at", "n", "host", "path", "rule", "verdict", "h", "q", "v", "block", "lot"]


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})


def got(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]


@pytest.mark.parametrize("name", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_take_anything(spark, docs, none, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, none, "").count() == 0
    out = stage(spark, clashing(docs), "")
    assert out.count() >= 0
    if name != "best_fit_packing":
        assert out.columns == corpus_pipeline.COLUMNS


def test_url_rules_and_model(spark):
    rows = [(1, "https://a.example.org/es/x"), (2, "HTTP://Example.ORG/en/12?q"), (3, "http://org"), (4, "http://myorg/"), (5, None),
            (6, "no scheme/de/"), (7, ""), (8, "x://a.com/de/1#f"), (9, "x://A.B.com/fr/"), (10, "x://casino-win.com/en/"), (None, "x://é/ü")]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string"))
    out = {r["page_id"]: r for r in urls.judge(df, queries.URL_RULES, None).collect()}
    assert [out[i]["rule"] for i in (1, 2, 3, 4, 5, 6, 8, 9)] == ["example.org/es/", "example.org/en/1", None, None, None, None, "com/de/", "com/fr/"]
    assert [out[i]["verdict"] for i in (1, 2, 8, 9)] == ["block", "block", "block", "allow"]
    assert (out[5]["host"], out[6]["host"], out[6]["path"], out[9]["host"], out[2]["path"]) == ("", "", "", "a.b.com", "/en/12")
    model = urls.fit(urls.weak_labels(df))
    names = ["f_suffix_rate", "f_suffix_seen", "f_length", "__suffix", "__u", "__x", "__prob", "__row", "P_Block", "label"]
    plain = {(r["page_id"], r["verdict"], r["p_block"]) for r in urls.judge(df.select("page_id", "url"), [], model).collect()}
    odd = urls.judge(df.select("page_id", "url").withColumns({c: F.lit("x") for c in names}), [], model)
    assert odd.columns == ["page_id", "url", *[c for c in names if c != "P_Block"], "host", "path", "rule", "p_block", "verdict"]
    assert {(r["page_id"], r["verdict"], r["p_block"]) for r in odd.collect()} == plain
    assert odd.filter(" or ".join(f"{c} <> 'x'" for c in names if c != "P_Block")).count() == 0
    assert urls.fit(urls.weak_labels(df)) is not None and urls.fit(urls.weak_labels(df.limit(0))) is None
    assert urls.judge(df.limit(0), queries.URL_RULES, None).count() == 0
    many = spark.createDataFrame([(i, f"http://{'best-casino' if i % 3 == 0 else 'news'}{i}.example.net/en/{i}") for i in range(900)], "page_id long, url string")
    labelled = many.select("url", (F.col("page_id") % 3 == 0).cast("double").alias("label"))
    model = urls.fit(labelled)
    wrong = urls.judge(many, [], model).filter((F.col("verdict") == "block") != (F.col("page_id") % 3 == 0)).count()
    assert wrong == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="page"><header><a href=/>Site</a></header>
<nav><ul><li>Menu {n}<li>More</ul></nav><div class="cookie-notice">We use cookies</div><main><h1>Title  {n}</h1><p>First &amp; best {n}<br>line
</p><p>Second &lt;b&gt; <b>bold</b> {n}<div class="ad">Buy {n}</div><form><input><p>Write</form><script>var x = "</p>";</script>
<ul><li>one {n}</li><li>two</li></ul></main><aside>Side {n}</aside><section id="comments"><p>Reader {n}</p></section><footer>&copy; {n}</footer></body></html>"""


def test_html(spark):
    want = "Title {n}\nFirst & best {n} line\nSecond <b> bold {n}\none {n}\ntwo"
    rows = [(i, f"http://a.com/{i}", PAGE.replace("{n}", str(i))) for i in range(5)]
    rows += [(5, "http://a.com/5", None), (6, None, ""), (7, "bad", "<p>just &amp text"), (8, None, None), (None, "http://a.com/0", PAGE),
             (9, "http://b.com/", "<div>" * 3000 + "deep" + "</div>" * 10), (10, "http://b.com/", "<p>open <a href='x"), (0, "http://a.com/0", PAGE.replace("{n}", "0"))]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    out = {}
    for r in pages.extract(df).collect():
        assert r["n_chars"] == len(r["text"])
        out[r["page_id"]] = r["text"]
    assert all(out[i] == want.replace("{n}", str(i)) for i in range(5))
    assert (out[5], out[6], out[8], out[7], out[9], out[10]) == ("", "", "", "just & text", "deep", "open")
    assert pages.extract(df.limit(0)).count() == 0


def test_wrapper_tells_slots_from_template():
    def page(i):
        return f"<body><div><p>Welcome to our site, dear reader</p></div><div><p>Story {i} is about {i * 7}</p><p>More of {i}</p></div><div><p>All rights kept</p></div></body>"
    found, wrapper = pages.main_texts([page(i) for i in range(6)])
    assert found == [f"Story {i} is about {i * 7}\nMore of {i}" for i in range(6)]
    assert pages.main_texts([page(9)], wrapper)[0] == ["Story 9 is about 63\nMore of 9"]


def test_template_inside_a_marked_article_goes():
    def page(i):
        story = "".join(f"<p>Part {k} of story {i}</p>" for k in range(1 + i % 3))
        return f"<body><article><h1>Title {i}</h1><div class='x7'>Members read more</div>{story}<p>Write to the desk</p></article></body>"
    found, _ = pages.main_texts([page(i) for i in range(6)])
    assert found == ["\n".join([f"Title {i}", *(f"Part {k} of story {i}" for k in range(1 + i % 3))]) for i in range(6)]
    # copies of one story with another date are no template
    copies = [f"<body><article><p>{'A long story. ' * 9}</p><p>Day {i}</p></article></body>" for i in range(4)]
    assert pages.main_texts(copies)[0] == [f"{('A long story. ' * 9).strip()}\nDay {i}" for i in range(4)]


def test_wrappers_with_furniture_words_keep_the_article():
    side, talk = "<div class='sidebar'><p>Side {i} of it</p></div>", "<div id='comments'><p>Reader {i} says</p></div>"
    story = "<h1>Title {i}</h1><p>Long story {i} about many things</p>"
    shells = [f"<div class='layout has-sidebar'><article>{story}</article>{side}</div>",
              f"<main><div class='row with-nav'><article>{story}</article></div>{talk}</main>",
              f"<div class='post comments-open'>{story}</div>{talk}", f"<form id='all'><article>{story}{talk}</article></form>",
              f"<div class='no-sidebar'><div>{story}</div></div>"]
    for shell in shells:
        found, _ = pages.main_texts([f"<body>{shell}</body>".replace("{i}", str(i)) for i in range(5)])
        assert found == [f"Title {i}\nLong story {i} about many things" for i in range(5)]
    footer = f"<div>{story}</div><div class='footer-content'><p>Desk {{i}}</p></div>"
    assert pages.main_texts([footer.replace("{i}", "1")])[0] == ["Title 1\nLong story 1 about many things"]


def test_names_that_only_hold_a_furniture_word_stay():
    """A class is furniture as a whole name, with words of place only, or as a block of links; not for a word in it."""
    def page(i):
        return f"""<body><article><h1>Title {i}</h1><div class='social-history'><p>History of society {i}, at length</p></div>
            <section id="related-work"><p>Others have written {i} before us</p></section><div class="search-results"><p>We found {i} of them</p></div>
            <div class="related-stories"><a href=a>Story {i + 1}</a> <a href=b>Story {i + 2}</a></div><div class="related-links">See {i}</div>
            <div class="ad-slot-3">Buy {i}</div><div class="article__share-buttons">Share {i}</div><p class="alert">Beware {i}</p></article></body>"""
    found, _ = pages.main_texts([page(i) for i in range(5)])
    assert found == [f"Title {i}\nHistory of society {i}, at length\nOthers have written {i} before us\nWe found {i} of them" for i in range(5)]


def test_a_very_long_page():
    many = "".join(f"<p>Paragraph {k} of the long page</p>" for k in range(20_000))
    found, _ = pages.main_texts([f"<body><div class=menu>Menu</div><article>{many}</article></body>"] + [
        f"<body><div class=menu>Menu</div><article><p>Short {i}</p></article></body>" for i in range(4)])
    assert found[0].count("\n") == 19_999 and found[1:] == [f"Short {i}" for i in range(4)]


def test_all_marked_articles_of_a_page_count():
    a, b = "<p>First part {i} of a story</p>", "<p>Part two {i}</p>"
    both = ["First part {i} of a story", "Part two {i}"]
    pages_ = [(f"<article>{a}</article><hr><article>{b}</article>", both), (f"<div class='entry'>{a}</div><div class='entry'>{b}</div>", both),
              (f"<article>{b}</article><main>{a}<p>and much more of it {{i}}</p></main>", [both[0], "and much more of it {i}"]),
              (f"<main><article>{a}</article>{b}</main>", both[:1]),
              (f"<article>{a}<article>{b}</article></article>", both), (f"<article>{a}</article><article class='comment'>{b}</article>", both[:1])]
    for page, want in pages_:
        found, _ = pages.main_texts([f"<body>{page}</body>".replace("{i}", str(i)) for i in range(5)])
        assert found == ["\n".join(want).replace("{i}", str(i)) for i in range(5)]


def test_long_lists_of_children_are_aligned(monkeypatch):
    def page(i):
        def some(n):
            return "".join(f"<{t}>Item {k} of {i}</{t}>" for k, t in enumerate(("p", "h4", "div") * n))
        own = f"<p class='s{i}'>Start {i}</p>{some(22)}<section><h5>All rights kept</h5></section>{some(22)}<h6 class='e{i}'>End {i}</h6>"
        return f"<body>{own}</body>"
    found, _ = pages.main_texts([page(i) for i in range(4)])
    assert all("All rights kept" not in t and len(t.split("\n")) == 134 for t in found)
    # halved or not, a match is as large
    rng = np.random.default_rng(10)
    for _ in range(40):
        trees = [pages.parse("".join(("<p>", "<div><p></p></div>", "<h4>", "<div><h4></h4><p></p></div>", "</p>")[k] for k in rng.integers(0, 5, 30)))
                 for _ in range(2)]
        matcher = pages.Matcher()
        for t in trees:
            matcher.shape(t)
        sizes = []
        for cells in (4000, 3):
            monkeypatch.setattr(pages, "CELLS", cells)
            sizes.append(sum(1 for _ in matcher.aligned(*trees)))
        assert sizes == [matcher.size(*trees)] * 2


def test_parts_of_a_host_do_not_rest_on_partitions(spark):
    def page(i):
        return f"<body><div><p>Welcome, dear reader</p></div><div><p>Story {i} is about {i * 7}</p></div></body>"
    df = spark.createDataFrame([(i, f"http://a.com/{i}", page(i)) for i in range(12)]
                               + [(100 + i, f"http://b.com/{i}", page(100 + i)) for i in range(150)], "page_id long, url string, html string")
    settings = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = dict(got(pages.extract(df), "page_id", "text"))
        few = dict(got(pages.extract(df.filter("page_id < 12")), "page_id", "text"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {i: f"Story {i} is about {i * 7}" for i in (*range(12), *range(100, 250))}
    assert out == want and few == {i: want[i] for i in range(12)}


def test_language(spark, docs):
    model = language.fit(docs, F.lit(True))
    out = {r["doc_id"]: r for r in language.predict(clashing(docs), model).collect()}
    assert all(out[i]["lang_pred"] == "und" and out[i]["rejected"] and out[i]["score"] == 0 for i in (3, 4, 5, 6))
    assert all(out[i]["lang_pred"] in model.languages and 0 <= out[i]["score"] <= 1 for i in (1, 7, 9, 10, 11))
    assert language.fit(docs.limit(0), F.lit(True)) is None
    assert {r["lang_pred"] for r in language.predict(docs, None).collect()} == {"und"}
    assert language.predict(docs.limit(0), model).count() == 0


def test_packing(spark, docs):
    out = packing.pack(clashing(docs), queries.tokenizer_path()).collect()
    lengths = {}
    for r in out:
        lengths.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["doc_id"] == 8 for r in out) == 2 and sum(r["doc_id"] is None for r in out) == 1
    assert [r["length"] for r in out if r["doc_id"] in (3, 4, 5)] == [1, 1, 1]
    for spans in lengths.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= packing.LENGTH
    assert packing.pack(docs.limit(0), queries.tokenizer_path()).count() == 0


def _sequences(spark, rows, parts):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(parts, "doc_id")
    out = packing.pack(df, queries.tokenizer_path()).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(d for d, _ in rows)
    loads = {}
    for r in out:
        loads[r["sequence_id"]] = loads.get(r["sequence_id"], 0) + r["length"]
    assert max(loads.values()) <= packing.LENGTH
    return len(loads)


def test_packing_of_splits_that_hold_one_length_each(spark, monkeypatch):
    """60 documents of 1,101 tokens and 60 of 801, each kind in splits of its own, pair up; so they do in several groups and rounds."""
    rows = [(k, "a " * (1100 if k < 60 else 800)) for k in range(120)]
    assert _sequences(spark, rows, 8) == 60
    monkeypatch.setattr(packing, "GROUP_PIECES", 12)
    monkeypatch.setattr(packing, "MERGE_BINS", 8)
    assert _sequences(spark, rows, 8) <= 66


def test_packing_takes_every_small_bin_on(spark, monkeypatch):
    """One short document among many of more than half a sequence finds a place, however many groups there are; large ids stay exact."""
    monkeypatch.setattr(packing, "GROUP_PIECES", 5)
    monkeypatch.setattr(packing, "MERGE_BINS", 5)
    big = 2 ** 60
    rows = [(big + k, "a " * 1500) for k in range(40)] + [(big + 100 + k, "a " * 400) for k in range(3)]
    assert _sequences(spark, rows, 4) == 40
    assert _sequences(spark, [(big + k, "a " * 1500) for k in range(40)], 4) == 40
    ids = spark.createDataFrame([(big + 1, "a"), (None, "b"), (big + 3, None)], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in packing.pack(ids, queries.tokenizer_path()).collect()} == {big + 1, None, big + 3}


def test_word_by_word_tokens_equal_whole_texts():
    import numpy as np
    tokens = packing.WordTokens(queries.tokenizer_path())
    for text in ("it's 'tis I'LL we'Re 12ab3 ñÑ ß ÀÉ ¿qué? «x» a_b -- 'S", "x'sy", "İstanbul ΑΣ", "a\x1cb", "<|endoftext|> hi", "é", "ºª²", "",
                 "日本 語", "a\u00a0b", "Ŀ ŀ ǅ", "e\u0301", "\u00ad", "\n\n"):
        assert tokens.of(text) == np.array(tokens.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_best_fit_is_tight_and_whole():
    rng = np.random.default_rng(2)
    loads = rng.integers(1, 2049, 3000)
    bins = packing.best_fit(loads, 2048)
    assert np.bincount(bins, loads).max() <= 2048 and len(set(bins)) <= 1.02 * loads.sum() / 2048 + 1


def test_lines(spark):
    long = " ".join(["word"] * 60)
    run = "one a\ntwo b\nthree c\nfour d"
    rows = [(1, f"{run}\nx"), (2, f"y\n{run}\n\nz"), (3, long), (4, f"q\n{long}"), (5, None), (6, ""), (7, "one a\ntwo b"), (8, f"{run}\n{run}"),
            (9, run), (9, run), (10, "one a\n\ntwo b\nthree c\nlast"), (None, f"{run}")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    out = lines.dedup_lines(df)
    found = sorted(got(out.filter("doc_id is not null"), "doc_id", "text", "n_removed", "n_runs"), key=lambda x: (x[0], str(x[1])))
    assert found == [(1, f"{run}\nx", 0, 0), (2, "y\n\nz", 4, 1), (3, long, 0, 0), (4, "q", 1, 1), (5, None, 0, 0), (6, "", 0, 0), (7, "one a\ntwo b", 0, 0),
                     (8, "", 8, 1), (9, "", 4, 1), (9, "", 4, 1), (10, "last", 4, 1)]
    assert got(out.filter("doc_id is null"), "text") == [run]
    assert set(CLASH) <= set(out.columns) and lines.dedup_lines(df.limit(0)).count() == 0
    assert lines.repeated_runs(spark.createDataFrame([(9, run), (9, run)], "doc_id long, text string")).count() == 0


def test_two_lines_of_many_words(spark):
    rng = np.random.default_rng(9)
    a, b, c, few = prose(rng, 47), prose(rng, 8), prose(rng, 60), prose(rng, 30)
    rows = [(1, f"{a}\n{b}\n{c}\n{few}"), (2, f"x\n{a}\n\n{b}\ny"), (3, f"{b}\n{c}\nz"), (4, f"{c}\n{few}"), (5, f"{b}\n{a}"), (6, f"{few}\n{b}"),
            (7, f"{few}\n{b}\n{a}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert dict(got(lines.dedup_lines(df), "doc_id", "text")) == {
        1: rows[0][1], 2: "x\ny", 3: "z", 4: "", 5: rows[4][1], 6: rows[5][1], 7: few}
    assert dict(got(lines.dedup_lines(df, run_words=1000), "doc_id", "n_removed")) == {d: 0 for d in range(1, 8)}


def test_fingerprints_of_equal_windows_are_equal():
    rng = np.random.default_rng(5)
    run = [prose(rng, int(n)) for n in rng.integers(1, 60, 12)]
    texts = ["\n".join(run), "\n".join(["other", *run[3:9], "end"]), "\n\n".join(run[:5])]
    found = [{(m1, m2): fp for fp, _, m1, m2, _, _ in lines.windows(t)} for t in texts]
    for a in found:
        for b in found:
            assert all(a[k] == b[k] for k in set(a) & set(b))
    assert len(set(found[0]) & set(found[1])) >= 4 and len(set(found[0]) & set(found[2])) >= 3
    selected = {at for _, at, *_ in lines.windows(texts[0])}
    assert all(selected & set(range(k, k + lines.WINDOW)) for k in range(len(run) - lines.WINDOW + 1))


@pytest.mark.parametrize("lot", [1, 40, 10 ** 6])
def test_lines_against_brute_force_for_any_lot(spark, monkeypatch, lot):
    """Texts of few kinds of lines, so that frequent lines, nested, overlapping and two-line runs all occur."""
    rng = np.random.default_rng(lot)
    kinds = [prose(rng, int(n)) for n in (1, 3, 20, 24, 30, 55)] + ["", " "]
    rows = [(d, "\n".join(kinds[k] if k < len(kinds) else f"only {rng.integers(10 ** 9)}"
                          for k in rng.integers(0, len(kinds) + 3, int(rng.integers(0, 9))))) for d in range(150)]
    monkeypatch.setattr(lines, "FLUSH", lot)
    seen, want = set(), {}
    for d, t in rows:
        ls, gone = t.split("\n"), set()
        body = [i for i, x in enumerate(ls) if x.split()]
        for a in range(len(body)):
            for b in range(a, len(body)):
                run = [ls[i] for i in body[a:b + 1]]
                if len(run) >= 3 or sum(len(x.split()) for x in run) >= 50:
                    if tuple(run) in seen:
                        gone |= set(range(body[a], body[b] + 1))
                    seen.add(tuple(run))
        want[d] = (len(gone), "\n".join(x for i, x in enumerate(ls) if i not in gone))
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert {r["doc_id"]: (r["n_removed"], r["text"]) for r in out.collect()} == want
    assert sum(n for n, _ in want.values()) > 50


def test_a_frequent_line_spreads(spark):
    rows = [(i, f"before {i}\nevery page has it\nafter {i}") for i in range(400)]
    plan = lines.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    dealt = [x for x in plan.split("\n") if "RepartitionByExpression" in x]
    assert len(dealt) == 1 and "m1#" in dealt[0] and "m2#" in dealt[0] and "fp#" not in dealt[0]


@pytest.mark.parametrize("size", [300, 2000, 8000])
@pytest.mark.parametrize("spread", [None, 0.3])
def test_neighbours_recall_by_collisions(size, spread):
    """At every size, without and with clusters; with clusters most of the block is never verified."""
    rng = np.random.default_rng(size)
    v = rng.normal(size=(size, 64)) if spread is None else rng.normal(size=(size // 50, 64))[rng.integers(0, size // 50, size)] + spread * rng.normal(size=(size, 64))
    block, ids, hit = neighbours.Block(np.arange(size), v), np.arange(size), 0
    for q in range(0, size, size // 30):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        found = block.search(v[q], q, 10)
        assert len(found) == 10 and found == sorted(found) and all(np.isclose(s, d[i], rtol=1e-12) for s, i in found)
        hit += len({i for _, i in found} & set(np.lexsort((ids, d))[:10]))
    queries_ = len(range(0, size, size // 30))
    assert hit >= 0.95 * 10 * queries_
    if spread is not None and size >= 2000:
        assert block.verified < 0.2 * size * queries_


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(300, None), (400, [0.0] * 8), (500, [float("nan")] * 8), (600, [None] * 8), (700, []), (800, [1.0]), (900, rows[5][1]), (1000, rows[5][1])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    out = neighbours.nearest(df, F.col("vec_id") % 100 == 0)
    by = {}
    for r in sorted(out.collect(), key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert set(by) == {0, 100, 200, 900, 1000} and all(len(x) == 10 and x == sorted(x) for x in by.values())
    assert by[900][:2] == [(0.0, 5), (0.0, 1000)]
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0
    assert neighbours.nearest(df, F.lit(False)).count() == 0


def test_neighbours_of_repeated_and_missing_ids(spark):
    rng = np.random.default_rng(8)
    rows = [((1 << 60) + i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    v = np.array([x for _, x in rows])
    repeats = [rows[0], rows[0], rows[7], rows[7], (rows[9][0], [99.0] * 4), (None, rows[0][1]), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows + repeats, "vec_id long, embedding array<double>").repartition(3)
    out = neighbours.nearest(df, F.col("vec_id").isin(rows[0][0], rows[7][0])).collect()
    for q in (0, 7):
        far = np.sqrt(((v - v[q]) ** 2).sum(1))
        want = [rows[i][0] for i in np.argsort(far) if i != q][:10]
        got = sorted((r["rank"], r["vec_id"]) for r in out if r["query_id"] == rows[q][0])
        assert got == list(enumerate(want, 1))
    assert len(out) == 20


def test_suffix(spark, docs):
    out = {r["doc_id"]: r for r in suffix.remove_repeats(clashing(docs)).collect() if r["doc_id"] != 8}
    assert out[1]["n_removed"] == out[1]["n_bytes"] and out[1]["kept"] == b"" and out[1]["n_spans"] == 1
    assert (out[3]["n_bytes"], out[4]["n_bytes"], out[3]["n_spans"]) == (0, 0, 0)
    # periodic texts repeat in themselves
    assert out[10]["n_removed"] == 120_000 and out[12]["n_removed"] == 300 and out[11]["n_removed"] == 0
    assert suffix.remove_repeats(docs.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "z" * 200), (2, "y" * 200), (3, "abc" * 66 + "ab")], "doc_id long, text string")
    assert got(suffix.remove_repeats(same).orderBy("doc_id"), "n_removed") == [0, 0, 0]


def test_suffix_lots_do_not_matter(spark, monkeypatch):
    rng = np.random.default_rng(4)
    shared = prose(rng, 60)
    rows = [(i, f"{prose(rng, 30)} {shared if i % 3 else shared[:250]} {prose(rng, 30)}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(got(suffix.remove_repeats(df), "doc_id", "n_removed", "n_spans"))
    monkeypatch.setattr(suffix, "LOT", 5)
    monkeypatch.setattr(suffix, "FLUSH", 50)
    assert sorted(got(suffix.remove_repeats(df), "doc_id", "n_removed", "n_spans")) == want


def test_jaccard(spark, docs):
    out = dict(got(jaccard.jaccard_components(clashing(docs.filter("doc_id is not null"))), "doc_id", "component_id"))
    assert out[2] == 1 and out[8] == 8 and all(out[i] == i for i in (3, 4, 5, 6, 9, 10, 11))
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("paired", [0, 48])
def test_jaccard_near_copies_by_all_pairs(spark, monkeypatch, paired):
    from .test_queries import components, shingles
    monkeypatch.setattr(jaccard, "PAIRED", paired)
    monkeypatch.setattr(jaccard, "BLOCK", 20)
    rng = np.random.default_rng(5)
    rows = []
    for base in range(6):
        words = prose(rng, int(rng.integers(20, 900))).split()
        for k in range(25):
            w = list(words)
            for _ in range(int(rng.integers(0, max(2, len(w) // 25)))):
                w[int(rng.integers(len(w)))] = prose(rng, 1).upper()
            rows.append((base * 100 + k, " ".join(w[:len(w) - int(rng.integers(0, 1 + len(w) // 10))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = components({d: shingles(t, 4) for d, t in rows}, 85)
    assert dict(got(jaccard.jaccard_components(df, 4, 85), "doc_id", "component_id")) == want


def test_buckets_of_the_same_members_are_kept_once(spark):
    df = spark.createDataFrame([(key, d, 10 * d) for key, members in enumerate(((1, 2), (1, 2), (1, 2, 3), (4,), (5, 5), (2, 3, 1), (6, 7))) for d in members],
                               "key long, doc_id long, size int")
    found = {}
    for r in jaccard._distinct_buckets(df).collect():
        found.setdefault(r["key"], []).append((r["doc_id"], r["size"]))
    assert sorted(sorted(m) for m in found.values()) == [[(1, 10), (2, 20)], [(1, 10), (2, 20), (3, 30)], [(6, 60), (7, 70)]]


def test_written_tables_leave_no_shuffle_files(spark):
    """They are not read again, and on disk they would pile up until the driver collects its garbage."""
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in files.split("\n") if f.rsplit("/", 1)[-1].startswith("shuffle_")}

    before = shuffled()
    for write in (materialize, lambda df, label: store(df, label, 10)):
        assert len(write(spark.range(1000).repartition(4, "id").groupBy(F.col("id") % 7).count(), "test").collect()) == 7
    for _ in range(50):
        if not (left := shuffled() - before):
            break
        time.sleep(0.1)
    assert not left


def test_pigeonhole_guarantee():
    """Linked sets share a key that neither may skip, whichever buckets are the largest."""
    rng = np.random.default_rng(6)
    bands = jaccard.Bands(85)
    for n in (1, 2, 5, 9, 30, 100, 400, 1500):
        for _ in range(20):
            s = np.unique(rng.integers(1, 2**63, n, dtype=np.uint64))
            lose = int(rng.integers(0, int(0.15 * len(s)) + 1))
            t = rng.permutation(s)[lose:]
            while True:
                u = np.unique(np.concatenate((t, rng.integers(1, 2**63, int(rng.integers(0, lose + 1)), dtype=np.uint64))))
                common = len(np.intersect1d(s, u))
                if 100 * common >= 85 * (len(s) + len(u) - common):
                    break
                lose -= 1
                t = rng.permutation(s)[max(lose, 0):]
            small = min(bands.band(len(s)), bands.band(len(u)))
            assert abs(bands.band(len(s)) - bands.band(len(u))) <= 1
            (a, near), (b, _) = bands.keys(s, small), bands.keys(u, small)
            if set(a[:near]) & set(b):
                continue
            assert len(set(a[near:]) & set(b[near:] if len(b) >= near else b)) > bands.scheme(small).spare or set(a) & set(b[:near])


def test_quality(spark, docs):
    book = quality.apply_policy(quality.ledger(clashing(docs)), 1)
    out = {r["doc_id"]: r for r in book.collect()}
    assert all(out[i]["n_words"] == 0 and out[i]["base_failed"] and not out[i]["kept"] for i in (3, 4, 5))
    assert (out[10]["n_words"], out[10]["word_chars"]) == (1, 120_000) and out[1]["kept"]
    report = {r["rule"]: (r["n_failed"], r["n_only"]) for r in quality.ablations(book, 1).collect()}
    assert report["too_few_words"][0] == sum(r["n_words"] < 20 for r in book.collect())
    assert quality.ledger(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, " ".join(f"w{i % 9}" for i in range(27)))], "doc_id long, text string")
    assert quality.ledger(twice).first()["n_repeat_words"] == 27


def test_mixing(spark, docs):
    df = clashing(docs).withColumn("domain", F.lit("d"))
    out = mixing.mix(df, ["domain", "lang", "source"], {})
    assert out.filter("n_tokens = 0").count() == 0
    assert mixing.mix(df.limit(0), ["domain", "lang", "source"], {}).count() == 0


def fill(budget, children):
    """Shares of siblings (weight, supply) by repeated division of what is left."""
    got_, open_ = {k: 0.0 for k in children}, {k for k, (w, s) in children.items() if w > 0 and s > 0}
    while budget > 1e-9 and open_:
        unit = budget / sum(children[k][0] for k in open_)
        unit = min([unit, *((children[k][1] - got_[k]) / children[k][0] for k in open_)])
        for k in open_:
            got_[k] += unit * children[k][0]
            budget -= unit * children[k][0]
        open_ = {k for k in open_ if children[k][1] - got_[k] > 1e-9}
    return got_


def test_budgets_by_repeated_division(spark):
    rng = np.random.default_rng(7)
    leaves = [(f"d{i % 2}", f"l{i % 3}", f"s{i}", int(rng.integers(10, 3000))) for i in range(24)]
    weights = {"lang": {"l0": 5, "l1": 0}, "source": {"s3": 4}}
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    for total in (100.0, 5_000.0, 40_000.0, 10_000_000.0):
        out = {r["source"]: r["budget"] for r in mixing.leaf_budgets(df, ["domain", "lang", "source"], F.lit(total), weights, 2).collect()}

        def supply(keep):
            return 2 * sum(t for *k, t in leaves if keep(*k))

        want = {}
        for d, b in fill(total, {d: (1, supply(lambda x, y, z: x == d)) for d in ("d0", "d1")}).items():
            langs = fill(b, {la: (weights["lang"].get(la, 1), supply(lambda x, y, z: (x, y) == (d, la))) for la in ("l0", "l1", "l2")})
            for la, c in langs.items():
                want |= fill(c, {s: (weights["source"].get(s, 1), 2 * t) for x, y, s, t in leaves if (x, y) == (d, la)})
        assert all(abs(out[s] - want[s]) <= 1 for s in want)


def test_leaves_take_a_seeded_prefix(spark):
    rng = np.random.default_rng(8)
    rows = [(i, prose(rng, int(rng.integers(1, 60))), "en" if i % 3 else "de", "s") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mix(df, ["lang", "source"], {"lang": {"de": 3}}, share=0.6, max_epochs=3)
    tokens = {d: len(t.split()) for d, t, *_ in rows}
    total = int(0.6 * sum(tokens.values()))
    have = {la: sum(tokens[d] for d, _, x, _ in rows if x == la) for la in ("en", "de")}
    budget = fill(total, {"de": (3, 3 * have["de"]), "en": (1, 3 * have["en"])})
    for la in ("en", "de"):
        mine = out.filter(F.col("lang") == la)
        taken = mine.agg(F.sum("n_tokens")).first()[0]
        assert budget[la] - 1 <= taken < budget[la] + 60
        epochs = {r["epoch"]: r["count"] for r in mine.groupBy("epoch").count().collect()}
        full = sum(x == la for _, _, x, _ in rows)
        assert all(n == full for e, n in epochs.items() if e < max(epochs))
    again = mixing.mix(df.repartition(7), ["lang", "source"], {"lang": {"de": 3}}, share=0.6, max_epochs=3)
    assert sorted(got(again, "doc_id", "epoch")) == sorted(got(out, "doc_id", "epoch"))


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 3), (2, 7), (7, 1), (9, 8)], "a long, b long")
    assert dict(got(graph.components(links), "node", "component")) == {5: 3, 4: 3, 3: 3, 9: 8, 8: 8, 2: 1, 7: 1, 1: 1}
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert set(got(graph.components(chain), "component")) == {0}
    assert graph.components(links.limit(0)).count() == 0
