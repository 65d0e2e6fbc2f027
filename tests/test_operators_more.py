"""Search entry point, plug-ins, writers and the smaller operators."""

import glob
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sondhan.operators import dedup, entities, fuzzy, graph, lexical, plugins, search, semantic
from sondhan.operators.blocks import block_join
from sondhan.sources import files, html

DOCS = [(1, "Pension backlog", "workers wait for the pension", "u1"), (2, "Night market", "traders want a permit for the night market", "u2"), (3, None, None, None), (4, "Budget", "district budget and pension budget " * 10, "u4")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, title string, body string, url string")


@pytest.fixture(scope="module")
def searcher(spark, docs):
    e = semantic.HashEmbedder(64)
    vectors = semantic.embed(docs.withColumn("t", F.concat_ws(" ", "title", "body")), "doc_id", "t", e).select("doc_id", "embedding")
    return search.Search(lexical.Index(docs, "doc_id", lexical.full_text(F.col("title"), F.col("body"))), vectors, e)


def test_dispatch(spark, docs, searcher):
    q = spark.createDataFrame([(7, "pension"), (8, "market permit"), (9, "")], "query_id long, text string")
    for method in search.METHODS:
        got = searcher.search(q, method, k=2)
        rows = {(r.query_id, r["rank"]): r.doc_id for r in got.collect()}
        assert rows[8, 1] == 2 and rows[7, 1] in (1, 4), method
        assert max(r for _, r in rows) <= 2
    with pytest.raises(ValueError):
        searcher.search(q, "regex")
    with pytest.raises(ValueError):
        search.Search(searcher.index).search(q, "semantic")
    assert search.Search(searcher.index).search(q, "hybrid").count() > 0
    shown = {r.doc_id: r for r in search.present(spark.createDataFrame([(3, 1.0), (4, 2.0)], "doc_id long, score double"), docs).collect()}
    assert (shown[3].title, shown[3].body, shown[3].url) == ("-", "-", "-") and len(shown[4].body) == 150
    rows = search.labeling_rows(searcher.search(q, "bm25", 50), docs, q).collect()
    assert all(r.relevant == "" and r.annotator == "" and "." in r.score for r in rows)


def test_index_equals_a_fresh_computation_and_empty_corpus(spark, docs):
    assert lexical.Index(docs.filter("doc_id > 9"), "doc_id", F.col("body")).bm25(spark.createDataFrame([(1, "x")], "query_id long, text string")).count() == 0


def test_block_join_sees_every_pair_once(spark):
    a, b = spark.range(37).withColumnRenamed("id", "x"), spark.range(101).withColumnRenamed("id", "y")
    run = lambda p, q: pd.DataFrame([(x, y) for x in p["x"] for y in q["y"]], columns=["x", "y"]).astype("int64")
    got = block_join(a, b, "x", "y", run, "x long, y long", query_rows=10, item_rows=25)
    assert got.count() == got.distinct().count() == 37 * 101
    assert block_join(a.filter("x > 99"), b, "x", "y", run, "x long, y long").count() == 0


def test_ratios_of_many_words_equal_one_at_a_time(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abcdeকখগ", k=n))
    words = [word(rng.randint(1, 15)) for _ in range(300)] + ["x" * 300, "a" * 70]
    terms = [word(rng.randint(1, 12)) for _ in range(12)] + ["a" * 70, ""]
    got = {(r.term, r.word): r.sim for r in fuzzy.vocabulary_match(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    grams = lambda w: {w[i : i + 3] for i in range(max(1, len(w) - 2))}
    for t in set(terms) - {""}:
        for w in set(words):
            jac = 100 * len(grams(t) & grams(w)) / len(grams(t) | grams(w))
            sim = max(jac, round(fuzzy.lcs_ratio(t, w)))
            assert (sim >= 70) == ((t, w) in got) and (sim < 70 or abs(got[t, w] - sim) < 1e-9), (t, w)


def test_paired_ratios_equal_one_at_a_time():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abcকখ ", k=n))
    a = [word(rng.choice([0, 1, 7, 8, 9, 20, 63, 64, 65, 90])) for _ in range(600)] + ["", "a\0b", "same"]
    b = [word(rng.choice([0, 1, 5, 16, 33, 64, 70])) for _ in range(600)] + ["", "ab", "same"]
    got = fuzzy.paired_ratios(a, b)
    assert all(abs(g - fuzzy.lcs_ratio(x, y)) < 1e-9 for g, x, y in zip(got, a, b)) and len(fuzzy.paired_ratios([], [])) == 0


def test_embeddings_come_from_the_cache_if_the_text_is_the_same(spark):
    class Counting(semantic.HashEmbedder):
        def embed(self, texts):
            if any("cached" in t for t in texts):
                raise AssertionError("computed again")
            return super().embed(texts)

    rows = spark.createDataFrame([(1, "cached text"), (2, "new text")], "id long, text string")
    cache = semantic.embed(rows.filter("id = 1"), "id", "text", semantic.HashEmbedder(64))
    got = {r.id: r.embedding for r in semantic.embed_missing(rows, "id", "text", Counting(64), cache).collect()}
    assert set(got) == {1, 2}
    near = semantic.knn_by_model(spark.createDataFrame([(5, "new text")], "q long, text string"), semantic.embed_missing(rows, "id", "text", semantic.HashEmbedder(64), cache), "q", "id", "text", [semantic.HashEmbedder(64)], 1).collect()
    assert [(r.model, r.id, r["rank"]) for r in near] == [("hash-64", 2, 1)]


def test_extractors_are_routed_and_isolated(spark):
    class Broken:
        def extract(self, text):
            raise RuntimeError("no model")

    rows = spark.createDataFrame([(1, "Rahim Uddin met Karim Khan and Rahim Uddin", "en"), (2, "ঢাকা থেকে", "bn"), (3, "x", "fr"), (4, "x", "xx"), (5, None, "en"), (6, "x", None), (7, " ", "en")], "id long, text string, lang string")
    got = {r.id: r.entities for r in plugins.extract_entities(rows.withColumnRenamed("id", "id"), "id", "text", "lang", {"en": plugins.CapitalRuns(), "bn": plugins.Gazetteer({"ঢাকা": "B-LOC"}), "fr": Broken()}, others={"MISC": "MISC"}).withColumnRenamed("key", "id").collect()}
    assert [e.text for e in got[1]] == ["Rahim Uddin", "Karim Khan"] and [(e.text, e.label, e.start) for e in got[2]] == [("ঢাকা", "LOC", 0)]
    assert all(got[i] == [] for i in (3, 4, 5, 6, 7))
    found = [{"word": "##Ra", "entity_group": "B-PER", "score": 0.91239}, {"word": "low", "label": "ORG", "score": 0.4}, {"word": "Ra", "label": "I-PER"}, {"word": " ", "label": "LOC"}, {"word": "q", "label": "DATE"}]
    assert plugins.tidy_entities(found) == [{"text": "Ra", "label": "PERSON", "start": 0, "end": 0, "confidence": 0.912}]
    assert plugins.Gazetteer({}).extract("x") == []


def test_translators_and_detectors(spark):
    rows = spark.createDataFrame([(1, " Dhaka ", "bn"), (2, "unknown", "bn"), (3, None, "bn")], "id long, text string, target string")
    assert {r.id: r.translated for r in plugins.translate(rows, "id", "text", "target", plugins.MapTranslator({"dhaka": "ঢাকা"})).collect()} == {1: "ঢাকা", 2: "unknown", 3: None}
    assert {r.id: r.language for r in plugins.detect(rows, "id", "text", plugins.ScriptDetector()).collect()} == {1: "en", 2: "en", 3: "unknown"}


def test_writers_and_readers(spark, tmp_path):
    hits = spark.createDataFrame([("q|1", 1, 0.5, None), (None, None, None, "t_&")], "query string, rank long, score double, title string")
    files.write_results(hits, str(tmp_path / "out"))
    back = files.read_csv(spark, str(tmp_path / "out/csv")).collect()
    assert {(r["query"], r["rank"], r["score"], r["title"]) for r in back} == {("q|1", "1", "0.500", "-"), ("-", "0", "0.000", "t_&")}
    assert len(files.markdown_table(spark.range(1500).toDF("n")).split("\n")) == 1502
    tex = files.latex_table(hits)
    assert r"t\_\&" in tex and tex.startswith(r"\begin{tabular}{llll}")
    nodes = spark.createDataFrame([("a&b", 'say "x"'), ("c", None)], "node string, label string")
    edges = spark.createDataFrame([("a&b", "c", 3)], "src string, dst string, weight long")
    files.write_gexf(nodes, edges, str(tmp_path / "g.gexf"))
    n, e = files.read_gexf(spark, str(tmp_path / "g.gexf"))
    assert {(r.node, r.label or None) for r in n.collect()} == {("a&b", 'say "x"'), ("c", None)} and [tuple(r) for r in e.collect()] == [("a&b", "c", 3.0)]
    doc = json.loads(files.graph_json(nodes, edges).first()["json"])
    assert len(doc["nodes"]) == 2 and doc["edges"][0]["target"] == "c"
    (tmp_path / "map.json").write_text('{"dhaka": {"en": "Dhaka", "bn": "ঢাকা", "type": "GPE"}}')
    assert [(r.key, r.value.bn) for r in files.read_map(spark, str(tmp_path / "map.json")).collect()] == [("dhaka", "ঢাকা")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text('{"url": "u", "title": "t", "body": "b", "tokens": 3, "date": "2025-01-01"}\n')
    (tmp_path / "in/b.jsonl").write_text("{broken\n")
    done = files.convert_directory(spark, str(tmp_path / "in"), str(tmp_path / "conv"))
    assert done["a.jsonl"] == "ok" and done["b.jsonl"] != "ok" and glob.glob(str(tmp_path / "conv/a/*.parquet"))


def test_links_sources_and_pages(spark):
    page = """<a href="/news/one-12345">1</a><A class='x' HREF='two.html#part'>2</A><a href='//other.example/x'>3</a><a href="mailto:a@b">4</a><a href="#top">5</a><a href="https://news.example/video/1">6</a><a href="/news/one-12345">again</a>"""
    rows = spark.createDataFrame([("https://news.example/dir/page.html", page), ("https://news.example", "<a href='x'>1</a>"), ("https://news.example/none", None)], "url string, html string")
    got = {(r.page, r.link) for r in html.discover_links(rows, "url", "html").collect()}
    base = "https://news.example/dir/page.html"
    assert got == {(base, "https://news.example/news/one-12345"), (base, "https://news.example/dir/two.html"), (base, "https://other.example/x"), ("https://news.example", "https://news.example/x")}
    assert html.discover_links(rows, "url", "html", r"-\d{5,}$").count() == 1
    plan = {r.source: r.variant for r in html.source_plan(spark.createDataFrame([("bdnews24",), ("newage",), ("nobody",)], "source string"), "source", ["cloud"]).collect()}
    assert plan == {"bdnews24": "cloud", "newage": "default"}
    pages = {0: None, 1: {"items": [1, 2, 3]}, 2: None, 3: None, 4: {"items": [4]}, 5: {"items": []}}
    calls = iter(range(9))
    assert list(html.paged(lambda offset, limit: pages[next(calls)], 10)) == [1, 2, 3, 4]
    assert list(html.paged(lambda offset, limit: None, 10)) == [] and list(html.paged(lambda o, n: {"items": list(range(o, o + n))}, 70)) == list(range(70))


def test_small_entity_operators(spark):
    r = spark.createDataFrame([("E1", "A", None), ("E2", "B", ""), ("E3", None, "খ"), ("E4", "D", "ঘ")], "entity_id string, canonical_en string, canonical_bn string")
    links = spark.createDataFrame([("E1", "E3"), ("E4", "E3")], "en_id string, bn_id string")
    assert {x.entity_id: (x.canonical_bn, x.linked) for x in entities.apply_links(r, links).collect()} == {"E1": ("খ", True), "E2": ("", False), "E3": ("খ", False), "E4": ("ঘ", False)}
    m = spark.createDataFrame([("X1", " Foo "), ("X1", " Foo "), ("X1", "bar"), ("X2", "nobody"), ("E1", "A"), (None, "z")], "entity_id string, text string")
    look = spark.createDataFrame([("foo", "E1"), ("bar", "E2")], "name string, entity_id string")
    assert {(x.old_id, x.name, x.entity_id) for x in entities.recover_orphans(m, r, look).collect()} == {("X1", " Foo ", "E1"), ("X2", "nobody", None)}
    names = spark.createDataFrame([("ঢাকা শহর", "LOC"), ("করিম", "PER")], "name string, label string")
    d = spark.createDataFrame([(1, "আজ ঢাকা শহর, করিম। করিম"), (2, None), (3, "")], "doc_id long, body string")
    assert {(x.doc_id, x.text, x.label) for x in entities.gazetteer_mentions(d, "doc_id", "body", names).collect()} == {(1, "ঢাকা শহর", "LOC"), (1, "করিম", "PER")}
    t = spark.createDataFrame([("Raw X", "ORG"), ("The Bank", "ORG"), ("other", "ORG")], "t string, k string")
    assert [x[0] for x in t.select(entities.mapped_entity(F.col("t"), F.col("k"), {"Raw X": "Clean", "Bank": "বাংক"})).collect()] == ["Clean", "বাংক", "other"]


def test_classes_of_near_duplicates(spark):
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "s", "a title here", body) for i in range(4)] + [(9, "s", "a title here", body + " more"), (10, "t", "a title here", body), (11, "s", None, body), (12, "s", "other", "x")]
    df = spark.createDataFrame(rows, "id long, source string, title string, body string")
    sets = dedup.near_sets(df, "id", ["source"], "title", "body")
    got = {r.k: (r.copies, r.links) for r in dedup.near_classes(sets, dedup.near_class_pairs(sets, ["source"])).collect()}
    assert got == {0: (4, 4), 1: (4, 4), 2: (4, 4), 3: (4, 4), 9: (1, 4), 10: (1, 0), 12: (1, 0)}
    longest = dedup.dedup_longest(spark.createDataFrame([(1, "http://a/x", 5), (2, "https://www.a/x/", 9), (3, "a/x?q", None), (4, None, 99)], "id long, url string, tokens int"), "url", "tokens", "id")
    assert [r.id for r in longest.collect()] == [2]
    e = spark.createDataFrame([(1, 2, 10), (2, 3, 100)], "src long, dst long, weight long")
    assert {r.width for r in graph.view_edges(e).collect()} == {3.0, 10.0}


def test_cosine_in_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    df = spark.createDataFrame([*rows, (999, None)], "i long, v array<double>")
    q = df.filter("i % 20 = 0").withColumnRenamed("i", "q")
    got = {(r.q, r["rank"]): r.i for r in semantic.cosine_top_k(q, df, "q", "i", "v", 3).collect()}
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for a in range(0, 300, 20):
        best = sorted(range(300), key=lambda b: (-round(float(m[a] @ m[b]), 6), b))[:3]
        assert [got[a, r] for r in (1, 2, 3)] == best
