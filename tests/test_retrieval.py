"""Rankers, fusion and metrics against formulas written out in Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondhan.operators import evaluation, fusion, lexical, semantic


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices("alpha beta gamma delta eps zeta".split(), k=rng.randint(0, 12)))) for i in range(40)] + [(40, None), (41, "")]
    qs = [(1, "alpha beta"), (2, "gamma gamma zeta"), (3, ""), (4, "nothing"), (5, None)]
    return docs, qs, spark.createDataFrame(docs, "doc long, body string"), spark.createDataFrame(qs, "query_id long, text string")


def rows(df):
    return {(r.query_id, r.doc_id): r.score for r in df.collect()}


def test_bm25_and_tfidf(small):
    docs, qs, d, q = small
    text = lexical.full_text(F.lit(None).cast("string"), F.col("body"))
    words = {i: (t or "").split() for i, t in docs}
    n, avg = len(docs), sum(map(len, words.values())) / len(docs)
    df = Counter(w for ws in words.values() for w in set(ws))
    bm, tf = {}, {}
    for i, t in qs:
        for j, ws in words.items():
            c = Counter(ws)
            hit = [w for w in (t or "").split() if c[w]]
            if hit:
                bm[(i, j)] = sum(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * len(ws) / avg)) for w in hit)
                tf[(i, j)] = sum((1 + math.log(c[w])) * (math.log(n / (df[w] + 1)) + 1) for w in hit)
    assert rows(lexical.bm25_scores(q, d, "doc", text)) == pytest.approx(bm)
    assert rows(lexical.tfidf_scores(q, d, "doc", text)) == pytest.approx(tf)


def test_top_k_breaks_ties_by_document(spark):
    s = spark.createDataFrame([(1, 3, 0.5), (1, 2, 0.5), (1, 1, 0.1)], "query_id long, doc_id long, score double")
    assert [(r.doc_id, r.rank) for r in lexical.top_k(s, 2).orderBy("rank").collect()] == [(2, 1), (3, 2)]


def test_cosine_top_k(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(50, 8))
    m[7] = 0
    e = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(99, None)], "id long, v array<float>")
    got = semantic.cosine_top_k(e.filter("id < 5").withColumnRenamed("id", "q"), e, "q", "id", "v", 3)
    unit = m.astype(np.float32).astype(float)
    unit = unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-30)
    want = {q: list(np.argsort(-np.round(unit @ unit[q], 6), kind="stable")[:3]) for q in range(5)}
    assert {q: [r.id for r in got.filter(f"q = {q}").orderBy("rank").collect()] for q in range(5)} == want
    assert semantic.cosine_top_k(e.filter("id < 0").withColumnRenamed("id", "q"), e, "q", "id", "v", 3).count() == 0


def test_embedder_plug_in(spark):
    df = spark.createDataFrame([(1, "dhaka news"), (2, None), (3, "dhaka news")], "id long, text string")
    got = {r.id: r for r in semantic.embed(df, "id", "text", semantic.HashEmbedder(16)).collect()}
    assert got[1].embedding == got[3].embedding and got[1].text_hash == got[3].text_hash and len(got[2].embedding) == 16


def test_normalisation_corner_cases(spark):
    s = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0), (2, 1, 1.0), (2, 2, 3.0), (2, 3, None), (3, 1, 0.0), (None, 1, 4.0)], "g long, i long, s double")
    got = {(r.g, r.i): (r.a, r.b) for r in fusion.maxnorm(fusion.minmax(s, "g", "s", "a"), "g", "s", "b").collect()}
    assert got == {(1, 1): (1.0, 1.0), (1, 2): (1.0, 1.0), (2, 1): (0.0, 1 / 3), (2, 2): (1.0, 1.0), (2, 3): (None, 0.0), (3, 1): (1.0, 0.0), (None, 1): (1.0, 1.0)}


def test_weights_and_presets():
    assert fusion.normalize_weights({"a": 1, "b": 1}) == {"a": 0.5, "b": 0.5}
    assert all(abs(sum(p) - 1) < 0.011 for p in fusion.PRESETS.values())


def test_union_of_scores(spark):
    a = spark.createDataFrame([(1, 1, 0.5)], "query_id long, doc_id long, score double")
    b = spark.createDataFrame([(1, 2, 0.7)], "query_id long, doc_id long, score double")
    got = {r.doc_id: (r.x, r.y) for r in fusion.union_scores({"x": a, "y": b}).collect()}
    assert got == {1: (0.5, None), 2: (None, 0.7)}


def test_worked_metrics_example(spark):
    run = spark.createDataFrame([(1, i, i) for i in range(1, 11)] + [(2, 1, 1)], "query_id long, doc_id long, rank long")
    rel = spark.createDataFrame([(1, i) for i in (1, 3, 4, 6, 8, 9, 90, 91)] + [(1, 1)], "query_id long, doc_id long")
    m = {r.query_id: r for r in evaluation.metrics(run, rel).collect()}
    assert (m[1].precision_at_10, m[1].recall_at_50, m[1].mrr) == (0.6, 0.75, 1.0)
    dcg = sum(1 / math.log2(r + 1) for r in (1, 3, 4, 6, 8, 9)) / sum(1 / math.log2(i + 1) for i in range(1, 9))
    assert m[1].ndcg_at_10 == pytest.approx(dcg, abs=1e-6)
    assert (m[2].precision_at_10, m[2].recall_at_50, m[2].ndcg_at_10, m[2].mrr) == (0, 0, 0, 0)


def test_confusion_counts_sum_to_the_corpus(spark):
    run = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "query_id long, doc_id long, rank long")
    rel = spark.createDataFrame([(1, 2), (1, 5)], "query_id long, doc_id long")
    r = evaluation.confusion(run, rel, spark.createDataFrame([(10,)], "n long")).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 1, 1, 7)


def test_merge_prefers_the_left_list_on_ties(spark):
    left = spark.createDataFrame([(1, 10, 0.5, 1)], "query_id long, doc_id long, score double, rank long")
    right = spark.createDataFrame([(1, 1, 0.5, 1), (1, 2, 0.9, 2)], "query_id long, doc_id long, score double, rank long")
    assert [r.doc_id for r in fusion.merge_ranked(left, right, 2).orderBy("rank").collect()] == [2, 10]


def test_first_k_are_those_of_all_scores(spark):
    """Rare and common words, queries of the same words, ties, repeated words, words no document has, documents without words."""
    rng = random.Random(7)
    some = lambda n: " ".join(rng.choices(["of", "the", "bank", *(f"w{i}" for i in range(60))], [30, 20, 10] + [1] * 60, k=n))
    docs = [(i, some(rng.randint(0, 9))) for i in range(300)] + [(i, "bank of the river") for i in range(300, 330)] + [(400, None), (401, " "), (None, "of the bank of lost w1")]
    qs = [(i, some(rng.randint(1, 6))) for i in range(80)] + [(100, "of"), (101, "OF  of"), (102, "of"), (103, "nowhere"), (104, "of nowhere"), (105, ""), (106, None), (107, "river bank"), (108, "bank of the lost")]
    d, q = spark.createDataFrame(docs, "doc long, body string"), spark.createDataFrame(qs, "query_id long, text string")
    ranked = lambda df: {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in df.collect()}
    for k in (1, 10):
        want = ranked(lexical.top_k(lexical.bm25_scores(q, d, "doc", F.col("body")).withColumn("score", F.round("score", 6)), k))
        got = lexical.bm25_top_k(q, d, "doc", F.col("body"), k)
        assert got.columns == ["query_id", "doc_id", "score", "rank"] and ranked(got) == want and len(want) > 60 * k and (k == 1 or any(doc is None for doc, _ in want.values()))
    assert lexical.bm25_top_k(q.limit(0), d, "doc", F.col("body")).count() == 0
    assert lexical.bm25_top_k(q, d.limit(0), "doc", F.col("body")).count() == 0


def shuffled(spark) -> int:
    """Rows written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_expanded_queries_do_not_meet_every_document(spark, tmp_path):
    """500 records that ask, half of them for "news of ...", against 1,000 articles that all say "of": 567,230 rows shuffled when every pair was scored."""
    from sondhan.plans import knowledge, retrieval

    d = str(tmp_path)
    spark.createDataFrame([(f"E{10 * i:08d}", f"Name{i} of Town", None, ["Town"]) for i in range(500)], "entity_id string, canonical_en string, canonical_bn string, aliases array<string>").write.parquet(f"{d}/entity_records.parquet")
    spark.createDataFrame([(f"E{10 * i:08d}", f"E{10 * i + 10:08d}", True) for i in range(0, 498, 3)], "left_id string, right_id string, matched boolean").write.parquet(f"{d}/entity_matches.parquet")
    spark.createDataFrame([(i, f"name{i} of" if i % 2 else None, "of town " * (i % 7) + "of all", "en") for i in range(1000)], "article_id long, title string, body string, language string").write.parquet(f"{d}/articles.parquet")
    spark.createDataFrame([(1, "all of town"), (2, None)], "search_id long, query string").write.parquet(f"{d}/hybrid_results_labse.parquet")
    began, small = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # joins as of large tables
    try:
        got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in knowledge.expanded_topk(spark, d).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert shuffled(spark) - began < 200_000
    q = knowledge.query_expand(spark, d).select("query_id", F.col("expanded").alias("text"))
    assert got == {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in retrieval._ranked(retrieval.index(spark, d).bm25(q)).collect()}
    assert len(got) == 5010
