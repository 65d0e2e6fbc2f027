import random

import numpy as np
from pyspark.sql import functions as F

from sondhan.operators import entities, graph, querying
from sondhan.plans import knowledge


def test_seed_pairs_and_their_collisions(spark):
    rows = spark.createDataFrame([("Dhaka ", "en"), ("চট্টগ্রাম", "bn"), ("কুমিল্লা", "bn"), ("x", "en"), (None, "en")], "t string, l string")
    got = [r[0] for r in rows.select(entities.seed_link(F.col("t"), F.col("l"))).collect()]
    assert got == ["ঢাকা", "chittagong", "cumilla", None, None] and len(entities.SEED_PAIRS) == 31


def test_entity_normalisation(spark):
    rows = spark.createDataFrame([("The Bank's", "ORG"), ("The Hague", "GPE"), ("ও", "PERSON"), ("x", "ORG"), (' "Amir  Khan" ', "PERSON"), (None, None)], "t string, k string")
    assert [r[0] for r in rows.select(entities.normalize_entity(F.col("t"), F.col("k"))).collect()] == ["Bank", "The Hague", "", "", "Amir Khan", ""]


def test_ids_follow_the_order(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(1).sample(range(500), 500)], "v int").repartition(5)
    got = entities.number_entities(df, ["v"]).collect()
    assert sorted((r.v, r.entity_id) for r in got) == [(i, f"E{i:05d}") for i in range(500)]


def test_greedy_links_give_each_side_once(spark):
    s = spark.createDataFrame([("P", 1, 7, 0.95), ("P", 2, 7, 0.99), ("P", 2, 8, 0.9), ("P", 3, 8, 0.5)], "kind string, en_id long, bn_id long, score double")
    assert {(r.en_id, r.bn_id) for r in entities.greedy_links(s).collect()} == {(1, 7), (2, 8)}


def vectors(spark, tmp_path):
    rng = np.random.default_rng(5)
    v, label = rng.normal(size=(800, 6)), rng.integers(0, 2, 800)
    rows = [(i, int(label[i]), [float(x) for x in v[i]]) for i in range(800)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return np.round(u @ u.T, 6), label


def test_links_over_all_labels_find_the_nearest_vector(spark, tmp_path):
    scores, label = vectors(spark, tmp_path)
    others = [i for i in range(800) if i % 20]
    want = {e: max(others, key=lambda b: (scores[e, b], -b)) for e in range(0, 800, 20)}
    assert any(label[e] != label[b] for e, b in want.items())
    assert {r.en_id: r.bn_id for r in knowledge.argmax_link_all(spark, str(tmp_path)).collect()} == want
    audit = knowledge.link_audit_all(spark, str(tmp_path)).collect()
    assert [(r.en_id, r.bn_id) for r in audit] == sorted(want.items(), key=lambda x: (-scores[x], x[0]))


def test_greedy_knn_links_use_the_real_ids(spark, tmp_path):
    scores, label = vectors(spark, tmp_path)
    taken, want = set(), {}
    for e in range(0, 800, 20):
        near = sorted((i for i in range(800) if i % 20 and label[i] == label[e]), key=lambda b: (-scores[e, b], b))[:3]
        if free := [b for b in near if b not in taken and scores[e, b] >= 0.2]:
            want[e] = free[0]
            taken.add(free[0])
    assert max(want.values()) >= 97
    assert {r.en_id: r.bn_id for r in knowledge.greedy_knn_link(spark, str(tmp_path)).collect()} == want


def test_merge_duplicates_keeps_the_row_with_an_english_name(spark):
    r = spark.createDataFrame([("E2", None, "ঢাকা", ["a", None], 1), ("E3", "Dhaka", "ঢাকা", ["b", "a"], 2), ("E4", None, None, None, 5)], "entity_id string, canonical_en string, canonical_bn string, aliases array<string>, total_mentions int")
    m = entities.merge_duplicates(r, "canonical_bn").collect()
    assert [(x.entity_id, x.aliases, x.total_mentions, x.merged) for x in m] == [("E3", ["a", "b"], 3, 2)]
    assert entities.id_map(r, "canonical_bn").collect() == [("E2", "E3")]


def test_cooccurrence_skips_heavy_groups(spark):
    rows = [(1, 1), (1, 2), (2, 1), (2, 2), (2, 2), (3, None), (None, 1)] + [(9, i) for i in range(60)] + [(8, i) for i in range(60)]
    e = graph.cooccurrence(spark.createDataFrame(rows, "g long, i long"), "g", "i").collect()
    assert [(r.src, r.dst, r.weight) for r in e] == [(1, 2, 2)]


def test_components_against_union_find(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, dst long, weight int")).collect()}
    assert got == {x: find(x) for x in parent}


def test_windows_and_expansion(spark):
    q = spark.createDataFrame([(1, "Dhaka city news"), (2, "")], "query_id long, text string")
    r = spark.createDataFrame([("E1", "Dhaka City", "ঢাকা", ["Dhaka", "the town"]), ("E2", "Khulna", None, None)], "entity_id string, canonical_en string, canonical_bn string, aliases array<string>")
    near = spark.createDataFrame([("E1", "E2", 1)], "entity_id string, neighbour string, rank long")
    got = {x.query_id: x.expanded for x in querying.expand_queries(q, r, near).collect()}
    assert got == {1: "Dhaka Dhaka City Khulna city news the town ঢাকা"}
    hits = querying.match_entities(q, querying.name_lookup(r)).collect()
    assert {(h.phrase, h.size) for h in hits} == {("dhaka city", 2), ("dhaka", 1)}


def test_only_whole_query_pins_translate(spark):
    q = spark.createDataFrame([(1, "Dhaka"), (2, "Dhaka news"), (3, "rice")], "query_id long, text string")
    pins = spark.createDataFrame([(1, "dhaka", "ঢাকা"), (2, "dhaka", "ঢাকা")], "query_id long, phrase string, target string")
    d = spark.createDataFrame([("rice", "ধান")], "phrase string, target string")
    assert {r.query_id: r.translated for r in querying.translate(q, pins, d).collect()} == {1: "ঢাকা", 2: "Dhaka news", 3: "ধান"}
