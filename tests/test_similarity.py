"""Blocked joins against brute force."""

import itertools
import random

import pytest

from pyspark.sql import functions as F

from sondhan.operators import dedup, entities, fuzzy, greedy


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choices("abcdefghij", k=30)) for _ in range(6)]
    rows = []
    for i in range(60):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(30)] = rng.choice("xyz")
        rows.append((i, rng.choice(["s", "t", None]), "a title here" if i % 3 else "a title there", " ".join(words)))
    rows += [(100, "s", None, "x y z"), (101, "s", "t", None), (102, "s", "", ""), (103, None, "one", "two"), (104, None, "one", "two")]
    df = spark.createDataFrame(rows, "id long, src string, title string, body string")
    got = {(r.a, r.b) for r in dedup.near_duplicates(df, "id", ["src"], "title", "body").collect()}

    def grams(t, k):
        w = (t or "").split()
        return set() if not w else {" ".join(w)} if len(w) < k else {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)}

    def j(x, y):
        return len(x & y) / len(x | y) if x and y else 0

    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[1] == b[1] and j(grams(a[2], 2), grams(b[2], 2)) >= 0.5 and j(grams(a[3], 3), grams(b[3], 3)) >= 0.85}
    assert got == want and (103, 104) in want


def test_greedy_removal_goes_on_with_a_marked_row(spark):
    pairs = spark.createDataFrame([(1, 2, 1), (1, 3, 3), (2, 3, 3)], "a long, b long, loser long")
    assert {r[0] for r in greedy.scan_losers(pairs).collect()} == {1, 3}


@pytest.mark.parametrize("seed", range(4))
def test_rounds_equal_the_sequential_procedures(spark, seed):
    rng = random.Random(seed)
    edges = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(90)})
    pairs = [(a, b, rng.choice([a, b])) for a, b in edges]
    gone, begun = set(), None
    for a, b, loser in pairs:
        if a != begun and a in gone:
            continue
        begun = a
        if b not in gone:
            gone.add(loser)
    frame = spark.createDataFrame(pairs, "a long, b long, loser long")
    assert {r.loser for r in greedy.scan_losers(frame).collect()} == gone
    lead = {}
    near = {v: {x + y - v for x, y in edges if v in (x, y)} for e in edges for v in e}
    for v in sorted(near):
        if v not in lead:
            lead[v] = v
            for o in near[v]:
                lead.setdefault(o, v)
    got = greedy.leader_clusters(frame.selectExpr("a as first", "b as then", "a as turn"))
    assert {(r.member, r.leader) for r in got.collect()} == set(lead.items())
    wishes = [(a, b, p, 1.0) for a in range(30) for p, b in enumerate(rng.sample(range(25), 3))]
    taken, want = set(), set()
    for a in range(30):
        if free := [b for x, b, _, _ in wishes if x == a and b not in taken]:
            taken.add(free[0])
            want.add((a, free[0]))
    assert {(r.a, r.b) for r in greedy.best_free(spark.createDataFrame(wishes, "a long, b long, place int, score double")).collect()} == want


def test_rounds_of_nothing(spark):
    none = spark.createDataFrame([], "a long, b long, loser long, place int, score double")
    assert greedy.scan_losers(none).count() == greedy.best_free(none).count() == greedy.leader_clusters(none.selectExpr("a as first", "b as then", "a as turn")).count() == 0


def test_vocabulary_match_equals_brute_force(spark):
    rng = random.Random(7)
    vocab = sorted({"".join(rng.choices("abcde", k=rng.randint(1, 8))) for _ in range(150)})
    terms = rng.sample(vocab, 12) + ["ঢাকায়", "zz"]
    got = {(r.term, r.word): round(r.sim, 6) for r in fuzzy.vocabulary_match(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([(w,) for w in vocab + ["ঢাকা"]], "word string")).collect()}

    def tri(w):
        return {w} if len(w) < 3 else {w[i : i + 3] for i in range(len(w) - 2)}

    want = {}
    for t in set(terms):
        for w in {*vocab, "ঢাকা"}:
            sim = max(100 * len(tri(t) & tri(w)) / len(tri(t) | tri(w)), round(fuzzy.lcs_ratio(t, w)))
            if sim >= 70:
                want[(t, w)] = round(float(sim), 6)
    assert got == want


def test_fuzzy_clusters_equal_brute_force(spark):
    rng = random.Random(9)
    names = []
    for _ in range(25):
        w = "".join(rng.choices("abcdefgh", k=rng.randint(3, 14)))
        names += [w] + ["".join(rng.sample(w[i] + rng.choice("xyz"), 2)).join([w[:i], w[i + 1 :]]) for i in (rng.randrange(len(w)),)]
    counts = spark.createDataFrame([(n, rng.randint(1, 9), "ORG") for n in dict.fromkeys(names)], "text string, n long, kind string")
    got = {r.key: r.leader for r in entities.cluster_fuzzy(counts).collect()}
    order = sorted(((r.n, r.text) for r in counts.collect()), key=lambda x: (-x[0], x[1]))
    want = {}
    for _, k in order:
        if k not in want:
            want[k] = k
            for _, o in order:
                if o not in want and fuzzy.lcs_ratio(k, o) >= 85:
                    want[o] = k
    assert got == want


def test_jaccard_of_empty_sets_is_zero(spark):
    from sondhan.functions.text import jaccard

    row = spark.range(1).select(jaccard(F.array().cast("array<string>"), F.array(F.lit("a")))).first()
    assert row[0] == 0.0
