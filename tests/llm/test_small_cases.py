"""Edge cases and brute-force checks of the training-data operators."""

import collections
import itertools
import random

import numpy as np
import pytest

from sondhan.llm import boilerplate, components, languages, linking, lookalike, names, packing, ranking, residue, tokens
from sondhan.session import checkpoint, materialise

EN = "The report says that the water plant was approved after a long debate and the officials will meet in the town."
FR = "Le rapport indique que la station a été approuvée après un long débat et que les familles de la ville sont touchées."
BN = "প্রতিবেদনে বলা হয়েছে, পানি শোধনাগার অনুমোদন পেয়েছে এবং কর্মকর্তারা বলেন যে এই ব্যবস্থা কত দিন টিকবে তা স্পষ্ট নয়।"
ROMAN = "ekhon porjonto keu kichu bole nai, amader sobai opekkha korche. tobe tara bolen je porikolpona khub valo ebong kono dam bereche nai kintu hobe."


# --- p2

def test_ranking_prefers_all_round_items_to_one_sided_ones(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        good = i < 10
        rows.append((1, i, 30 + rng.random() if good else rng.random() * 10, 400 + rng.random() if good else rng.random() * 100, 96.2 + rng.random() / 100 if good else 95 + rng.random()))
    rows += [(1, 100, 900.0, None, 95.0), (1, 101, 0.1, 9000.0, 95.0), (1, 102, None, None, 99.0), (1, 5, 30.0, 400.0, 96.2), (None, 1, 1.0, 1.0, 1.0), (2, 7, None, None, None), (3, 1, 5.0, 5.0, float("nan")), (3, 2, 5.0, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "s long, i long, a double, b double, c double")
    got = ranking.ideal_point_ranking(df, "s", "i", ["a", "b", "c"], k=10).collect()
    assert {r.i for r in got if r.s == 1} == set(range(10))
    assert {(r.s, r.i, r["rank"]) for r in got if r.s != 1} == {(2, 7, 1), (3, 1, 1), (3, 2, 2)}
    assert ranking.ideal_point_ranking(df.filter("s = 9"), "s", "i", ["a", "b", "c"]).count() == 0


# --- p3

def test_components_equal_union_find(spark):
    rng = random.Random(3)
    pairs = [(f"E{rng.randrange(300):03d}", f"E{rng.randrange(300):03d}") for _ in range(160)] + [(f"Z{i:03d}", f"Z{i + 1:03d}") for i in range(80)] + [(None, "E001"), ("E001", None), ("Q", "Q")]
    parent = {x: x for p in pairs if None not in p and p[0] != p[1] for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(pairs * 2, "a string, b string")
    got = {r.vertex: r.component for r in components.connected_components(df, "a", "b").collect()}
    assert got == {x: find(x) for x in parent}
    assert components.connected_components(df.filter("a = 'nope'"), "a", "b").count() == 0


def test_hot_vertices_are_looked_up_apart(spark):
    pairs = [("hub", f"leaf{i:04d}") for i in range(1500)] + [(f"leaf{i:04d}", f"tail{i:04d}") for i in range(0, 1500, 50)] + [("x", "y")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = {r.vertex: r.component for r in components.connected_components(df, "a", "b", hot_vertices=10).collect()}
    assert got == {v: "x" if v in "xy" else "hub" for p in pairs for v in p}


def size_digits(df):
    """Binary digits of the largest size that the optimiser holds for a node of the plan."""
    plan, found = [df._jdf.queryExecution().optimizedPlan()], []
    while plan:
        node = plan.pop()
        found.append(node.stats().sizeInBytes().bit_length())
        plan += [node.children().apply(i) for i in range(node.children().size())]
    return max(found)


def test_size_estimates_do_not_grow_with_the_rounds(spark):
    # each round's joins multiplied the estimates of the last: after 14 rounds the number itself filled the driver
    work = spark.createDataFrame([(f"v{i:03d}", f"v{i + 1:03d}") for i in range(200)], "a string, b string")
    groups = components.connected_components(work, "a", "b")
    assert groups.count() == 201 and groups.filter("component <> 'v000'").count() == 0
    assert size_digits(groups) < 1000
    for _ in range(6):
        work = checkpoint(work.join(work.toDF("a", "c"), "a").select("a", "b"))
    assert work.count() == 200 and work.schema.simpleString() == "struct<a:string,b:string>"
    assert size_digits(work) < 100


def test_ties_follow_the_statement(spark):
    r = spark.createDataFrame([("E1", ["Ab", "-"]), ("E2", ["Ab", None, ""]), ("E3", ["ab", "-", " "]), ("E4", None), ("E5", []), ("E6", ["!"]), ("E7", ["!"])], "entity_id string, aliases array<string>")
    m = spark.createDataFrame([("E3", "E4", True), ("E4", "E3", True), ("E5", "E6", False), ("E5", "E7", None), ("E9", "E1", True), (None, "E1", True), ("E5", "E5", True)], "left_id string, right_id string, matched boolean")
    got = {x.entity_id: x.group_id for x in components.entity_groups(r, m).collect()}
    assert got == {"E1": "E1", "E2": "E1", "E3": "E3", "E4": "E3"}


# --- p4

def test_languages_with_romanised_and_mixed_texts(spark):
    model = languages.fit([f"{t}\n\n{t}" for t in (EN, FR, BN, ROMAN) for _ in range(40)])
    judge = languages.Judge(model)
    out = judge.documents([EN, f"{EN}\n\n{EN}\n\n{BN}", ROMAN, "", "123 456\n\n!!", f"{BN}\n\n{BN}\n\n{FR}"])
    assert [d[0][1] for d in out] == ["en", "en", "bn", None, None, "bn"]
    assert [x[1] for x in out[1][1:]] == ["en", "en", "bn"] and out[5][3][1] == "fr"
    assert all(0 <= x[2] <= 1 for d in out for x in d)
    df = spark.createDataFrame([(1, EN, "x"), (2, None, "x"), (3, "  ", "x"), (4, "?!", "x"), (5, "\n\n".join([EN] * 300 + [BN]), "x"), (5, EN, "x")], "article_id long, body string, segment string")
    got = languages.identify(df, "article_id", "body").collect()
    assert sorted((r.key if "key" in r else r.article_id, r.segment, r.language) for r in got if r.language) == [(1, 0, "en"), (5, 0, "en"), (5, 0, "en"), (5, 301, "bn")]
    assert languages.identify(df.filter("article_id = 9"), "article_id", "body").count() == 0


def test_held_out_accuracy():
    rng = random.Random(8)
    pools = {"en": EN, "fr": FR, "bn": BN}
    make = lambda c: " ".join(rng.sample(pools[c].split(), 14))
    model = languages.fit([make(c) for c in pools for _ in range(60)])
    judge, right = languages.Judge(model), 0
    test = [(c, make(c)) for c in pools for _ in range(40)]
    for (c, _), d in zip(test, judge.documents([t for _, t in test])):
        right += d[0][1] == c
    assert right >= 0.97 * len(test)


def test_a_language_of_one_article_in_a_large_table_is_found(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.sample(EN.split(), 16))) for i in range(5000)] + [(5000, FR), (5001, f"{EN}\n\n{EN}\n\n{ROMAN}")]
    got = languages.identify(spark.createDataFrame(rows, "article_id long, body string"), "article_id", "body").filter("language <> 'en'").collect()
    assert {(r.article_id, r.segment, r.language) for r in got} == {(5000, 0, "fr"), (5001, 3, "bn")}


def test_words_are_read_whole_and_unspoken_paragraphs_are_less_likely_not_barred():
    model = languages.fit([EN] * 40 + [ROMAN] * 40)
    long = "approved" * 9
    assert len(languages._grams(long)) == 72 and np.ptp(model.vector(long)) > 5  # a word of 72 letters still says something
    assert np.ptp(model.vector("x" * 100_000)) <= languages.LOUDEST + 1e-3
    j = languages.COMPONENTS.index("bn_latn")
    gone = languages.Chunk.of(["porikolpona bereche\n\nkore bereche"]).unspoken()[:, j]
    assert gone[0] == 2 * languages.UNSPOKEN and gone[1] == 0
    spoken = " ".join(w for w in ROMAN.replace(",", "").replace(".", "").split() if w not in languages.BORROWED[j])
    assert languages.Judge(model).documents([spoken])[0][0][1] == "bn"  # no function word, but its words say so


def test_held_out_languages_from_other_sentences():
    """Every language is tested on sentences whose words the training sentences only partly hold."""
    pools = {
        "en": ("the officials said that the bridge will open in spring and the cost was lower than planned|a council of the town approved the plan for a new school after the debate|people from the villages have waited for the road since the flood of last year", "the officials of the school said that the cost will be lower|after the flood a plan for the bridge was approved"),
        "fr": ("les responsables ont dit que le pont sera ouvert au printemps et que le coût est plus bas|le conseil de la ville a approuvé le plan pour une nouvelle école après le débat|les habitants des villages ont attendu la route depuis les pluies de cette année", "le conseil des villages a dit que la route sera ouverte|une école pour les habitants est dans le plan"),
        "es": ("los funcionarios dicen que el puente se abre en la primavera y que el costo es más bajo|el consejo de la ciudad aprobó el plan para una nueva escuela según los vecinos|la gente de los pueblos no ha visto la carretera por las lluvias de este año", "el consejo de los pueblos aprobó la carretera|la gente dice que el plan no es para este año"),
        "de": ("die beamten sagen dass die brücke im frühling öffnet und der preis nicht so hoch ist|der rat der stadt hat den plan für eine neue schule nach der debatte angenommen|die leute aus den dörfern haben auf die straße seit dem regen gewartet", "der rat hat die straße für die leute nicht angenommen|die schule und die brücke sind im plan der stadt"),
        "bn": ("কর্মকর্তারা বলেন এই সেতু বসন্তে খুলে দেওয়া হবে এবং খরচ কম হয়েছে|নগরের পরিষদ নতুন বিদ্যালয়ের পরিকল্পনা অনুমোদন করেছে", "পরিষদ বলেন সেতু এবং বিদ্যালয়ের খরচ কম|এই পরিকল্পনা নগরের জন্য অনুমোদন হয়েছে"),
        "hi": ("अधिकारियों ने कहा कि यह पुल वसंत में खुल जाएगा और खर्च कम है|नगर की परिषद ने नए विद्यालय की योजना को मंजूरी दी", "परिषद ने कहा कि पुल और विद्यालय का खर्च कम है|यह योजना नगर के लिए है"),
    }
    model = languages.fit([x for train, _ in pools.values() for x in train.split("|") for _ in range(10)])
    test = [(c, x) for c, (_, held) in pools.items() for x in held.split("|")]
    assert [d[0][1] for d in languages.Judge(model).documents([x for _, x in test])] == [c for c, _ in test]


# --- p5

LOOKS = [("Résumé", "Résumé"), ("fish office", "ﬁsh oﬃce".replace("ﬃ", "ﬀice"[0] + "i")), ("abc 12", "ａｂｃ　１２"), ("word", "w​o­rd﻿"), ("a b", "a b"), ("কো", "কো")]


@pytest.mark.parametrize(("a", "b"), LOOKS)
def test_same_look_same_form(a, b):
    assert lookalike.plain(a) == lookalike.plain(b)


@pytest.mark.parametrize(("a", "b"), [("x²", "x2"), ("é", "e"), ("A", "a"), ("১", "1"), ("½", "1/2"), ("র‍্য", "র্য")])
def test_different_looks_stay_different(a, b):
    assert lookalike.plain(a) != lookalike.plain(b)


def test_pairs_need_the_vocabulary(spark):
    rows = [(1, "The plan", "said the people"), (2, "Тhe plаn", "said the people"), (3, "The plan", "said the people"), (4, "Мир", "сор"), (5, "Mup", "cop"), (6, None, "x"), (7, " ", "x"), (8, "T", None), (9, "T", "x" * 100_000), (10, "Ｔ", "x" * 100_000)]
    got = {(r.a, r.b) for r in lookalike.same_look_pairs(spark.createDataFrame(rows, "article_id long, title string, body string"), "article_id", ["title", "body"]).collect()}
    assert got == {(1, 2), (2, 3), (9, 10)}
    assert lookalike.same_look_pairs(spark.createDataFrame([], "article_id long, title string, body string"), "article_id", ["title", "body"]).count() == 0


def test_tokens_take_their_dominant_script_in_either_direction():
    assert lookalike.candidates("The plаn") == {"plаn": ["plan"]}  # one Cyrillic letter
    assert lookalike.candidates("наш нaшa правда") == {"нaшa": ["наша"]}  # Latin letters in a Cyrillic word
    assert lookalike.candidates("το φiλο") == {} and lookalike.candidates("νoν και λόγος") == {"νoν": ["vov", "νον"]}
    assert lookalike.candidates("сaсa говорит")["сaсa"] == ["caca", "саса"]  # tied: Latin first
    assert lookalike.candidates("an оссаsіоn")["оссаsіоn"] == ["occasion"]  # only the n has no look-alike
    assert lookalike.candidates("it wаѕ")["wаѕ"] == ["was", "ԝаѕ"]  # undecided: the vocabulary says
    assert lookalike.candidates("it may νа")["νа"][0] == "va"  # Greek and Cyrillic, in a Latin text
    assert lookalike.candidates("мир правда слово") == {} and lookalike.candidates("thе о plan of it")["о"] == ["o"]


def test_cyrillic_words_are_repaired_and_copies_expanded(spark):
    rows = [(1, "Наша правда", "слово наша")] * 1 + [(2, "Нaшa правда", "слово наша"), (3, "Наша правда", "слово наша"), (3, "Наша правда", "слово наша"), (4, "Нaшx", "слово")]
    got = sorted((r.a, r.b) for r in lookalike.same_look_pairs(spark.createDataFrame(rows, "article_id long, title string, body string"), "article_id", ["title", "body"]).distinct().collect())
    assert got == [(1, 2), (2, 3)]


# --- p6

def make_page(rng):
    story = [f"The {rng.choice('slow costly modest'.split())} plan for the {rng.choice(['tea auction', 'night market'])} was {rng.choice('approved delayed'.split())} on Monday." for _ in range(rng.randint(2, 5))]
    if rng.random() < 0.4:
        story.insert(1, rng.choice(["The tea auction", "The night market"]))
    head = rng.sample(["Home | World | Jobs", "Skip to main content", "Advertisement"], rng.randint(0, 2))
    foot = rng.sample(["Back to top", "© 2026 Big Times. All rights reserved.", "We use cookies to give you the best experience.", "Why the plan was delayed again", "12 comments"], rng.randint(0, 4))
    title = "Plan approved" + (" | Big Times" if rng.random() < 0.3 else "")
    lines = head + story + foot
    return title, "\n\n".join(lines), [0] * (title.endswith("Times")) + [2 * i + 1 for i in range(len(lines)) if i < len(head) or i >= len(head) + len(story)], title.endswith("Times")


def test_labeller_on_held_out_pages(spark):
    rng = random.Random(2)
    pages = [make_page(rng) for _ in range(260)]
    model = boilerplate.fit([(t, b) for t, b, _, _ in pages[:200]], ["Big Times"], epochs=6)
    right = total = 0
    for title, body, wrong, _ in pages[200:]:
        texts, numbers = boilerplate.blocks(title, body)
        ids = [boilerplate.hashed(x) for x in texts]
        p = model.score(np.array([i for x in ids for i in x]), np.concatenate([[0], np.cumsum([len(x) for x in ids])]), boilerplate.shapes(texts, numbers), np.array([len(texts)]))
        truth = [n in wrong for n in numbers]
        right += sum((x > 0.5) == y for x, y in zip(p, truth))
        total += len(truth)
    assert right / total >= 0.97


def test_documents_are_grouped_by_padded_lines():
    lengths = np.array([3, 50_000, 7, 1, 19_000, 900, 2])
    groups = list(boilerplate._groups(np.argsort(lengths, kind="stable"), lengths))
    assert sorted(np.concatenate(groups).tolist()) == list(range(7)) and all(len(g) == 1 or len(g) * lengths[g].max() <= boilerplate.CELLS for g in groups)
    assert list(boilerplate._groups(np.array([], int), np.array([], int))) == []


def test_phrases_of_the_labels_are_no_inputs():
    a, b = (boilerplate.shapes(["T", line, "A story ends."], [0, 1, 2]) for line in ("we use cookies here now", "we sell biscuits here now"))
    assert np.array_equal(a, b)


def test_all_words_of_a_line_are_hashed():
    line = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100))
    assert len(boilerplate.hashed(line)) == 100 and boilerplate.hashed(line) != boilerplate.hashed(line + "x")


def test_labeller_edges(spark):
    rows = [(1, None, "A story line that ends here."), (2, "T", None), (3, "T", " \n "), (4, "", "\n\nOne.\n\n\nTwo."), (5, "T | Big", "x " * 40_000 + ".")]
    df = spark.createDataFrame(rows, "article_id long, title string, body string")
    got = boilerplate.label_blocks(df, "article_id", "title", "body", ["Big"]).collect()
    assert sorted((r.article_id, r.line_no) for r in got) == [(1, 0), (1, 1), (4, 0), (4, 3), (4, 6), (5, 0), (5, 1)]
    assert boilerplate.label_blocks(df.filter("article_id = 9"), "article_id", "title", "body", []).count() == 0


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    model = boilerplate.BlockLabeller()
    x, n = rng.normal(size=(4, 2, boilerplate.WORD_SIZE + boilerplate.SHAPES)).astype(np.float32), np.array([4, 2])
    w, keep = rng.normal(size=(4, 2)).astype(np.float32), ([], [])
    w[2:, 1] = 0
    h = boilerplate.HIDDEN_SIZE
    _, _, xr = model._logits(x, n, keep)
    g = {k: np.zeros_like(v) for k, v in model.p.items()}
    dz = w[:, :, None] * model.p["out"]
    model._back("f", x, keep[0], dz[:, :, :h], g)
    model._back("b", xr, keep[1], model._reversed(dz[:, :, h : 2 * h], n), g)
    for name in ("wf", "wb", "biasf"):
        flat, at = model.p[name].reshape(-1), 7
        old, step = flat[at], 1e-2
        flat[at] = old + step
        up = (model._logits(x, n)[0] * w).sum()
        flat[at] = old - step
        down = (model._logits(x, n)[0] * w).sum()
        flat[at] = old
        assert abs((up - down) / (2 * step) - g[name].reshape(-1)[at]) < 2e-2


# --- p7

def test_name_forms():
    assert names.parts("খাকিশা ধেসেনুর গারিমিন") == names.parts("Khakisha Dhesenur Garimin") == names.parts("Garimin, Khakisha Dhesenur") == names.parts("Dr. Khakisha Dhesenur Garimin's")
    assert names.parts("Kosugam & Subhichu Inst. (KSI)") == names.parts("Institute of Kosugam Subhichu") == names.parts("কোসুগাম ও সুভিচু ইনস্টিটিউট")
    assert names.parts("-") is None and names.parts("") is None


@pytest.mark.parametrize(("a", "b", "same"), [("Dariser Ghithapok Kemasan", "D. Ghithapok Kemasan", True), ("Dariser Ghithapok Kemasan", "Dara Ghithapok Kemasn", True), ("Dariser Ghithapok Kemasan", "Dariser Ghikogil Kebupik", False), ("Kosugam Sunoghan Bank", "Kosugam Sunoghan Hospital", False), ("Ripibom Jedobham Lethita", "Ripibomjedobham Lethita", True)])
def test_name_agreement(a, b, same):
    (ka, ta), (kb, tb) = names.parts(a), names.parts(b)
    assert (names.same_name(ka, ta, kb, tb) > 0) is same


def test_linking(spark):
    rows = [("E1", "Dariser Ghithapok Kemasan", None, ["D. Ghithapok Kemasan"]), ("E2", None, "দারিসের ঘিথাপোক কেমাসান", None), ("E3", "Dariser Ghikogil Kebupik", None, []), ("E4", None, None, None), ("E5", None, None, ["", None, "-", "Ghithapok Kemasan, Dariser"]), ("E6", "Dr Dariser Ghitapok Kemasan", None, ["Dariser Ghikogil Kebupik"])]
    df = spark.createDataFrame(rows, "entity_id string, canonical_en string, canonical_bn string, aliases array<string>")
    got = {(r.a, r.b) for r in linking.entity_pairs(df).collect()}
    assert got == {("E1", "E2"), ("E1", "E5"), ("E2", "E5"), ("E1", "E6"), ("E2", "E6"), ("E5", "E6")}
    assert linking.entity_pairs(df.filter("entity_id = 'x'")).count() == 0


def test_sparse_join_finds_all_names_similar_in_two_parts(spark):
    rng = random.Random(6)
    syl = [c + v for c in "bdgkmnprst" for v in "aeio"]
    base = ["".join(rng.choices(syl, k=3)) for _ in range(30)]
    keys = sorted({"|" + " ".join(sorted(rng.sample(base, 2) + [rng.choice(base) + rng.choice("xyz")])) for _ in range(200)})
    df = spark.createDataFrame([(k,) for k in keys], "name string").selectExpr("xxhash64(name) as id", "name")
    idf = linking.rarity(df)
    of = {r.id: r.name for r in df.collect()}
    got = {tuple(sorted((of[r.a], of[r.b]))) for r in linking.candidate_pairs(df, idf, 0.35).collect()}
    vectors = {k: dict(zip(*[x.tolist() for x in linking._unit(k, idf)])) for key in keys for k in linking._open(key)[1]}
    cos = lambda x, y: sum(w * vectors[y].get(f, 0) for f, w in vectors[x].items())
    near = 0
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            for x, y in itertools.combinations(linking._open(a)[1], 2):
                if any(max(cos(x, u) * cos(y, v), cos(x, v) * cos(y, u)) >= 0.41 for u, v in itertools.combinations(linking._open(b)[1], 2)):
                    near += 1
                    assert (a, b) in got
    assert near > 20 and len(got) < len(keys) * (len(keys) - 1) / 4


def test_names_that_share_one_part_do_not_meet(spark):
    names_ = [f"|kemasan {a}{b}{c}" for a in ("bado", "gimu", "teso", "ruki") for b in ("lan", "pir", "dom") for c in ("et", "us", "ak")]
    df = spark.createDataFrame([(n,) for n in names_], "name string").selectExpr("xxhash64(name) as id", "name")
    assert linking.candidate_pairs(df, linking.rarity(df)).count() < len(names_) * (len(names_) - 1) / 2 / 4


def test_tables_that_grow_are_not_broadcast_by_their_files_size(spark):
    # 1.5 MB of stored names become 8 million rows of the index: the driver had no room for their broadcast
    rows = [("E1", "Dariser Ghithapok Kemasan", None, ["D. Ghithapok Kemasan"]), ("E2", "Dariser Ghithapok Kemasn", None, None)]
    records = materialise(spark.createDataFrame(rows, "entity_id string, canonical_en string, canonical_bn string, aliases array<string>"))
    stored = materialise(spark.createDataFrame([("|dariser ghithapok",), ("|darisar ghithapok",)], "name string").selectExpr("xxhash64(name) as id", "name"))
    idf = linking.rarity(stored)
    for df in (linking.candidate_pairs(stored, idf), linking.similar_names(stored, least=0.0), linking.entity_clusters(records), linking.entity_classes(records), linking.entity_pairs(records)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert [(r.a, r.b) for r in linking.entity_pairs(records).collect()] == [("E1", "E2")]


def test_linkage_of_many_rounds_keeps_its_size_estimates(spark):
    # along the chain each pair waits for the next one to have merged
    chain = [(f"n{i:02d}", f"n{i + 1:02d}", 0.5 + i / 100) for i in range(24)]
    merged = linking.average_linkage(spark.createDataFrame(chain, "a string, b string, s double"), 0.15)
    assert merged.select("v").distinct().count() == merged.count() > 20
    assert size_digits(merged) < 1000


def test_top_neighbours_are_optional(spark):
    df = spark.createDataFrame([(f"|ghithapok kemasan{'bdgkl'[i]}",) for i in range(5)], "name string")
    every, top = linking.similar_names(df, least=0.0).collect(), linking.similar_names(df, least=0.0, top=1).collect()
    assert {(r.a, r.b) for r in top} < {(r.a, r.b) for r in every} and {x for r in top for x in (r.a, r.b)} == {x for r in every for x in (r.a, r.b)}


def test_classes_say_what_the_pairs_say(spark):
    rows = [("E1", "Dariser Ghithapok Kemasan", None, []), ("E2", "Dariser Ghithapok Kemasn", None, None), ("E3", "Dariser Kemasan Ghithapok", None, ["D. Ghithapok Kemasan"]), ("E4", "Rokib Subhichu", None, None), ("E5", None, None, None), (None, "Rokib Subhichu", None, None), ("E6", "R. Subhichu", None, None)]
    df = spark.createDataFrame(rows, "entity_id string, canonical_en string, canonical_bn string, aliases array<string>")
    assert {(r.id, r.cluster, r.links) for r in linking.entity_classes(df).collect()} == {("E1", "E1", 2), ("E2", "E1", 2), ("E3", "E1", 2), ("E4", "E4", 1), ("E6", "E4", 1)}
    assert linking.entity_classes(df.filter("entity_id = 'x'")).count() == 0


def test_average_linkage_equals_one_merge_at_a_time(spark):
    rng = random.Random(4)
    pts = [f"n{i:02d}" for i in range(40)]
    sims = {(a, b): round(rng.random(), 6) for i, a in enumerate(pts) for b in pts[i + 1 :] if rng.random() < 0.2}
    groups = {p: {p} for p in pts}
    avg = lambda x, y: sum(sims.get((min(a, b), max(a, b)), 0) for a in groups[x] for b in groups[y]) / (len(groups[x]) * len(groups[y]))
    while True:
        best = max(((avg(x, y), x, y) for x in groups for y in groups if x < y), default=(0, "", ""))
        if best[0] < 0.3:
            break
        groups[best[1]] |= groups.pop(best[2])
    want = {frozenset(g) for g in groups.values() if len(g) > 1}
    got = collections.defaultdict(set)
    for r in linking.average_linkage(spark.createDataFrame([(a, b, s) for (a, b), s in sims.items()], "a string, b string, s double"), 0.3).collect():
        got[r.r].add(r.v)
    assert {frozenset(g) for g in got.values()} == want


def test_tied_names_all_merge_or_it_raises(spark):
    tied = spark.createDataFrame([(f"n{i:02d}", f"n{j:02d}", 0.9) for i in range(40) for j in range(i + 1, 40)], "a string, b string, s double")
    got = linking.average_linkage(tied, max_rounds=25).collect()
    assert len({r.v for r in got}) == 40 and len({r.r for r in got}) == 1
    with pytest.raises(RuntimeError):
        linking.average_linkage(tied, max_rounds=2)


# --- p8, p9

def test_ids_equal_the_public_library_and_round_trip(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    rng = random.Random(1)
    alphabet = [chr(c) for c in [0x1C, 0x85, 0xA0, 0x20, 0x20, 0xA, 9, 0x3000, 0x200B, 0x61, 0x27, 0x73, 0x985, 0x9BF, 0x31, 0xB2, 0x2028, 0x1F600, 0x301]]
    texts = ["", "<|endoftext|> x", EN, BN, "it's  we'll\n\n x", "a" * 5000] + ["".join(rng.choices(alphabet, k=rng.randint(0, 25))) for _ in range(400)]
    df = spark.createDataFrame([*enumerate(texts), (9999, None)], "doc_id long, text string")
    ids = tokens.encode(df, "doc_id", "text")
    got = {r.doc_id: r.ids for r in ids.collect()}
    assert got.pop(9999) == []
    assert [got[i] for i in range(len(texts))] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    back = {r.doc_id: r.text for r in tokens.decode(ids, "doc_id", "ids").collect()}
    assert [back[i] for i in range(len(texts))] == texts


def test_long_pieces_are_not_kept():
    bpe = tokens.ByteBpe(tokens.default_vocabulary())
    assert bpe.decode(bpe.encode("ab" * 5000 + " ok")) == "ab" * 5000 + " ok" and max(map(len, bpe.chunk)) <= tokens.MEMO_CHARACTERS


def test_packing_splits_only_what_is_too_long(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, None, 2048, 2049, 5000, 100_001] + [rng.randint(1, 900)] * 30)) for i in range(500)] + [(7, 10), (7, 10)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n int"), "doc_id", "n").toPandas()
    assert got["n_tokens"].sum() == sum(n or 0 for _, n in rows)
    used = got[got.container.notna()].groupby("container").agg(n=("n_tokens", "sum"), c=("capacity", "first"))
    assert (used.n <= used.c).all() and set(used.c) <= {256, 512, 768, 1024, 1536, 2048}
    assert used.n.sum() / used.c.sum() > 0.99
    split = got[got.doc_id.isin([d for d, n in rows if n and n <= 2048 and d != 7])]
    assert not split.duplicated("doc_id").any()
    assert packing.pack(spark.createDataFrame([], "doc_id long, n int"), "doc_id", "n").count() == 0


def test_best_fit_downsizes():
    where, caps, fill, _ = packing.best_fit([2000, 40, 300, 0], [256, 512, 2048])
    assert where[3] == -1 and sorted(zip(caps, fill)) == [(512, 300), (2048, 2040)]


CAPACITIES = [256, 512, 768, 1024, 1536, 2048]


@pytest.mark.parametrize(("sizes", "opened"), [([1500] * 40, {1536: 40}), ([760] * 40, {1536: 20}), ([1100] * 10 + [940] * 10, {2048: 10}), ([1500] * 10 + [548] * 4, {2048: 4, 1536: 6}), ([250] * 8, {2048: 1}), ([700], {768: 1})])
def test_capacities_are_opened_for_what_is_still_to_come(sizes, opened):
    _, caps, fill, got = packing.best_fit(sizes, CAPACITIES)
    assert collections.Counter(got) == opened
    assert all(f <= c <= g for c, f, g in zip(caps, fill, got))


def test_joint_choice_leaves_less_room_than_one_capacity():
    rng = random.Random(9)
    sizes = [rng.choice([rng.randint(1300, 1536), rng.randint(600, 768)]) for _ in range(3000)]
    room = lambda capacities: (lambda out: sum(out[1]) - sum(out[2]))(packing.best_fit(sizes, capacities))
    everything = packing.best_fit(sizes, CAPACITIES)
    assert room(CAPACITIES) < 0.6 * (sum(2048 for _ in packing.best_fit(sizes, [2048])[1]) - sum(sizes))
    assert len(set(everything[3])) >= 2


# --- p10

RESIDUE = ["{{ title }} {{body}}", "Error 404\n\nTry again later.", "Please enable JavaScript to view this page.", "A headline here\n\nLorem ipsum dolor sit amet. Sed do eiusmod tempor ut labore et dolore.", "<p>${author} | Updated [date]</p>", "এই পাতা দেখতে জাভাস্ক্রিপ্ট চালু করুন।"]
NEWS = [EN, 'Visitors saw the message "404 Not Found" for 79 hours.', "The portal answered with error 503 because 811,366 people applied at once.", "Printers use lorem ipsum to test a page, an expert explained at the fair.", "The teacher showed pupils how a line such as {{name}} is replaced by a real name.", EN * 60 + " Please enable JavaScript to view this page."]


def test_residue_and_mentions(spark):
    rows = [(i, t, "s") for i, t in enumerate(RESIDUE + NEWS)] + [(100, None, "s"), (101, " \n", None), (102, "x" * 200_000, None), (0, RESIDUE[0], "t")]
    got = {r.doc_id: r.is_residue for r in residue.residue_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source").collect()}
    assert got == {**{i: True for i in range(len(RESIDUE))}, **{len(RESIDUE) + i: False for i in range(len(NEWS))}, 102: False}


def test_unknown_messages_are_learned_from_their_company(spark):
    rows = [(i, f"Zork unavailable, sorry.\nError 50{i}", f"s{i % 3}") for i in range(4)] + [(10, "Zork unavailable, sorry.", "s9")] + [(20 + i, f"It rained in town {i}.\nIt rained again.", f"s{i}") for i in range(4)]
    got = {r.doc_id: r.is_residue for r in residue.residue_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source").collect()}
    assert got[10] and not any(got[20 + i] for i in range(4))
    assert residue.residue_documents(spark.createDataFrame([], "doc_id long, text string, source string"), "doc_id", "text", "source").count() == 0


def test_long_messages_are_learned_too(spark):
    long = "Zork unavailable, sorry, " + " ".join(f"zork{chr(97 + i)}" for i in range(26)) + "."
    rows = [(i, f"{long}\nError 50{i}", f"s{i % 3}") for i in range(4)] + [(10, long, "s9")]
    got = {r.doc_id: r.is_residue for r in residue.residue_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source").collect()}
    assert got[10]


def test_recurring_messages_come_first_and_rules_alone_are_told_apart(spark):
    rows = [(i, f"Page not found. Request 4{i}a7c9e{i}1 on {i + 1} October 2025.", f"s{i % 3}") for i in range(4)] + [(10, "Access denied for this one reader.", "s1")] + [(20 + i, f"{{{{ field_{i} }}}}", f"s{i}") for i in range(3)] + [(30, EN, "s1")]
    got = {r.doc_id: (r.is_residue, r.path) for r in residue.residue_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source").collect()}
    assert got == {**{i: (True, "recurring") for i in (0, 1, 2, 3, 20, 21, 22)}, 10: (True, "rules"), 30: (False, None)}


def test_placeholders_and_tags_of_any_length(spark):
    long = "x" * 500
    for text in (f"{{{{ {long} }}}}", f"${{{long}}}", f"<% {long} %>", f"<!-- {long} -->", f"*|{long}|*", f"%{long}%", f"[[ {long} ]]"):
        assert residue.judge(residue.units_of(text)[0])[2] == 1, text
    assert residue.units_of(f'<p class="{long}">one</p>') == ["one"]
    assert residue.shape_of("posted # october # by {{ a }}") == residue.shape_of("posted october #, # by {{ bb }}") == "posted # by {}"
