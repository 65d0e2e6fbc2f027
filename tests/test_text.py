"""Column builders against plain Python models."""

import random

from pyspark.sql import functions as F

from sondhan.functions import text as T
from sondhan.operators.fuzzy import lcs_ratio, token_set_ratio

TEXTS = [None, "", "   ", "a", "Hello  world\tfoo", "ঢাকায় আজ বৃষ্টি", "a b c", "x" * 5000, "İstanbul ǅ ſ", "one two three two one two"]


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("t"))).collect()]


def test_tokens_equal_python_split(spark):
    assert column(spark, TEXTS, T.tokens) == [(t or "").lower().split() for t in TEXTS]


def test_token_count(spark):
    assert column(spark, TEXTS, T.token_count) == [len((t or "").split()) for t in TEXTS]


def test_shingles(spark):
    got = column(spark, ["", None, "a", "a b", "A b, c d", "a b c a b c"], lambda c: T.shingles(c, 3))
    assert got == [[], [], ["a"], ["a b"], ["a b c", "b c d"], ["a b c", "b c a", "c a b"]]


def test_marks_are_stripped_like_the_specified_class(spark):
    assert column(spark, ["আমির খান"], lambda c: T.shingles(c, 2)) == [["আমর খন"]]


def test_trigrams(spark):
    assert column(spark, ["ab", "abc", "Abcd", "ঢাকা"], T.trigrams) == [["ab"], ["abc"], ["abc", "bcd"], ["ঢাক", "াকা"]]


def test_indel_ratio_twins_agree(spark):
    rng = random.Random(3)
    pairs = [("sakib", "shakib"), ("dhakar", "dhaka"), ("ঢাকায়", "ঢাকা"), ("", "a"), ("abc", "abc")] + [("".join(rng.choices("abc", k=rng.randint(1, 9))), "".join(rng.choices("abc", k=rng.randint(1, 9)))) for _ in range(40)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [r[0] for r in rows.orderBy("i").select(T.indel_ratio(F.col("a"), F.col("b"))).collect()]

    def model(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return 200 * t[-1][-1] / (len(a) + len(b)) if a and b else 0.0

    for (a, b), g in zip(pairs, got):
        assert abs(g - model(a, b)) < 1e-9 and abs(lcs_ratio(a, b) - model(a, b)) < 1e-9
    assert round(lcs_ratio("sakib", "shakib"), 2) == 90.91 and round(lcs_ratio("ঢাকায়", "ঢাকা"), 1) == 80.0


def test_token_set_ratio():
    assert token_set_ratio("dhaka city news", "news dhaka") == 100
    assert token_set_ratio("", "x") == 0


def test_languages(spark):
    values = ["Bangladesh politics", "বাংলাদেশের রাজনীতি", "hello world", "নমস্কার বিশ্ব", "", None, "  "]
    assert column(spark, values, T.detect_lang) == ["en", "bn", "en", "bn", "unknown", "unknown", "unknown"]
    assert column(spark, ["Bangladesh এবং ভারত", "বাংলাদেশ", "Bangladesh", "আমি go করব", None], T.is_mixed) == [True, False, False, True, False]
