import datetime

from pyspark.sql import functions as F

from sondhan.operators import cleaning, dedup


def one(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("t"))).collect()]


def test_date_spellings(spark):
    values = ["2025-01-02", "2025-1-2T03:04:05+06:00", "02-01-2025", "2/1/2025", "January 2, 2025", "JAN 2, 2025", "2025/01/02", "2025-02-29", "31/02/2025", "soon", "", None, " 2025-01-02 "]
    assert one(spark, values, cleaning.normalize_date) == ["2025-01-02"] * 7 + [None] * 5 + ["2025-01-02"]


def test_source_rules_span_lines_and_common_ones_do_not(spark):
    rows = spark.createDataFrame([("x © The New Nation\nmore", "new_nation"), ("a\nAlso Read: b\nc", "any"), (None, None), ("© প্রথম আলো rest", "prothom_alo")], "t string, s string")
    got = [r[0] for r in rows.select(cleaning.clean_text(F.col("t"), F.col("s"))).collect()]
    assert got == ["x", "a\n\nc", "", ""]


def test_titles(spark):
    assert one(spark, ["  BREAKING: a  b ", "Breaking news", None, ""], cleaning.clean_title) == ["a b", "Breaking news", "", ""]


def test_reject_reasons_add_up(spark):
    long = "w " * 60
    rows = spark.createDataFrame([(None, "t", long), ("u", "", long), ("u", "t", ""), ("u", "t", "short"), ("u", "t", long)], "u string, t string, b string")
    got = [r[0] for r in rows.select(cleaning.reject_reason(F.col("u"), F.col("t"), F.col("b"))).collect()]
    assert got == ["no_url", "empty", "empty", "short", None]


def test_url_order_of_steps(spark):
    assert one(spark, ["HTTPS://www.A.com/x/", "http://a.com/x/?q=1", "a.com", None], dedup.normalize_url) == ["a.com/x", "a.com/x/", "a.com", ""]


def test_most_recent_address_wins(spark):
    rows = spark.createDataFrame([(1, "http://a.com/x", "2025-01-01T00:00:00"), (2, "https://www.a.com/x/", "2025-01-02T00:00:00"), (3, "a.com/x", "bad"), (4, "", "2025-01-01T00:00:00"), (5, None, None), (6, "b.com", None), (7, "b.com", None)], "id long, url string, at string")
    got = {r.nurl: r.id for r in dedup.dedup_url(rows, "url", "at", "id").collect()}
    assert got == {"a.com/x": 2, "b.com": 6}


def test_duplicate_loser(spark):
    d1, d2 = datetime.datetime(2025, 1, 1), datetime.datetime(2025, 1, 2)
    rows = spark.createDataFrame([(0, d1, d2, 1, 1), (1, d2, d2, 1, 1), (2, d1, None, 1, 9), (3, None, d1, 9, 1), (4, None, None, 1, 2), (5, None, None, 2, 2)], "i int, x timestamp, y timestamp, m int, n int")
    got = [r[0] for r in rows.orderBy("i").select(dedup.duplicate_loser(F.col("x"), F.col("y"), F.col("m"), F.col("n"), F.lit("a"), F.lit("b"))).collect()]
    assert got == ["a", "b", "b", "a", "a", "b"]
