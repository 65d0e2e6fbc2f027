import datetime
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondhan.operators.timestamps import COMPONENTS, DMY, JUNK, MDY, mixture, normalise_timestamps

UTC = datetime.timezone.utc


def us(*parts, micro=0):
    return int(datetime.datetime(*parts, tzinfo=UTC).timestamp()) * 1_000_000 + micro


CASES = [
    ("2025-10-03", "dhaka", us(2025, 10, 2, 18)), ("03/10/2025", "dhaka", us(2025, 10, 2, 18)), ("10/03/2025", "york", us(2025, 10, 3, 4)), ("2025-10-03T01:33:41.564322387Z", "york", us(2025, 10, 3, 1, 33, 41, micro=564322)),
    ("1759403584308", "dhaka", 1759403584308000), ("1759403584", "dhaka", 1759403584000000), ("1 Jan 2026 23:45:14 BST", "dhaka", us(2026, 1, 1, 17, 45, 14)), ("1 Jul 2025 12:00:00 BST", "london", us(2025, 7, 1, 11)),
    ("Thu, 02 Oct 2025 22:13:12 GMT", "dhaka", us(2025, 10, 2, 22, 13, 12)), ("Saturday, October 4, 2025 at 7:04 a.m. UTC+6", "york", us(2025, 10, 4, 1, 4)), ("প্রকাশ: ৪ অক্টোবর ২০২৫, ১০:০৭", "dhaka", us(2025, 10, 4, 4, 7)),
    ("3. Oktober 2025, 07:44 Uhr", "berlin", us(2025, 10, 3, 5, 44)), ("12 de octubre de 2025, 05:27", "berlin", us(2025, 10, 12, 3, 27)), ("4 octobre 2025 à 1h36", "berlin", us(2025, 10, 3, 23, 36)), (" 2025-11-04T00:35:24 ", "dhaka", us(2025, 11, 3, 18, 35, 24)),
    ("20251001T050106Z", "dhaka", us(2025, 10, 1, 5, 1, 6)), ("Oct 2, 2025, 12:04 AM", "dhaka", us(2025, 10, 1, 18, 4)), ("2026-01-10 07:16 +06:00", "york", us(2026, 1, 10, 1, 16)), ("5 Oct 2025 06:55 GMT+5:45", "york", us(2025, 10, 5, 1, 10)),
]
NONE = [
    (None, "dhaka", "blank"), ("", "dhaka", "blank"), ("  ", "dhaka", "blank"), ("2 hours ago", "dhaka", "unreadable"), ("32 January 2026", "dhaka", "impossible"), ("31/02/2026", "dhaka", "impossible"), ("0000-00-00 00:00:00", "dhaka", "impossible"),
    ("27/12/2025", "york", "impossible"), ("2026-03-29 01:25:29", "london", "skipped"), ("2025-10-26 01:43:19", "london", "repeated"), ("2025-11-02T01:21:44", "york", "repeated"), ("10:15", "dhaka", "unreadable"), ("2025-10-03 10:00", "nowhere", "unknown_zone"),
    ("2025-10-03 25:00", "dhaka", "impossible"), ("x" * 50_000, "dhaka", "unreadable"),
]


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([("dhaka", "Asia/Dhaka", "dmy"), ("york", "America/New_York", "mdy"), ("london", "Europe/London", "dmy"), ("berlin", "Europe/Berlin", "dmy"), ("free", "UTC", None)], "source string, home_zone string, date_order string")


def test_instants_and_reasons(spark, sources):
    rows = [(i, d, s) for i, (d, s, _) in enumerate(CASES + NONE)]
    got = {r.id: r for r in normalise_timestamps(spark.createDataFrame(rows, "id int, date string, source string"), "date", "source", sources).collect()}
    for i, (d, s, want) in enumerate(CASES):
        assert (got[i].utc_us, got[i].status) == (want, "resolved"), (d, s, got[i])
    for i, (d, s, why) in enumerate(NONE):
        r = got[len(CASES) + i]
        assert r.utc_us is None and r.status == why, (d, r)


def test_em_settles_an_undeclared_order_and_marks_what_it_cannot(spark, sources):
    settled = [(i, f"{i % 12 + 1}/{i % 15 + 13}/2025", "free") for i in range(40)] + [(99, "03/04/2025", "free")]
    got = normalise_timestamps(spark.createDataFrame(settled, "id int, date string, source string"), "date", "source", sources).filter("id = 99").first()
    assert got.utc_us == us(2025, 3, 4) and got.order_posterior > 0.9
    open_case = spark.createDataFrame([(1, "03/04/2025", "free"), (2, "05/05/2025", "free")], "id int, date string, source string")
    got = {r.id: r for r in normalise_timestamps(open_case, "date", "source", sources).collect()}
    assert got[1].status == "ambiguous_order" and got[2].utc_us == us(2025, 5, 5)


def test_empty_repeats_and_clashing_columns(spark, sources):
    empty = spark.createDataFrame([], "id int, date string, source string, status string")
    assert normalise_timestamps(empty, "date", "source", sources).count() == 0
    twice = spark.createDataFrame([(1, "2025-01-01", "dhaka", "old", 5, "z")] * 2, "id int, date string, source string, status string, utc_us int, home_zone string")
    got = normalise_timestamps(twice, "date", "source", sources).collect()
    assert [r.status for r in got] == ["resolved"] * 2 and got[0].home_zone == "z"


def test_mixture_learns_notations_and_orders():
    both, only_dmy, iso = 1 << DMY | 1 << MDY | 1 << JUNK, 1 << DMY | 1 << JUNK, 1 << COMPONENTS.index("iso") | 1 << JUNK
    w = mixture(np.array([both, only_dmy, iso]), np.array([50.0, 40, 30]), None)
    assert w[DMY] > 20 * w[MDY] and 0.2 < w[COMPONENTS.index("iso")] < 0.3
    # a declared order is a finite prior: no number of impossible values turns it, and they fall to junk
    w = mixture(np.array([both, only_dmy]), np.array([50.0, 40]), "mdy")
    assert w[MDY] / (w[MDY] + w[DMY]) > 0.999 and 0 < w[DMY] < w[JUNK] < 1e-12 * w[MDY]
    assert mixture(np.array([both, only_dmy]), np.array([5e14, 4e14]), "mdy")[DMY] < mixture(np.array([both]), np.array([1e15]), "mdy")[JUNK]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data here")
def test_orders_are_found_without_their_declaration(spark):
    """With date_order hidden, of the values in figures at least 99 in 100 get the instant they get with it."""
    d = "/root/testdata/sf0.01"
    articles, known = spark.read.parquet(f"{d}/articles.parquet").select("article_id", "date", "source"), spark.read.parquet(f"{d}/sources.parquet")
    told = normalise_timestamps(articles, "date", "source", known).filter("format = 'figures' and utc_us is not null")
    hidden = normalise_timestamps(articles, "date", "source", known.withColumn("date_order", F.lit(None).cast("string"))).select("article_id", F.col("utc_us").alias("blind"), F.col("status").alias("why"))
    rows = told.join(hidden, "article_id").collect()
    wrong = [r for r in rows if r.blind is not None and r.blind != r.utc_us]
    assert len(rows) > 50 and len(wrong) <= 0.01 * len(rows) and all(r.why == "ambiguous_order" for r in rows if r.blind is None)
