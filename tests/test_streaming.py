"""Streams give what the batch gives."""

import datetime

from pyspark.sql import functions as F

from sondhan.streaming import ingest


def run(stream, spark, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_event_counts_equal_the_batch(spark, tmp_path):
    at = datetime.datetime(2026, 1, 1)
    rows = [(at + datetime.timedelta(minutes=7 * i), "click" if i % 3 else "view", float(i)) for i in range(60)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").repartition(1).write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    got = run(ingest.event_counts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), spark, "event_counts", "complete")
    want = spark.read.parquet(f"{tmp_path}/in").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select("w.start", "event_type", "n", "value")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_bounded_ingest_keeps_one_valid_article_an_address(spark, tmp_path):
    body = " ".join(["word"] * 80)
    rows = [("http://a/1", "T", body, "2026-01-01T00:00:00"), ("https://www.a/1/", "T", body, "2026-01-01T01:00:00"), ("http://a/2", "T", "short", "2026-01-01T02:00:00"), ("http://a/3", "T", body, "2026-01-02T02:00:00"), ("", "T", body, "2026-01-01T00:00:00")]
    df = spark.createDataFrame(rows, "url string, title string, body string, crawled_at string").withColumn("date", F.lit(None).cast("string")).withColumn("source", F.lit("x")).withColumn("tokens", F.lit(None).cast("int"))
    df.repartition(1).write.json(f"{tmp_path}/in")
    got = run(ingest.ingest_bounded(spark.readStream.schema(df.schema).json(f"{tmp_path}/in"), "crawled_at"), spark, "bounded")
    assert sorted(r.nurl for r in got.collect()) == ["a/1", "a/3"]
