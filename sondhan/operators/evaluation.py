"""Retrieval metrics over (query, item, rank) runs and (query, item) relevance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The targets of the evaluation runner.
TARGETS = {"precision_at_10": 0.6, "recall_at_50": 0.5, "ndcg_at_10": 0.5, "mrr": 0.4}


def judged(run: DataFrame, relevant: DataFrame, query: str = "query_id", item: str = "doc_id") -> DataFrame:
    """The run with rel 1 or 0."""
    good = relevant.select(query, item).distinct().withColumn("rel", F.lit(1))
    return run.join(good, [query, item], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def metrics(run: DataFrame, relevant: DataFrame, query: str = "query_id", item: str = "doc_id", k: int = 10, deep: int = 50) -> DataFrame:
    """One row a query of the run: precision at k over k, recall at ``deep`` (0 without relevant items), nDCG at k, reciprocal rank."""
    rows = judged(run, relevant, query, item)
    size = relevant.select(query, item).distinct().groupBy(query).agg(F.count(F.lit(1)).alias("n_rel"))
    gain = F.col("rel") / F.log2(F.col("rank") + 1)
    per = rows.groupBy(query).agg(
        F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)).alias("hits_k"), F.sum(F.when(F.col("rank") <= deep, F.col("rel")).otherwise(0)).alias("hits_deep"),
        F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias("dcg"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first_rank"),
    ).join(size, query, "left").withColumn("n_rel", F.coalesce("n_rel", F.lit(0)).cast("long"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("n_rel").cast("int")))), F.lit(0.0), lambda a, i: a + F.lit(1.0) / F.log2(i + 1))
    return per.select(
        query, F.round(F.col("hits_k") / F.lit(float(k)), 6).alias(f"precision_at_{k}"),
        F.round(F.coalesce(F.try_divide(F.col("hits_deep").cast("double"), F.col("n_rel").cast("double")), F.lit(0.0)), 6).alias(f"recall_at_{deep}"),
        F.round(F.when(F.col("n_rel") > 0, F.col("dcg") / ideal).otherwise(0.0), 6).alias(f"ndcg_at_{k}"), F.round(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)), 6).alias("mrr"),
    )


def prf_at_ks(run: DataFrame, relevant: DataFrame, ks: list[int], query: str = "query_id", item: str = "doc_id") -> DataFrame:
    """Precision, recall and F1 of each query at several depths."""
    rows = judged(run, relevant, query, item).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    size = relevant.select(query, item).distinct().groupBy(query).agg(F.count(F.lit(1)).alias("n_rel"))
    hits = rows.groupBy(query, "k").agg(F.sum(F.when(F.col("rank") <= F.col("k"), F.col("rel")).otherwise(0)).cast("double").alias("hits")).join(size, query, "left")
    p, r = F.col("hits") / F.col("k"), F.coalesce(F.try_divide(F.col("hits"), F.col("n_rel").cast("double")), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return hits.select(query, F.col("k").cast("long").alias("k"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"))


def confusion(run: DataFrame, relevant: DataFrame, corpus_size: DataFrame, k: int = 10, query: str = "query_id", item: str = "doc_id") -> DataFrame:
    """TP, FP, FN, TN of each query at k with precision, recall, F1 and accuracy; the corpus is as large as it is."""
    got = run.filter(F.col("rank") <= k).select(query, item).withColumn("got", F.lit(1))
    good = relevant.select(query, item).distinct().withColumn("rel", F.lit(1))
    both = got.join(good, [query, item], "full_outer")
    c = both.groupBy(query).agg(
        F.count_if(F.expr("got = 1 and rel = 1")).alias("tp"), F.count_if(F.expr("got = 1 and rel is null")).alias("fp"), F.count_if(F.expr("got is null and rel = 1")).alias("fn"),
    ).crossJoin(F.broadcast(corpus_size.select(F.col("n"))))
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("fn"), F.col("n") - F.col("tp") - F.col("fp") - F.col("fn")
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return c.select(query, "tp", "fp", "fn", tn.alias("tn"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"), F.round(ratio(tp + tn, F.col("n")), 6).alias("accuracy"))


def judge_keywords(docs: DataFrame, rules: DataFrame, query: str = "query") -> DataFrame:
    """(query, doc_id, grade): 2 if a strong keyword is in the lower-case title or body, else 1 for a weak one, else 0.

    ``docs``: (query, doc_id, title, body); ``rules``: (query, strong array, weak array).  Queries match rules as written.
    """
    hay = F.concat_ws("\n", F.lower("title"), F.lower("body"))
    joined = docs.join(rules, query, "left").withColumn("hay", hay)
    has = lambda c: F.coalesce(F.exists(c, lambda k: F.contains(F.col("hay"), k)), F.lit(False))
    return joined.select(query, "doc_id", F.when(has("strong"), 2).when(has("weak"), 1).otherwise(0).cast("long").alias("grade"))
