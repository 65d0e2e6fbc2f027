"""Combining rankers: normalisation, weighted fusion, merging, comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondhan.operators.lexical import top_k

DEFAULT_WEIGHTS = {"bm25": 0.2, "semantic": 0.6, "fuzzy": 0.2}
# Named weight presets (bm25, fuzzy, semantic).
PRESETS = {"balanced": (0.33, 0.33, 0.34), "semantic_heavy": (0.2, 0.2, 0.6), "lexical_heavy": (0.5, 0.3, 0.2), "fuzzy_heavy": (0.3, 0.4, 0.3)}


def normalize_weights(weights: dict[str, float]) -> dict[str, float]:
    """Divided by their sum if that is off 1 by more than a thousandth."""
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()} if abs(total - 1) > 0.001 else dict(weights)


def _joined(df: DataFrame, stats: DataFrame, group: str) -> DataFrame:
    return df.join(stats.withColumnRenamed(group, "__g"), F.col(group).eqNullSafe(F.col("__g")), "left").drop("__g")


def minmax(df: DataFrame, group: str, score: str, out: str) -> DataFrame:
    """(s - min) / (max - min) within each group, 1 if all are equal, null stays null.

    The bounds come from an aggregate with map-side combine, joined back, so a group
    may hold any share of the rows.
    """
    stats = df.groupBy(group).agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    value = F.when(F.col("__hi") == F.col("__lo"), F.col(score) * 0 + 1.0).otherwise((F.col(score) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))
    return _joined(df, stats, group).withColumn(out, value).drop("__lo", "__hi")


def maxnorm(df: DataFrame, group: str, score: str, out: str) -> DataFrame:
    """s / max within each group, 0 if the maximum is 0 or null."""
    stats = df.groupBy(group).agg(F.max(score).alias("__hi"))
    return _joined(df, stats, group).withColumn(out, F.coalesce(F.try_divide(F.coalesce(F.col(score), F.lit(0.0)), F.col("__hi")), F.lit(0.0))).drop("__hi")


def weighted(cols: dict[str, Column], weights: dict[str, float]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(w) * F.coalesce(cols[k], F.lit(0.0)) for k, w in normalize_weights(weights).items()])


def union_scores(parts: dict[str, DataFrame], query: str = "query_id", item: str = "doc_id") -> DataFrame:
    """(query, item, one column a ranker): the full outer union of scores in one aggregate instead of chained outer joins."""
    rows = [df.select(query, item, *[(F.col("score") if k == name else F.lit(None).cast("double")).alias(k) for k in parts]) for name, df in parts.items()]
    return reduce(DataFrame.unionByName, rows).groupBy(query, item).agg(*[F.max(k).alias(k) for k in parts])


def hybrid(scores: DataFrame, group: str, item: str, weights: dict[str, float] | None = None, k: int = 10, threshold: float = 0.2) -> DataFrame:
    """Top k of weighted min-max BM25 and fuzzy scores and the raw semantic score, with its parts and a low-confidence flag."""
    w = weights or DEFAULT_WEIGHTS
    out = minmax(minmax(scores, group, "bm25", "bm25_n"), group, "fuzzy", "fuzzy_n")
    out = out.withColumn("score", F.round(weighted({"bm25": F.col("bm25_n"), "semantic": F.col("semantic"), "fuzzy": F.col("fuzzy_n")}, w), 6))
    ranked = top_k(out.select(group, item, "score", F.round(F.coalesce("bm25_n", F.lit(0.0)), 6).alias("bm25"), F.round(F.coalesce("fuzzy_n", F.lit(0.0)), 6).alias("fuzzy"), F.round(F.coalesce("semantic", F.lit(0.0)), 6).alias("semantic")), k, group, item)
    return ranked.withColumn("low_confidence", F.max("score").over(Window.partitionBy(group)) < threshold)


def hybrid_maxnorm(scores: DataFrame, group: str, item: str, weights: dict[str, float] | None = None, k: int = 10) -> DataFrame:
    """The batch formula: each score over its maximum, weights .2 / .1 / .7, times 100."""
    w = weights or {"bm25": 0.2, "fuzzy": 0.1, "semantic": 0.7}
    out = scores
    for name in ("bm25", "fuzzy", "semantic"):
        out = maxnorm(out, group, name, f"{name}_n")
    out = out.withColumn("score", F.round(100 * weighted({n: F.col(f"{n}_n") for n in w}, w), 6))
    return top_k(out.select(group, item, "score"), k, group, item)


def low_confidence(ranked: DataFrame, group: str, score: str = "score", threshold: float = 0.2) -> DataFrame:
    top = ranked.groupBy(group).agg(F.max(score).alias("top_score"))
    return top.withColumn("low_confidence", F.col("top_score") < threshold)


def merge_ranked(left: DataFrame, right: DataFrame, k: int = 10, group: str = "query_id", item: str = "doc_id", side: str = "lang") -> DataFrame:
    """Two ranked lists as one: by score, ties to the left list, then by their own ranks."""
    both = left.withColumn("first", F.lit(0)).unionByName(right.withColumn("first", F.lit(1)))
    w = Window.partitionBy(group).orderBy(F.desc("score"), "first", "rank")
    return both.withColumn("new_rank", F.row_number().over(w).cast("long")).filter(F.col("new_rank") <= k).drop("first", "rank").withColumnRenamed("new_rank", "rank")


def topk_overlap(a: DataFrame, b: DataFrame, k: int = 5, group: str = "query_id", item: str = "doc_id") -> DataFrame:
    x, y = a.filter(F.col("rank") <= k).select(group, item), b.filter(F.col("rank") <= k).select(group, item)
    both = x.join(y, [group, item]).groupBy(group).agg(F.count(F.lit(1)).alias("common"))
    return x.select(group).union(y.select(group)).distinct().join(both, group, "left").select(group, F.coalesce("common", F.lit(0)).cast("long").alias("common"))
