"""Corpus statistics as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_stats(df: DataFrame, language: str = "language", source: str = "source", tokens: str = "tokens", date: str = "date") -> DataFrame:
    """Counts, token sums and string date range by language, by source, by both, and over all, in one pass."""
    rows = df.select(F.col(language).alias("language"), F.col(source).alias("source"), F.col(tokens).cast("long").alias("tokens"), F.nullif(F.col(date), F.lit("")).alias("date"))
    sets = rows.groupingSets([["language"], ["source"], ["language", "source"], []], "language", "source")
    return sets.agg(
        F.grouping_id("language", "source").cast("long").alias("grouping"), F.count(F.lit(1)).alias("articles"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens_sum"),
        F.min("tokens").alias("tokens_min"), F.max("tokens").alias("tokens_max"), F.round(F.avg("tokens"), 6).alias("tokens_avg"), F.min("date").alias("date_min"), F.max("date").alias("date_max"),
    )


def count_with_sample(df: DataFrame, group: str, sample: str, seq: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min_by(sample, seq).alias("sample"))
