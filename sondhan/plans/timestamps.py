"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondhan.operators.timestamps import normalise_timestamps
from sondhan.session import table


def p1_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article with its instant, or the reason it has none."""
    articles = table(spark, sf_dir, "articles").select("article_id", "date", "source")
    return normalise_timestamps(articles, "date", "source", table(spark, sf_dir, "sources")).select("article_id", "utc_us", "status", "format", "order_posterior")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles whose date names exactly one instant."""
    return p1_instants(spark, sf_dir).filter(F.col("utc_us").isNotNull()).select("article_id", "utc_us")


QUERIES = {"p1_found": p1_found, "p1_instants": p1_instants}
