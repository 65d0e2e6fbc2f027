"""Queries of the training-data problems; ``__spark_entry__`` adds them if this package can be imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondhan.llm import boilerplate, components, languages, linking, lookalike, packing, ranking, residue, tokens
from sondhan.session import table


def p2_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article of every search with its place in the combined ranking."""
    return ranking.ideal_point_ranking(table(spark, sf_dir, "hybrid_results_labse"), "search_id", "article_id", ["bm25", "fuzzy", "semantic"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten leading articles of each search."""
    hits = table(spark, sf_dir, "hybrid_results_labse")
    return ranking.ideal_point_ranking(hits, "search_id", "article_id", ["bm25", "fuzzy", "semantic"], k=10).select("search_id", "article_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of a group of two or more with the group's smallest id."""
    return components.entity_groups(table(spark, sf_dir, "entity_records"), table(spark, sf_dir, "entity_matches"))


def p4_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main language of every article, and every paragraph in another one, with confidence."""
    return languages.identify(table(spark, sf_dir, "articles"), "article_id", "body")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles whose label is not the code of their main language, and paragraphs in other languages."""
    articles = table(spark, sf_dir, "articles")
    labels = articles.select("article_id", F.col("language").alias("label"))
    found = languages.identify(articles, "article_id", "body").filter("language is not null").join(labels, "article_id")
    return found.filter((F.col("segment") > 0) | ~F.col("label").eqNullSafe(F.col("language"))).select("article_id", "segment", "language")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of articles that look the same in title and body but differ in characters."""
    pairs = lookalike.same_look_pairs(table(spark, sf_dir, "articles"), "article_id", ["title", "body"])
    return pairs.select(F.col("a").alias("article_id_a"), F.col("b").alias("article_id_b"))


def p6_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability that it is page furniture, for every line and title."""
    names = [r[0] for r in table(spark, sf_dir, "sources").select("site_name").distinct().orderBy("site_name").collect()]
    return boilerplate.label_blocks(table(spark, sf_dir, "articles"), "article_id", "title", "body", names)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are no part of the story, and titles that hold more than the headline."""
    return p6_blocks(spark, sf_dir).filter("furniture > 0.5").select("article_id", "line_no")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records that stand for the same person, organisation or place."""
    pairs = linking.entity_pairs(table(spark, sf_dir, "entity_records"))
    return pairs.select(F.col("a").alias("entity_id_a"), F.col("b").alias("entity_id_b"))


def p7_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with a name: its cluster and how many other records the cluster holds."""
    return linking.entity_classes(table(spark, sf_dir, "entity_records")).select(F.col("id").alias("entity_id"), "cluster", "links")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document by byte_bpe_50k."""
    return tokens.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every part of every document lies, in containers of 2,048 tokens."""
    sizes = tokens.count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "n_tokens")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold residue instead of a story."""
    return residue.residue_documents(table(spark, sf_dir, "documents"), "doc_id", "text", "source").filter("is_residue").select("doc_id")


def p10_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a text: whether it is residue, and whether recurring messages or only rules say so."""
    return residue.residue_documents(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found, "p2_ranking": p2_ranking, "p3_found": p3_found, "p4_found": p4_found, "p4_languages": p4_languages,
    "p5_found": p5_found, "p6_found": p6_found, "p6_blocks": p6_blocks, "p7_found": p7_found, "p7_clusters": p7_clusters,
    "p8_ids": p8_ids, "p9_containers": p9_containers,
    "p10_found": p10_found, "p10_residue": p10_residue,
}

def _p2_sql() -> str:
    scores = ("bm25", "fuzzy", "semantic")
    long = " UNION ALL ".join(f"SELECT search_id, article_id, '{c}' AS c, {c} AS s FROM h" for c in scores)
    v = {c: f"coalesce(max(CASE WHEN c = '{c}' THEN u END), 0.0)" for c in scores}
    top = {c: f"max(coalesce(max(CASE WHEN c = '{c}' THEN u END), 0.0)) OVER (PARTITION BY search_id)" for c in scores}
    plus = " + ".join(f"({top[c]} - {v[c]}) ** 2" for c in scores)
    minus = " + ".join(f"{v[c]} ** 2" for c in scores)
    return f"""WITH h AS (SELECT search_id, article_id, max(bm25) AS bm25, max(fuzzy) AS fuzzy, max(semantic) AS semantic FROM hybrid_results_labse WHERE search_id IS NOT NULL AND article_id IS NOT NULL GROUP BY ALL), l AS ({long}),
        b AS (SELECT search_id, c, quantile_disc(s, 0.05) AS lo, quantile_disc(s, 0.85) AS hi FROM l WHERE s IS NOT NULL GROUP BY ALL),
        x AS (SELECT l.search_id, article_id, l.c, CASE WHEN s IS NULL THEN 0.0 ELSE greatest(least(s, hi), lo) - lo END AS x FROM l LEFT JOIN b ON l.search_id = b.search_id AND l.c = b.c),
        n AS (SELECT search_id, article_id, c, coalesce(x / nullif(sqrt(sum(x * x) OVER (PARTITION BY search_id, c)), 0), 0.0) AS u FROM x),
        r AS (SELECT search_id, article_id, sqrt({plus}) AS p, sqrt({minus}) AS m FROM n GROUP BY search_id, article_id)
        SELECT search_id, article_id FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY coalesce(m / nullif(p + m, 0), 0) DESC, article_id) AS k FROM r) WHERE k <= 10"""


_P3_TIES = """SELECT left_id AS a, right_id AS b FROM entity_matches WHERE matched AND left_id IN (SELECT entity_id FROM entity_records) AND right_id IN (SELECT entity_id FROM entity_records) AND left_id <> right_id
    UNION SELECT x.m, y.entity_id FROM (SELECT alias, min(entity_id) AS m FROM (SELECT entity_id, unnest(aliases) AS alias FROM entity_records) WHERE regexp_matches(alias, '\\p{L}') GROUP BY alias) x
    JOIN (SELECT DISTINCT entity_id, unnest(aliases) AS alias FROM entity_records) y ON x.alias = y.alias WHERE x.m <> y.entity_id"""

ORACLE: dict[str, str] = {
    "p2_found": _p2_sql(),
    "p3_found": f"""WITH RECURSIVE t AS MATERIALIZED ({_P3_TIES}), e AS MATERIALIZED (SELECT a, b FROM t UNION SELECT b, a FROM t),
        w AS (SELECT DISTINCT a AS entity_id, a AS label FROM e UNION SELECT e.b, w.label FROM w JOIN e ON e.a = w.entity_id WHERE w.label < e.b)
        SELECT entity_id, min(label) AS group_id FROM w GROUP BY entity_id""",
}
