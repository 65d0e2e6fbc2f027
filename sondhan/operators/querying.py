"""Query processing: normalising, language, entity matching, expansion, translation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondhan.functions.text import collapse, detect_lang, is_mixed, split_words, tokens


def normalize_query(q: Column) -> Column:
    """Single blanks, none at the ends; case stays."""
    return collapse(q)


def target_language(lang: Column) -> Column:
    return F.when(lang == "bn", "en").otherwise("bn")


def name_lookup(records: DataFrame, seq: str = "entity_id") -> DataFrame:
    """(name, entity_id): canonical names (English in lower case) and lower-case aliases; the last writer wins."""
    names = records.select(
        "entity_id", F.explode(F.concat(F.array(F.lower("canonical_en"), F.col("canonical_bn")), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), F.lower))).alias("name")
    ).filter("name is not null and name <> ''")
    return names.groupBy("name").agg(F.max_by("entity_id", seq).alias("entity_id"))


def windows(queries: DataFrame, most: int = 4, query: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, pos, size, phrase, surface): all windows of one to ``most`` words; the phrase is lower case unless Bangla."""
    lang = detect_lang(F.col(text))
    rows = queries.select(F.col(query).alias("query_id"), split_words(F.col(text)).alias("w"), lang.alias("lang")).withColumn("size", F.explode(F.array(*[F.lit(n) for n in range(most, 0, -1)])))
    rows = rows.filter(F.size("w") >= F.col("size")).withColumn("pos", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)))
    surface = F.array_join(F.slice("w", F.col("pos"), F.col("size")), " ")
    phrase = F.when(F.col("lang") == "bn", F.col("surface")).otherwise(F.lower("surface"))
    return rows.withColumn("surface", surface).select("query_id", F.col("pos").cast("long").alias("pos"), F.col("size").cast("long").alias("size"), phrase.alias("phrase"), "surface", "lang")


def match_entities(queries: DataFrame, lookup: DataFrame, most: int = 4) -> DataFrame:
    """All windows that name an entity; longer matches do not hide shorter ones."""
    return windows(queries, most).join(lookup.withColumnRenamed("name", "phrase"), "phrase").select("query_id", "pos", "size", "phrase", "entity_id", "lang")


def expand_queries(queries: DataFrame, records: DataFrame, neighbours: DataFrame, top: int = 3) -> DataFrame:
    """(query_id, expanded): the sorted set of query words, canonical names, words of the first two aliases and canonical names of the strongest neighbours of matched entities.

    ``neighbours``: (entity_id, neighbour, rank).
    """
    hit = match_entities(queries, name_lookup(records)).select("query_id", "entity_id").distinct()
    full = hit.join(records.select("entity_id", "canonical_en", "canonical_bn", "aliases"), "entity_id")
    own = full.select("query_id", F.explode(F.array("canonical_en", "canonical_bn")).alias("word"))
    alias = full.select("query_id", F.explode(F.slice(F.coalesce("aliases", F.array().cast("array<string>")), 1, 2)).alias("a")).select("query_id", F.explode(split_words(F.col("a"))).alias("word"))
    near = hit.join(neighbours.filter(F.col("rank") <= top), "entity_id").select("query_id", F.col("neighbour").alias("entity_id"))
    near = near.join(records.select("entity_id", "canonical_en", "canonical_bn"), "entity_id").select("query_id", F.explode(F.array("canonical_en", "canonical_bn")).alias("word"))
    words = queries.select("query_id", F.explode(split_words(F.col("text"))).alias("word"))
    every = words.unionByName(own).unionByName(alias).unionByName(near).filter("word is not null and word <> ''").distinct()
    return every.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("word")), " ").alias("expanded"))


def pinned(queries: DataFrame, records: DataFrame) -> DataFrame:
    """(query_id, phrase, target): matched phrases with the canonical name in the other language, where there is one."""
    hit = match_entities(queries, name_lookup(records))
    joined = hit.join(records.select("entity_id", "canonical_en", "canonical_bn"), "entity_id")
    target = F.when(F.col("lang") == "bn", F.col("canonical_en")).otherwise(F.col("canonical_bn"))
    return joined.select("query_id", "phrase", target.alias("target")).filter("target is not null").distinct()


def translate(queries: DataFrame, pins: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(query_id, translated): a pin for the whole query, else the dictionary's entry, else the query itself.

    ``dictionary``: (phrase, target).  Only whole-query pins apply.
    """
    whole = F.lower(normalize_query(F.col("text")))
    best = pins.groupBy("query_id", F.lower("phrase").alias("whole")).agg(F.min("target").alias("pin"))
    out = queries.withColumn("whole", whole).join(best, ["query_id", "whole"], "left").join(dictionary.select(F.col("phrase").alias("whole"), F.col("target").alias("entry")), "whole", "left")
    return out.select("query_id", F.coalesce("pin", "entry", "text").alias("translated"))


def process(queries: DataFrame, pins: DataFrame, dictionary: DataFrame) -> DataFrame:
    lang = detect_lang(F.col("text"))
    base = queries.select("query_id", F.col("text").alias("original"), lang.alias("language"), target_language(lang).alias("target"), normalize_query(F.col("text")).alias("normalized"), is_mixed(F.col("text")).alias("is_mixed"))
    return base.join(translate(queries, pins, dictionary), "query_id", "left")


__all__ = ["expand_queries", "match_entities", "name_lookup", "normalize_query", "pinned", "process", "target_language", "tokens", "translate", "windows"]
