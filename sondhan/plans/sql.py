"""Text shared by the SQL twins of the queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
MARKS = r"[^\p{L}\p{N}_\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BENGALI = r"[\x{0980}-\x{09FF}]"


class Registry:
    """Queries of a module with their SQL twins."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracle[f.__name__] = sql
            return f

        return keep


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), '{WS}+'), lambda w: w <> '')"


def tokens(x: str) -> str:
    return words(f"lower({x})")


def shingles(x: str, k: int) -> str:
    w = words(f"regexp_replace(lower(coalesce({x}, '')), '{MARKS}', '', 'g')")
    return f"(SELECT CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i : i + {k} - 1], ' '))) END FROM (SELECT {w} AS w))"


def trigrams(x: str) -> str:
    return f"(CASE WHEN length({x}) < 3 THEN [{x}] ELSE list_transform(range(1, length({x}) - 1), lambda i: substring({x}, i, 3)) END)"


def jaccard(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))::DOUBLE END)"


#: The stated query set: texts of the searches whose id is divisible by 20.
QUERIES = "SELECT min(search_id) AS query_id, query AS text FROM hybrid_results_labse WHERE search_id % 20 = 0 AND query IS NOT NULL GROUP BY query"
#: The retrieval corpus.
DOCS = "SELECT article_id AS doc_id, trim(coalesce(title, '') || ' ' || coalesce(body, '')) AS txt, language FROM articles"
#: One row an article of a search, the best of its repeated rows.
HITS = "SELECT search_id AS query_id, article_id AS doc_id, max(bm25) AS bm25, max(fuzzy) AS fuzzy, max(semantic) AS semantic FROM hybrid_results_labse GROUP BY search_id, article_id"
#: Stand-in for human labels: a hit is relevant if each of its scores is at least the search's mean.
RELEVANT = f"""SELECT query_id, doc_id FROM (SELECT h.*, avg(bm25) OVER (PARTITION BY query_id) AS ab, avg(fuzzy) OVER (PARTITION BY query_id) AS af, avg(semantic) OVER (PARTITION BY query_id) AS asem
    FROM ({HITS}) h) WHERE round(bm25 - ab, 9) >= 0 AND round(fuzzy - af, 9) >= 0 AND round(semantic - asem, 9) >= 0"""
#: A page as it might have been captured, made of an article; the same text in both dialects.
PAGE = """'<html><head><meta property="og:title" content="' || replace(coalesce(title, ''), '"', '&quot;') || '"></head><body><h1>' || replace(replace(coalesce(title, ''), '&', '&amp;'), '<', '&lt;')
    || '</h1><time datetime="' || replace(coalesce(date, ''), '"', '') || '">x</time><article><p>' || replace(replace(replace(coalesce(body, ''), '&', '&amp;'), '<', '&lt;'), chr(10) || chr(10), '</p><p>')
    || '</p></article><a class="l" href="' || coalesce(url, '') || '">more</a><a href="https://x.example/topic/' || coalesce(category, '') || '">' || coalesce(category, '') || '</a></body></html>'"""
