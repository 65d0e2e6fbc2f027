"""One entry point for all search methods, and what is shown of their hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondhan.operators import fusion, fuzzy, lexical
from sondhan.operators.semantic import Embedder, cosine_top_k, embed

METHODS = ("bm25", "fuzzy", "semantic", "hybrid")


class Search:
    """Searches of batches of queries (query_id, text) over one indexed corpus.

    ``vectors``: (doc_id, embedding) by ``embedder``; without them only bm25 and fuzzy can be asked for.
    """

    def __init__(self, index: lexical.Index, vectors: DataFrame | None = None, embedder: Embedder | None = None, threshold: float = 70.0):
        self.index, self.vectors, self.embedder, self.threshold = index, vectors, embedder, threshold

    def search(self, queries: DataFrame, method: str = "hybrid", k: int = 10, weights: dict[str, float] | None = None) -> DataFrame:
        """(query_id, doc_id, score, rank), and for ``hybrid`` the parts of the score; ValueError for an unknown method."""
        if method == "bm25":
            return lexical.top_k(self.index.bm25(queries).withColumn("score", F.round("score", 6)), k)
        if method == "fuzzy":
            return lexical.top_k(self._fuzzy(queries).withColumn("score", F.round("score", 6)), k)
        if method == "semantic":
            return self._semantic(queries, k)
        if method == "hybrid":
            parts = {"bm25": self.index.bm25(queries), "fuzzy": self._fuzzy(queries)}
            if self.vectors is not None:
                parts["semantic"] = self._semantic(queries, max(50, k)).drop("rank")
            scores = fusion.union_scores(parts)
            return fusion.hybrid(scores if "semantic" in parts else scores.withColumn("semantic", F.lit(None).cast("double")), "query_id", "doc_id", weights, k)
        raise ValueError(f"unknown method {method!r}; one of {', '.join(METHODS)}")

    def _fuzzy(self, queries: DataFrame) -> DataFrame:
        asked = lexical.query_terms(queries)
        found = fuzzy.vocabulary_match(asked.select("term").distinct(), self.index.terms().select(F.col("term").alias("word")), self.threshold)
        return fuzzy.fuzzy_scores(asked, found, self.index.postings())

    def _semantic(self, queries: DataFrame, k: int) -> DataFrame:
        if self.vectors is None or self.embedder is None:
            raise ValueError("semantic search needs vectors and the embedder that made them")
        return cosine_top_k(embed(queries, "query_id", "text", self.embedder).select("query_id", "embedding"), self.vectors, "query_id", "doc_id", "embedding", k)


def present(hits: DataFrame, docs: DataFrame, doc: str = "doc_id", title: int = 80, body: int = 150) -> DataFrame:
    """Hits with the first letters of title and body and the address; '-' for what is null or empty."""
    shown = lambda c, n: F.coalesce(F.nullif(F.substring(c, 1, n), F.lit("")), F.lit("-"))
    rows = docs.select(F.col(doc), shown("title", title).alias("title"), shown("body", body).alias("body"), F.coalesce("url", F.lit("-")).alias("url"))
    return hits.join(rows, doc)


def labeling_rows(hits: DataFrame, docs: DataFrame, queries: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Rows for human judgement: query, address, title, score with three figures, rank, and blanks for the judgement and the judge."""
    joined = hits.join(docs.select(doc, F.coalesce("url", F.lit("")).alias("doc_url"), F.coalesce("title", F.lit("")).alias("title")), doc).join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    return joined.select("query", "doc_url", "title", F.format_string("%.3f", "score").alias("score"), "rank", F.lit("").alias("relevant"), F.lit("").alias("annotator"))
