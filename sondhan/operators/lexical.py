"""Inverted index and the lexical rankers.

Indexes are tables: ``postings(doc_id, term, tf)``.  Queries are always a DataFrame
(query_id, text), so one job serves a whole batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondhan.functions.text import or_empty, split_words, tokens
from sondhan.operators.blocks import block_join
from sondhan.session import materialise


def full_text(title: Column, body: Column) -> Column:
    return F.trim(F.concat(or_empty(title), F.lit(" "), or_empty(body)))


def postings(docs: DataFrame, doc: str, text: Column, case: bool = False) -> DataFrame:
    """(doc_id, term, tf).  A document without words has no posting but still counts in ``lengths``."""
    words = (split_words if case else tokens)(text)
    return docs.select(F.col(doc).alias("doc_id"), F.explode(words).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def lengths(docs: DataFrame, doc: str, text: Column) -> DataFrame:
    return docs.select(F.col(doc).alias("doc_id"), F.size(tokens(text)).cast("long").alias("dl"))


def query_terms(queries: DataFrame, query: str = "query_id", text: str = "text", case: bool = False) -> DataFrame:
    """(query_id, term, qtf): the terms of each query with their multiplicity."""
    words = (split_words if case else tokens)(F.col(text))
    return queries.select(F.col(query).alias("query_id"), F.explode(words).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def top_k(scores: DataFrame, k: int, group: str = "query_id", item: str = "doc_id", score: str = "score") -> DataFrame:
    """Rank by score, then item; the limit prunes before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.desc(score), item)
    return scores.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


class Index:
    """A stored inverted index: (bucket, term, doc_id, tf, dl, df), partitioned by bucket and sorted by term, with n and avgdl.

    Built once in the shared folder; a batch of queries reads only the buckets of its terms, and in
    them, by the statistics of the files, little more than its terms.
    """

    BUCKETS = 64

    def __init__(self, docs: DataFrame, doc: str, text: Column, case: bool = False):
        self.case = case
        words = (split_words if case else tokens)(text)
        sized = materialise(docs.select(F.col(doc).alias("doc_id"), words.alias("w")).withColumn("dl", F.size("w").cast("long")))
        n = sized.agg(F.count(F.lit(1)), F.avg("dl")).first()
        self.n, self.avgdl = n[0], n[1] or 0.0
        post = sized.select("doc_id", "dl", F.explode("w").alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
        post = materialise(post)
        df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        bucket = F.pmod(F.xxhash64("term"), F.lit(self.BUCKETS)).cast("int").alias("bucket")
        whole = post.join(df, "term").select(bucket, "term", "doc_id", "tf", "dl", "df")
        self.table = materialise(whole.repartition("bucket").sortWithinPartitions("bucket", "term"), ["bucket"])

    def postings(self) -> DataFrame:
        return self.table.select("doc_id", "term", "tf")

    def terms(self) -> DataFrame:
        return self.table.select("term", "df").distinct()

    def _hits(self, queries: DataFrame) -> DataFrame:
        """Postings of the asked terms beside the queries that ask for them."""
        asked = query_terms(queries, case=self.case).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.BUCKETS)).cast("int"))
        buckets = [r[0] for r in asked.select("bucket").distinct().collect()]  # at most BUCKETS numbers
        return self.table.filter(F.col("bucket").isin(buckets)).drop("bucket").join(asked.drop("bucket"), "term")

    def bm25(self, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """(query_id, doc_id, score) of all documents with a query term; repeated query terms count again."""
        idf = F.log((F.lit(self.n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(self.avgdl)))
        return self._hits(queries).groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * idf * tf).alias("score"))

    def tfidf(self, queries: DataFrame) -> DataFrame:
        idf = F.log(F.lit(self.n) / (F.col("df") + 1)) + 1
        return self._hits(queries).groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * (1 + F.log("tf")) * idf).alias("score"))

    def okapi(self, queries: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
        """The variant whose negative idf become epsilon times the mean idf of the vocabulary."""
        raw = F.log(F.lit(self.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        mean = self.terms().agg(F.avg(raw)).first()[0] or 0.0
        idf = F.when(raw < 0, epsilon * F.lit(mean)).otherwise(raw)
        tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(self.avgdl)))
        return self._hits(queries).groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * idf * tf).alias("score"))


def bm25_scores(queries: DataFrame, docs: DataFrame, doc: str, text: Column, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """One batch of queries over documents that have no index yet."""
    return Index(docs, doc, text).bm25(queries, k1, b)


def tfidf_scores(queries: DataFrame, docs: DataFrame, doc: str, text: Column) -> DataFrame:
    return Index(docs, doc, text).tfidf(queries)


def bm25_okapi_scores(queries: DataFrame, docs: DataFrame, doc: str, text: Column, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """The case-sensitive variant."""
    return Index(docs, doc, text, case=True).okapi(queries, k1, b, epsilon)


#: Bits of the table that tells which words some query may ask for: 512 KB, whatever the number of queries.
ASKED_BITS = 1 << 22


def _asked_bits(terms: DataFrame) -> DataFrame:
    """One row with one array: the bits at the terms' hashes are set."""
    place = terms.select(F.pmod(F.xxhash64("term"), F.lit(ASKED_BITS)).alias("p"))
    words = place.groupBy(F.expr("p div 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("b"))
    every = terms.sparkSession.range(ASKED_BITS // 64).join(words, F.col("id") == F.col("at"), "left")
    return every.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("b", F.lit(0).cast("long")).alias("b")))).getField("b").alias("bits"))


def asked_words(docs: DataFrame, doc: str, text: Column, terms: DataFrame) -> DataFrame:
    """(doc_id, dl, term): every word that is one of ``terms`` (a few others pass with them) and, for each document, a row whose term is null."""
    words = docs.select(F.col(doc).alias("doc_id"), tokens(text).alias("w")).withColumn("dl", F.size("w").cast("long"))
    every = words.select("doc_id", "dl", F.explode(F.concat("w", F.array(F.lit(None).cast("string")))).alias("term"))
    p = F.pmod(F.xxhash64("term"), F.lit(ASKED_BITS))
    asked = F.getbit(F.get("bits", F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1
    return every.crossJoin(F.broadcast(_asked_bits(terms))).filter(F.col("term").isNull() | asked).drop("bits")


def _best_of_bags(bags: DataFrame, post: DataFrame, k: int, digits: int) -> DataFrame:
    """(bag, doc_id, score): the best k documents of each bag in each block of documents.  ``bags``: (bag, tid, qtf); ``post``: (tid, doc_id, w)."""

    def run(q: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        out = {"bag": [], "doc_id": [], "score": []}
        f = f.sort_values("tid", kind="stable")
        ids, at = np.unique(f["doc_id"].to_numpy(), return_inverse=True)
        tid, w = f["tid"].to_numpy(), f["w"].to_numpy()
        q = q.sort_values(["bag", "tid"])
        first, last = (np.searchsorted(tid, q["tid"].to_numpy(), side) for side in ("left", "right"))
        bag, qtf = q["bag"].to_numpy(), q["qtf"].to_numpy()
        edges = np.flatnonzero(np.r_[True, bag[1:] != bag[:-1], True]) if len(q) else []
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            score = np.zeros(len(ids))
            for i in range(a, z):
                score[at[first[i] : last[i]]] += qtf[i] * w[first[i] : last[i]]
            met = np.flatnonzero(score)
            s = np.round(score[met], digits)
            if len(s) > k:
                high = np.flatnonzero(s >= np.partition(s, -k)[-k])
                met = met[high[np.argsort(-s[high], kind="stable")[:k]]]
            out["bag"].append(np.full(len(met), bag[a]))
            out["doc_id"].append(ids[met])
            out["score"].append(score[met])
        return pd.DataFrame({c: np.concatenate(v) if v else [] for c, v in out.items()})

    kind = post.schema["doc_id"].dataType.simpleString()
    return block_join(bags, post, "bag", "doc_id", run, f"bag long, doc_id {kind}, score double", 20_000, 50_000)


def bm25_top_k(queries: DataFrame, docs: DataFrame, doc: str, text: Column, k: int = 10, digits: int = 6, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score, rank): the first k documents of each query by BM25, rounded to ``digits``, then document.

    For queries that grow with the documents, of which each scores a good part of the others' documents through words
    that all of them share.  The rows are those of ``bm25_scores`` and ``top_k``, without a row for each query and document:

    * queries of the same words are one;
    * a term is common if its postings times its queries exceed a tenth of the documents, else rare.  Documents with
      a rare term of the query are scored one by one;
    * the common terms of a query are its bag, which many queries share.  A document without a rare term has the score of the
      bag, and as rare terms only add to a score, it is among the first k only if it is among the first k of the bag.

    Only words that are asked for leave the documents.  All words of a document without id count as rare.
    """
    terms = query_terms(queries)
    bag_of = lambda rows, by: rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("term", "qtf"))).alias("words"))
    same = bag_of(terms, "query_id").groupBy("words").agg(F.collect_list(F.struct("query_id")).alias("ids"))
    same = materialise(same.withColumn("q", F.monotonically_increasing_id()))
    asked = same.select("q", F.explode("words").alias("t")).select("q", "t.term", "t.qtf")

    found = materialise(asked_words(docs, doc, text, asked.select("term")))
    n, avgdl = found.filter("term is null").agg(F.count(F.lit(1)), F.avg("dl")).first()
    post = found.filter("term is not null").repartition("term").groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
    known = asked.groupBy("term").agg(F.count(F.lit(1)).alias("nq")).join(post.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term")
    known = materialise(known.select(F.monotonically_increasing_id().alias("tid"), "term", "df", (F.col("df") * F.col("nq") * 10 > n).alias("common")))
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl or 0.0)))
    post = materialise(post.join(known, "term").select("tid", "doc_id", (idf * tf).alias("w"), (F.col("common") & F.col("doc_id").isNotNull()).alias("common")), ["common"])
    asked = materialise(asked.join(known, "term").select("q", "term", "tid", "qtf", "common"))

    part = F.col("qtf") * F.col("w")
    rare = asked.select("q", "tid", "qtf").join(post.filter("not common").select("tid", "doc_id", "w"), "tid")
    rare = materialise(rare.groupBy("q", "doc_id").agg(F.sum(part).alias("score")))
    common, often = asked.filter("common"), post.filter("common").select("tid", "doc_id", "w")
    rest = rare.select("q", "doc_id").join(common.select("q", "tid", "qtf"), "q").join(often, ["tid", "doc_id"]).select("q", "doc_id", part.alias("score"))
    whole = rare.unionByName(rest).groupBy("q", "doc_id").agg(F.sum("score").alias("score"))

    bags = materialise(bag_of(common, "q").groupBy("words").agg(F.collect_list("q").alias("qs")).withColumn("bag", F.monotonically_increasing_id()))
    words = bags.select("bag", F.explode("words").alias("t")).select("bag", "t.term", "t.qtf").join(known, "term").select("bag", "tid", "qtf")
    best = _best_of_bags(words, often, k, digits).withColumn("exact", F.col("score")).withColumn("score", F.round("score", digits))
    best = top_k(best, k, "bag").select("bag", "doc_id", F.col("exact").alias("score")).join(bags.select("bag", F.explode("qs").alias("q")), "bag").select("q", "doc_id", "score")

    # a document that is in both has the larger score where all its terms count
    both = whole.unionByName(best).groupBy("q", "doc_id").agg(F.round(F.max("score"), digits).alias("score"))
    ranked = top_k(both, k, "q").join(same.select("q", F.explode("ids").alias("i")), "q")
    return ranked.select("i.query_id", "doc_id", "score", "rank")
