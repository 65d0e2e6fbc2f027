"""Retrieval queries: postings, rankers, fusion, query processing, evaluation.

Corpus: all articles (title and body).  Queries: the texts of the searches whose id is
divisible by 20, against all articles.  Score fusion and evaluation run over all
searches of hybrid_results_labse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondhan.functions import text as T
from sondhan.operators import evaluation, fusion, fuzzy, lexical, querying, search, semantic
from sondhan.plans import sql as S
from sondhan.session import spread, table

R = S.Registry()


def _text():
    return lexical.full_text(F.col("title"), F.col("body"))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "articles").select("article_id", "title", "body", "language"))


def queries(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "hybrid_results_labse").filter("search_id % 20 = 0 and query is not null")
    return hits.groupBy(F.col("query").alias("text")).agg(F.min("search_id").alias("query_id")).select("query_id", "text")


def hits(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "hybrid_results_labse")
    return rows.groupBy(F.col("search_id").alias("query_id"), F.col("article_id").alias("doc_id")).agg(F.max("bm25").alias("bm25"), F.max("fuzzy").alias("fuzzy"), F.max("semantic").alias("semantic"))


def relevant(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in for human labels, made of the very scores under evaluation: metrics over it test the arithmetic, not the rankers."""
    h = hits(spark, d)
    mean = h.groupBy("query_id").agg(F.avg("bm25").alias("ab"), F.avg("fuzzy").alias("af"), F.avg("semantic").alias("asem"))
    return h.join(mean, "query_id").filter("round(bm25 - ab, 9) >= 0 and round(fuzzy - af, 9) >= 0 and round(semantic - asem, 9) >= 0").select("query_id", "doc_id")


_BUILT: dict[tuple, lexical.Index] = {}


def index(spark: SparkSession, d: str, case: bool = False, again: bool = False) -> lexical.Index:
    """The stored index of the corpus: built on first use, and anew if the files of the table have changed."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/articles.parquet")
    files = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(fs_path, True)
    state = []
    while files.hasNext():
        f = files.next()
        state.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    key = (spark.sparkContext.applicationId, d, case, tuple(sorted(state)))
    if again or key not in _BUILT:
        _BUILT[key] = lexical.Index(corpus(spark, d), "article_id", _text(), case)
    return _BUILT[key]


_POST = f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({S.tokens('txt')}) AS term FROM ({S.DOCS})) GROUP BY doc_id, term"
_LEN = f"SELECT doc_id, len({S.tokens('txt')}) AS dl FROM ({S.DOCS})"
_ASKED = f"SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({S.tokens('text')}) AS term FROM ({S.QUERIES})) GROUP BY query_id, term"
_BASE = f"WITH post AS MATERIALIZED ({_POST}), len_ AS ({_LEN}), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len_), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term), asked AS ({_ASKED})"
_BM25 = f"""{_BASE} SELECT query_id, doc_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
    FROM asked JOIN dfs USING (term) JOIN post USING (term) JOIN len_ USING (doc_id), st GROUP BY query_id, doc_id"""
_TFIDF = f"{_BASE} SELECT query_id, doc_id, sum(qtf * (1 + ln(tf)) * (ln(n / (df + 1)) + 1)) AS score FROM asked JOIN dfs USING (term) JOIN post USING (term), st GROUP BY query_id, doc_id"


def _top(scores: str, k: int = 10) -> str:
    return f"SELECT query_id, doc_id, score, rank FROM (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM ({scores})) WHERE rank <= {k}"


def _ranked(scores: DataFrame, k: int = 10) -> DataFrame:
    return lexical.top_k(scores.withColumn("score", F.round("score", 6)), k)


@R.add(f"SELECT doc_id, {S.tokens('txt')} AS tokens FROM ({S.DOCS})")
def tokenize(spark, d):
    return corpus(spark, d).select(F.col("article_id").alias("doc_id"), T.tokens(_text()).alias("tokens"))


@R.add(_POST)
def postings(spark, d):
    return lexical.postings(corpus(spark, d), "article_id", _text())


@R.add(_POST)
def term_freq(spark, d):
    return postings(spark, d)


@R.add(f"SELECT term, count(*) AS df FROM ({_POST}) GROUP BY term")
def doc_freq(spark, d):
    return postings(spark, d).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@R.add(f"SELECT count(*) AS n, round(coalesce(avg(dl), 0), 6) AS avgdl FROM ({_LEN})")
def avg_doc_len(spark, d):
    return lexical.lengths(corpus(spark, d), "article_id", _text()).agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.avg("dl"), F.lit(0.0)), 6).alias("avgdl"))


@R.add(f"SELECT term, round(ln(((SELECT count(*) FROM articles) - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM (SELECT term, count(*) AS df FROM ({_POST}) GROUP BY term)")
def bm25_idf(spark, d):
    n = corpus(spark, d).agg(F.count(F.lit(1)).alias("n"))
    return doc_freq(spark, d).crossJoin(F.broadcast(n)).select("term", F.round(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), 6).alias("idf"))


@R.add(f"SELECT query_id, doc_id, round(score, 6) AS score FROM ({_BM25})")
def bm25_scores(spark, d):
    return index(spark, d).bm25(queries(spark, d)).withColumn("score", F.round("score", 6))


def flagship(spark, d):
    """BM25 top ten of every query text."""
    return _ranked(index(spark, d).bm25(texts(spark, d)))


@R.add(f"SELECT count(*) AS postings, count(DISTINCT term) AS terms, max(df) AS max_df FROM (SELECT term, doc_id, count(*) OVER (PARTITION BY term) AS df FROM ({_POST}))")
def index_build(spark, d):
    """Builds the stored index anew, whatever there is, and describes it."""
    t = index(spark, d, again=True).table
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.max("df").alias("df")).agg(F.sum("n").alias("postings"), F.count(F.lit(1)).alias("terms"), F.max("df").alias("max_df"))


@R.add(_top(_BM25))
def bm25_topk(spark, d):
    return _ranked(index(spark, d).bm25(queries(spark, d)))


@R.add(_top(_TFIDF))
def tfidf_topk(spark, d):
    return _ranked(index(spark, d).tfidf(queries(spark, d)))


_OKAPI = f"""WITH post AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({S.words('txt')}) AS term FROM ({S.DOCS})) GROUP BY doc_id, term), len_ AS (SELECT doc_id, len({S.words('txt')}) AS dl FROM ({S.DOCS})),
    st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len_), raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM post GROUP BY term), st), m AS (SELECT avg(raw) AS mean_idf FROM raw),
    asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({S.words('text')}) AS term FROM ({S.QUERIES})) GROUP BY query_id, term)
    SELECT query_id, doc_id, sum(qtf * (CASE WHEN raw < 0 THEN 0.25 * mean_idf ELSE raw END) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM asked JOIN raw USING (term) JOIN post USING (term) JOIN len_ USING (doc_id), st, m GROUP BY query_id, doc_id"""


@R.add(_top(_OKAPI))
def bm25_okapi_topk(spark, d):
    return _ranked(index(spark, d, case=True).okapi(queries(spark, d)))


@R.add("WITH t AS (SELECT DISTINCT unnest({}) AS word FROM ({})) SELECT word, {} AS grams FROM t".format(S.tokens("text"), S.QUERIES, S.trigrams("word")))
def char_trigrams(spark, d):
    words = queries(spark, d).select(F.explode(T.tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", T.trigrams(F.col("word")).alias("grams"))


_LCS = """list_reduce(list_prepend(list_transform(range(0, length(b) + 1), lambda i: 0), list_transform(range(1, length(a) + 1), lambda i: [i])), lambda p, x: list_reduce(list_prepend([0], list_transform(range(1, length(b) + 1), lambda j: [j])),
    lambda q, j: q || [CASE WHEN substring(a, x[1], 1) = substring(b, j[1], 1) THEN p[j[1]] + 1 ELSE greatest(p[j[1] + 1], q[j[1]]) END]))[-1]"""


def _lcs_ratio(a: str, b: str) -> str:
    return f"(CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 ELSE 200.0 * (SELECT {_LCS} FROM (SELECT {a} AS a, {b} AS b)) / (length({a}) + length({b})) END)"


_VOCAB = f"SELECT DISTINCT unnest({S.tokens('txt')}) AS word FROM ({S.DOCS})"
_MATCH = f"""WITH t AS (SELECT DISTINCT term, list_distinct({S.trigrams('term')}) AS tg FROM (SELECT DISTINCT unnest({S.tokens('text')}) AS term FROM ({S.QUERIES}))), v AS (SELECT word, list_distinct({S.trigrams('word')}) AS wg FROM ({_VOCAB}))
    SELECT term, word, 100 * {S.jaccard('tg', 'wg')} AS sim FROM t, v WHERE 100 * {S.jaccard('tg', 'wg')} >= 70"""


_NEAR = f"""WITH t AS MATERIALIZED (SELECT DISTINCT term, list_distinct({S.trigrams('term')}) AS tg FROM (SELECT DISTINCT unnest({S.tokens('text')}) AS term FROM ({S.QUERIES}))), v AS MATERIALIZED (SELECT word, list_distinct({S.trigrams('word')}) AS wg FROM ({_VOCAB})),
    j AS (SELECT term, word, 100 * {S.jaccard('tg', 'wg')} AS sim FROM t, v WHERE 100 * {S.jaccard('tg', 'wg')} >= 70),
    l AS (SELECT a AS term, b AS word, round_even(200.0 * {_LCS} / (length(a) + length(b)), 0) AS sim FROM (SELECT term AS a, word AS b FROM t, v WHERE length(word) BETWEEN 0.53 * length(term) AND 1.89 * length(term)))
    SELECT term, word, max(sim) AS sim FROM (SELECT * FROM j UNION ALL SELECT * FROM l WHERE sim >= 70) GROUP BY term, word"""
_FUZZY = f"SELECT query_id, doc_id, sum(qtf * sim / 100) AS score FROM ({_ASKED}) a JOIN ({_NEAR}) m USING (term) JOIN (SELECT doc_id, term AS word FROM ({_POST})) p USING (word) GROUP BY query_id, doc_id"


def _terms(spark, d):
    return queries(spark, d).select(F.explode(T.tokens(F.col("text"))).alias("term")).distinct()


def _vocab(spark, d):
    return index(spark, d).terms().select(F.col("term").alias("word"))


@R.add(f"SELECT term, word, round(sim, 6) AS sim FROM ({_MATCH})")
def trigram_jaccard(spark, d):
    return fuzzy.vocabulary_match(_terms(spark, d), _vocab(spark, d), ratio=False).withColumn("sim", F.round("sim", 6))


@R.add(f"SELECT term, word, round(sim, 6) AS sim FROM ({_NEAR})")
def fuzzy_vocab_match(spark, d):
    """Greater of trigram Jaccard and rounded LCS ratio, 70 or more."""
    return fuzzy.vocabulary_match(_terms(spark, d), _vocab(spark, d)).withColumn("sim", F.round("sim", 6))


def _fuzzy(spark, d) -> DataFrame:
    built = index(spark, d)
    vocab = built.terms().select(F.col("term").alias("word"))
    return fuzzy.fuzzy_scores(lexical.query_terms(queries(spark, d)), fuzzy.vocabulary_match(_terms(spark, d), vocab), built.postings())


@R.add(_top(_FUZZY))
def fuzzy_topk(spark, d):
    return _ranked(_fuzzy(spark, d))


@R.add(_top(f"SELECT query_id, doc_id, sum(qtf * sim / 100) AS score FROM ({_ASKED}) a JOIN ({_MATCH}) m USING (term) JOIN (SELECT doc_id, term AS word FROM ({_POST})) p USING (word) GROUP BY query_id, doc_id"))
def fuzzy_jaccard_topk(spark, d):
    return _ranked(fuzzy.fuzzy_scores(lexical.query_terms(queries(spark, d)), fuzzy.vocabulary_match(_terms(spark, d), _vocab(spark, d), ratio=False), index(spark, d).postings()))


@R.add(f"""WITH p AS (SELECT entity_id, lower(canonical_en) AS a, lower(aliases[1]) AS b FROM entity_records WHERE canonical_en IS NOT NULL AND aliases[1] IS NOT NULL)
    SELECT entity_id, round(CASE WHEN length(a) = 0 OR length(b) = 0 THEN 0.0 ELSE 200.0 * {_LCS} / (length(a) + length(b)) END, 6) AS ratio FROM p""")
def indel_ratio(spark, d):
    """LCS ratio of each record's English name with its first alias."""
    rows = table(spark, d, "entity_records").select("entity_id", F.lower("canonical_en").alias("a"), F.lower(F.get("aliases", F.lit(0))).alias("b")).filter("a is not null and b is not null")
    return rows.select("entity_id", F.round(fuzzy.lcs_ratio_udf("a", "b"), 6).alias("ratio"))


# the common words are a beginning of both sides, so their own ratios need no comparison of letters
_SETS = f"""SELECT query, title, array_to_string(list_sort(list_intersect(x, y)), ' ') AS c, array_to_string(list_sort(list_filter(x, lambda w: NOT list_contains(y, w))), ' ') AS l, array_to_string(list_sort(list_filter(y, lambda w: NOT list_contains(x, w))), ' ') AS r
    FROM (SELECT query, title, list_distinct({S.tokens('query')}) AS x, list_distinct({S.tokens('title')}) AS y FROM (SELECT DISTINCT query, title FROM hybrid_results_labse WHERE query IS NOT NULL AND title IS NOT NULL))"""


@R.add(f"""SELECT query, title, CASE WHEN length(a) = 0 OR length(b) = 0 THEN 0.0 ELSE greatest(CASE WHEN length(c) = 0 THEN 0.0 ELSE greatest(round_even(200.0 * length(c) / (length(c) + length(a)), 0), round_even(200.0 * length(c) / (length(c) + length(b)), 0)) END,
    round_even(200.0 * {_LCS} / (length(a) + length(b)), 0)) END::DOUBLE AS ratio FROM (SELECT query, title, c, trim(c || ' ' || l) AS a, trim(c || ' ' || r) AS b FROM ({_SETS}))""")
def token_set_ratio(spark, d):
    rows = table(spark, d, "hybrid_results_labse").filter("query is not null and title is not null").select("query", "title").distinct()
    return rows.select("query", "title", fuzzy.token_set_ratio_udf("query", "title").alias("ratio"))


_COS = """SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 6) AS score
    FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0"""


def _cosine(spark, d, k=10):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    q = e.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return semantic.cosine_top_k(q, e.withColumnRenamed("vec_id", "doc_id"), "query_id", "doc_id", "embedding", k)


@R.add(_top(_COS))
def cosine_topk(spark, d):
    return _cosine(spark, d)


# --- fusion over all searches

_MM = f"""SELECT query_id, doc_id, CASE WHEN max(bm25) OVER w = min(bm25) OVER w THEN bm25 * 0 + 1.0 ELSE (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w) END AS bm25_n,
    CASE WHEN max(fuzzy) OVER w = min(fuzzy) OVER w THEN fuzzy * 0 + 1.0 ELSE (fuzzy - min(fuzzy) OVER w) / (max(fuzzy) OVER w - min(fuzzy) OVER w) END AS fuzzy_n, semantic FROM ({S.HITS}) WINDOW w AS (PARTITION BY query_id)"""
_HYB = f"SELECT query_id, doc_id, round(0.2 * coalesce(bm25_n, 0) + 0.6 * coalesce(semantic, 0) + 0.2 * coalesce(fuzzy_n, 0), 6) AS score, round(coalesce(bm25_n, 0), 6) AS bm25, round(coalesce(fuzzy_n, 0), 6) AS fuzzy, round(coalesce(semantic, 0), 6) AS semantic FROM ({_MM})"
_HYBTOP = f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ({_HYB})"


@R.add(f"SELECT query_id, doc_id, round(bm25_n, 6) AS bm25_n, round(fuzzy_n, 6) AS fuzzy_n FROM ({_MM})")
def minmax_norm(spark, d):
    out = fusion.minmax(fusion.minmax(hits(spark, d), "query_id", "bm25", "bm25_n"), "query_id", "fuzzy", "fuzzy_n")
    return out.select("query_id", "doc_id", F.round("bm25_n", 6).alias("bm25_n"), F.round("fuzzy_n", 6).alias("fuzzy_n"))


@R.add(f"SELECT query_id, doc_id, score, bm25, fuzzy, semantic, rank, max(score) OVER (PARTITION BY query_id) < 0.2 AS low_confidence FROM ({_HYBTOP}) WHERE rank <= 10")
def hybrid_topk(spark, d):
    return fusion.hybrid(hits(spark, d), "query_id", "doc_id")


_MAXN = f"""SELECT query_id, doc_id, 100 * (0.2 * coalesce(coalesce(bm25, 0) / nullif(max(bm25) OVER w, 0), 0) + 0.1 * coalesce(coalesce(fuzzy, 0) / nullif(max(fuzzy) OVER w, 0), 0) + 0.7 * coalesce(coalesce(semantic, 0) / nullif(max(semantic) OVER w, 0), 0)) AS score
    FROM ({S.HITS}) WINDOW w AS (PARTITION BY query_id)"""


@R.add(_top(_MAXN))
def hybrid_maxnorm_topk(spark, d):
    return fusion.hybrid_maxnorm(hits(spark, d), "query_id", "doc_id")


@R.add(f"SELECT query_id, max(score) AS top_score, max(score) < 0.2 AS low_confidence FROM ({_HYB}) GROUP BY query_id")
def low_confidence(spark, d):
    return fusion.low_confidence(fusion.hybrid(hits(spark, d), "query_id", "doc_id", k=1), "query_id")


@R.add(f"SELECT t.query_id, t.doc_id, t.rank, t.score AS hybrid, round(coalesce(h.bm25, 0), 6) AS bm25, round(coalesce(h.fuzzy, 0), 6) AS fuzzy, round(coalesce(h.semantic, 0), 6) AS semantic FROM ({_HYBTOP}) t JOIN ({S.HITS}) h ON t.query_id = h.query_id AND t.doc_id = h.doc_id WHERE t.rank <= 10")
def compare_methods(spark, d):
    top = fusion.hybrid(hits(spark, d), "query_id", "doc_id").select("query_id", "doc_id", "rank", F.col("score").alias("hybrid"))
    raw = hits(spark, d).select("query_id", "doc_id", *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("bm25", "fuzzy", "semantic")])
    return top.join(raw, ["query_id", "doc_id"], "left")


def _by(col: str, k: int) -> str:
    return f"SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY {col} DESC NULLS LAST, doc_id) AS rank FROM ({S.HITS})"


def _run(spark, d, col: str, k: int) -> DataFrame:
    scored = hits(spark, d).filter(F.col(col).isNotNull()).select("query_id", "doc_id", F.col(col).alias("score"))
    return lexical.top_k(scored, k)


def _run_sql(col: str, k: int = 50) -> str:
    return f"SELECT query_id, doc_id, rank FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY {col} DESC, doc_id) AS rank FROM ({S.HITS}) WHERE {col} IS NOT NULL) WHERE rank <= {k}"


@R.add(f"SELECT q.query_id, coalesce(n, 0)::BIGINT AS common FROM (SELECT query_id FROM ({_run_sql('bm25', 5)}) UNION SELECT query_id FROM ({_run_sql('semantic', 5)})) q LEFT JOIN (SELECT a.query_id, count(*) AS n FROM ({_run_sql('bm25', 5)}) a JOIN ({_run_sql('semantic', 5)}) b ON a.query_id = b.query_id AND a.doc_id = b.doc_id GROUP BY a.query_id) o ON q.query_id = o.query_id")
def topk_overlap(spark, d):
    return fusion.topk_overlap(_run(spark, d, "bm25", 5), _run(spark, d, "semantic", 5))


# --- cross-lingual search: top 20 of the mixed corpus, then the language filter; ranks keep their gaps

_MIXED = _top(_BM25, 20)


@R.add(f"SELECT t.query_id, t.doc_id, t.score, t.rank, a.language AS lang FROM ({_MIXED}) t JOIN articles a ON t.doc_id = a.article_id WHERE a.language IN ('en', 'bn')")
def xling_bm25(spark, d):
    top = _ranked(index(spark, d).bm25(queries(spark, d)), 20)
    lang = corpus(spark, d).select(F.col("article_id").alias("doc_id"), F.col("language").alias("lang"))
    return top.join(lang, "doc_id").filter("lang in ('en', 'bn')").select("query_id", "doc_id", "score", "rank", "lang")


def _within(scores: str, k: int = 20) -> str:
    """The top k of each language of the articles, as the language filter comes first here."""
    return f"SELECT query_id, doc_id, score, rank, lang FROM (SELECT query_id, doc_id, round(score, 6) AS score, language AS lang, row_number() OVER (PARTITION BY query_id, language ORDER BY round(score, 6) DESC, doc_id) AS rank FROM ({scores}) JOIN articles ON doc_id = article_id WHERE language IN ('en', 'bn')) WHERE rank <= {k}"


def _languages(spark, d) -> DataFrame:
    return table(spark, d, "articles").filter("language in ('en', 'bn')").select(F.col("article_id").alias("doc_id"), F.col("language").alias("lang"))


@R.add(_within(_COS))
def xling_cosine(spark, d):
    """Top 20 of each language; vectors are paired with articles by id."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    halves = [semantic.cosine_top_k(q, e.join(_languages(spark, d).filter(F.col("lang") == lang), "doc_id", "left_semi"), "query_id", "doc_id", "embedding", 20).withColumn("lang", F.lit(lang)) for lang in ("en", "bn")]
    return halves[0].unionByName(halves[1])


@R.add(_within(_FUZZY))
def xling_fuzzy(spark, d):
    """Top 20 of each language by fuzzy matching."""
    scored = _fuzzy(spark, d).withColumn("score", F.round("score", 6)).join(_languages(spark, d), "doc_id").withColumn("g", F.struct("query_id", "lang"))
    return lexical.top_k(scored.select("g", "doc_id", "score"), 20, "g").select("g.query_id", "doc_id", "score", "rank", "g.lang")


_SHOWN = "SELECT article_id AS doc_id, coalesce(nullif(substring(title, 1, 80), ''), '-') AS title, coalesce(nullif(substring(body, 1, 150), ''), '-') AS body, coalesce(url, '-') AS url FROM articles"


@R.add(f"SELECT t.*, s.title, s.body, s.url FROM ({_top(_BM25)}) t JOIN ({_SHOWN}) s USING (doc_id)")
def search_topk(spark, d):
    """The search entry point and what it shows of its hits."""
    hits_ = search.Search(index(spark, d)).search(queries(spark, d), "bm25")
    return search.present(hits_, table(spark, d, "articles").withColumnRenamed("article_id", "doc_id"))


@R.add(f"SELECT q.text AS query, coalesce(a.url, '') AS doc_url, coalesce(a.title, '') AS title, printf('%.3f', t.score) AS score, t.rank, '' AS relevant, '' AS annotator FROM ({_top(_BM25, 50)}) t JOIN articles a ON t.doc_id = a.article_id JOIN ({S.QUERIES}) q USING (query_id)")
def labeling_rows(spark, d):
    """Fifty hits a query, to be judged by hand."""
    hits_ = search.Search(index(spark, d)).search(queries(spark, d), "bm25", 50)
    return search.labeling_rows(hits_, table(spark, d, "articles").withColumnRenamed("article_id", "doc_id"), queries(spark, d))


@R.add(f"""WITH x AS (SELECT t.*, a.language AS lang FROM ({_MIXED}) t JOIN articles a ON t.doc_id = a.article_id WHERE a.language IN ('en', 'bn'))
    SELECT query_id, doc_id, score, lang, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CASE WHEN lang = 'en' THEN 0 ELSE 1 END, rank) AS r FROM x) WHERE r <= 10""")
def merge_ranked(spark, d):
    both = xling_bm25(spark, d)
    return fusion.merge_ranked(both.filter("lang = 'en'"), both.filter("lang = 'bn'"))


# --- query processing over all distinct query texts

_TEXTS = "SELECT min(search_id) AS query_id, query AS text FROM hybrid_results_labse WHERE query IS NOT NULL GROUP BY query"


def texts(spark, d):
    return table(spark, d, "hybrid_results_labse").filter("query is not null").groupBy(F.col("query").alias("text")).agg(F.min("search_id").alias("query_id")).select("query_id", "text")


#: Query texts that do name entities: of the records whose number is divisible by 20 the name among other words, of those 10 further on the name alone.
_NUMBER = "substring(entity_id, 2)::BIGINT"
_NAMED = f"""SELECT * FROM ({_TEXTS}) UNION ALL SELECT 1000000000 + {_NUMBER}, 'news of ' || coalesce(canonical_en, canonical_bn) || ' today' FROM entity_records WHERE {_NUMBER} % 20 = 0 AND coalesce(canonical_en, canonical_bn) IS NOT NULL
    UNION ALL SELECT 1000000000 + {_NUMBER}, coalesce(canonical_bn, canonical_en) FROM entity_records WHERE {_NUMBER} % 20 = 10 AND coalesce(canonical_bn, canonical_en) IS NOT NULL"""


def named_texts(spark, d):
    r = table(spark, d, "entity_records").withColumn("n", F.substring("entity_id", 2, 20).cast("long")).withColumn("query_id", F.lit(1000000000).cast("long") + F.col("n"))
    inside = r.filter("n % 20 = 0").select("query_id", F.concat(F.lit("news of "), F.coalesce("canonical_en", "canonical_bn"), F.lit(" today")).alias("text"))
    alone = r.filter("n % 20 = 10").select("query_id", F.coalesce("canonical_bn", "canonical_en").alias("text"))
    return texts(spark, d).unionByName(inside.filter("text is not null")).unionByName(alone.filter("text is not null"))


_BN = f"(CASE WHEN length(text) = 0 THEN 0.0 ELSE length(regexp_replace(text, '[^\\x{{0980}}-\\x{{09FF}}]', '', 'g'))::DOUBLE / length(text) END)"
_EN = "(CASE WHEN length(text) = 0 THEN 0.0 ELSE length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::DOUBLE / length(text) END)"
_LANG = f"(CASE WHEN {S.strip('text')} = '' THEN 'unknown' WHEN {_BN} > 0.3 THEN 'bn' ELSE 'en' END)"


@R.add(f"SELECT query_id, {S.collapse('text')} AS normalized FROM ({_TEXTS})")
def query_normalize(spark, d):
    return texts(spark, d).select("query_id", querying.normalize_query(F.col("text")).alias("normalized"))


@R.add(f"SELECT query_id, {_LANG} AS language FROM ({_TEXTS})")
def detect_lang(spark, d):
    return texts(spark, d).select("query_id", T.detect_lang(F.col("text")).alias("language"))


@R.add(f"SELECT query_id, {_BN} > 0.1 AND {_EN} > 0.1 AS mixed FROM ({_TEXTS})")
def is_mixed(spark, d):
    return texts(spark, d).select("query_id", T.is_mixed(F.col("text")).alias("mixed"))


_LOOK = """SELECT name, max(entity_id) AS entity_id FROM (SELECT entity_id, lower(canonical_en) AS name FROM entity_records UNION ALL SELECT entity_id, canonical_bn FROM entity_records
    UNION ALL SELECT entity_id, lower(a) FROM (SELECT entity_id, unnest(aliases) AS a FROM entity_records)) WHERE name IS NOT NULL AND name <> '' GROUP BY name"""


@R.add(_LOOK)
def entity_lookup(spark, d):
    return querying.name_lookup(table(spark, d, "entity_records"))


_WIN = f"""SELECT query_id, pos, size, CASE WHEN lang = 'bn' THEN surface ELSE lower(surface) END AS phrase, lang FROM (SELECT query_id, lang, size, pos, array_to_string(w[pos : pos + size - 1], ' ') AS surface
    FROM (SELECT query_id, {S.words('text')} AS w, {_LANG} AS lang FROM ({_NAMED})), (SELECT unnest([1, 2, 3, 4]) AS size), (SELECT unnest(range(1, 60)) AS pos) WHERE pos + size - 1 <= len(w))"""
_HIT = f"SELECT query_id, pos::BIGINT AS pos, size::BIGINT AS size, phrase, entity_id, lang FROM ({_WIN}) JOIN ({_LOOK}) l ON phrase = l.name"


@R.add(f"SELECT query_id, pos, size, phrase, entity_id FROM ({_HIT})")
def window_entity_match(spark, d):
    return querying.match_entities(named_texts(spark, d), querying.name_lookup(table(spark, d, "entity_records"))).select("query_id", "pos", "size", "phrase", "entity_id")


_PIN = f"SELECT DISTINCT query_id, phrase, CASE WHEN lang = 'bn' THEN canonical_en ELSE canonical_bn END AS target FROM ({_HIT}) h JOIN entity_records r USING (entity_id) WHERE CASE WHEN lang = 'bn' THEN canonical_en ELSE canonical_bn END IS NOT NULL"


@R.add(_PIN)
def pinned_terms(spark, d):
    return querying.pinned(named_texts(spark, d), table(spark, d, "entity_records"))


_DICT = "SELECT lower(query) AS phrase, min(translated) AS target FROM hybrid_results_labse WHERE query IS NOT NULL AND translated IS NOT NULL GROUP BY lower(query)"
_TRANS = f"SELECT t.query_id, coalesce(p.pin, x.target, t.text) AS translated FROM ({_NAMED}) t LEFT JOIN (SELECT query_id, lower(phrase) AS whole, min(target) AS pin FROM ({_PIN}) GROUP BY ALL) p ON t.query_id = p.query_id AND p.whole = lower({S.collapse('t.text')}) LEFT JOIN ({_DICT}) x ON x.phrase = lower({S.collapse('t.text')})"


def _dictionary(spark, d):
    rows = table(spark, d, "hybrid_results_labse").filter("query is not null and translated is not null")
    return rows.groupBy(F.lower("query").alias("phrase")).agg(F.min("translated").alias("target"))


@R.add(_TRANS)
def translate_pinned(spark, d):
    return querying.translate(named_texts(spark, d), pinned_terms(spark, d), _dictionary(spark, d))


@R.add(f"SELECT t.query_id, text AS original, {_LANG} AS language, CASE WHEN {_LANG} = 'bn' THEN 'en' ELSE 'bn' END AS target, {S.collapse('text')} AS normalized, {_BN} > 0.1 AND {_EN} > 0.1 AS is_mixed, translated FROM ({_NAMED}) t JOIN ({_TRANS}) x USING (query_id)")
def query_process(spark, d):
    return querying.process(named_texts(spark, d), pinned_terms(spark, d), _dictionary(spark, d))


# --- evaluation over all searches

def _metrics_sql(col: str) -> str:
    return f"""SELECT r.query_id, round(count(*) FILTER (WHERE rank <= 10 AND g.doc_id IS NOT NULL) / 10.0, 6) AS precision_at_10, round(coalesce(count(g.doc_id) / nullif(max(n_rel), 0)::DOUBLE, 0), 6) AS recall_at_50,
    round(CASE WHEN coalesce(max(n_rel), 0) > 0 THEN coalesce(sum(CASE WHEN rank <= 10 AND g.doc_id IS NOT NULL THEN 1 / log2(rank + 1) END), 0) / list_sum(list_transform(range(1, least(10, max(n_rel)) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg_at_10,
    round(coalesce(1.0 / min(CASE WHEN g.doc_id IS NOT NULL THEN rank END), 0), 6) AS mrr FROM ({_run_sql(col)}) r LEFT JOIN ({S.RELEVANT}) g ON r.query_id = g.query_id AND r.doc_id = g.doc_id LEFT JOIN (SELECT query_id, count(*) AS n_rel FROM ({S.RELEVANT}) GROUP BY query_id) s ON r.query_id = s.query_id GROUP BY r.query_id"""


def _metrics(spark, d, col="bm25"):
    return evaluation.metrics(_run(spark, d, col, 50), relevant(spark, d))


@R.add(f"SELECT query_id, precision_at_10 FROM ({_metrics_sql('bm25')})")
def precision_at_k(spark, d):
    return _metrics(spark, d).select("query_id", "precision_at_10")


@R.add(f"SELECT query_id, recall_at_50 FROM ({_metrics_sql('bm25')})")
def recall_at_k(spark, d):
    return _metrics(spark, d).select("query_id", "recall_at_50")


@R.add(f"SELECT query_id, ndcg_at_10 FROM ({_metrics_sql('bm25')})")
def ndcg_at_k(spark, d):
    return _metrics(spark, d).select("query_id", "ndcg_at_10")


@R.add(f"SELECT query_id, mrr FROM ({_metrics_sql('bm25')})")
def mrr(spark, d):
    return _metrics(spark, d).select("query_id", "mrr")


METHODS = ("bm25", "fuzzy", "semantic")
_ALL = " UNION ALL ".join(f"SELECT '{m}' AS method, * FROM ({_metrics_sql(m)})" for m in METHODS)
_MEAN = f"SELECT method, round(avg(precision_at_10), 6) AS precision_at_10, round(avg(recall_at_50), 6) AS recall_at_50, round(avg(ndcg_at_10), 6) AS ndcg_at_10, round(avg(mrr), 6) AS mrr FROM ({_ALL}) GROUP BY method"


@R.add(_ALL)
def evaluate_methods(spark, d):
    """All methods in one job: runs carry the method in their query key.  Relevance is the stand-in of ``relevant``."""
    h = hits(spark, d)
    long = h.select("query_id", "doc_id", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("score")) for m in METHODS])).alias("x")).select("query_id", "doc_id", "x.method", "x.score").filter("score is not null")
    keyed = long.withColumn("key", F.struct("method", "query_id"))
    rel = relevant(spark, d).withColumn("method", F.explode(F.array(*map(F.lit, METHODS)))).select(F.struct("method", "query_id").alias("key"), "doc_id")
    out = evaluation.metrics(lexical.top_k(keyed.select("key", "doc_id", "score"), 50, "key"), rel, "key")
    return out.select("key.method", "key.query_id", "precision_at_10", "recall_at_50", "ndcg_at_10", "mrr")


@R.add(_MEAN)
def eval_macro_avg(spark, d):
    e = evaluate_methods(spark, d)
    return e.groupBy("method").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("precision_at_10", "recall_at_50", "ndcg_at_10", "mrr")])


@R.add(f"SELECT method, (precision_at_10 >= 0.6)::BIGINT + (recall_at_50 >= 0.5)::BIGINT + (ndcg_at_10 >= 0.5)::BIGINT + (mrr >= 0.4)::BIGINT AS targets_met FROM ({_MEAN})")
def targets_met(spark, d):
    met = sum((F.col(c) >= t).cast("long") for c, t in evaluation.TARGETS.items())
    return eval_macro_avg(spark, d).select("method", met.alias("targets_met"))


@R.add(f"SELECT arg_max(method, (precision_at_10, method)) AS best_precision, arg_max(method, (recall_at_50, method)) AS best_recall, arg_max(method, (ndcg_at_10, method)) AS best_ndcg, arg_max(method, (mrr, method)) AS best_mrr FROM ({_MEAN})")
def best_method(spark, d):
    pick = lambda c: F.max_by("method", F.struct(c, "method"))
    return eval_macro_avg(spark, d).agg(pick("precision_at_10").alias("best_precision"), pick("recall_at_50").alias("best_recall"), pick("ndcg_at_10").alias("best_ndcg"), pick("mrr").alias("best_mrr"))


@R.add(f"""WITH g AS ({_run_sql('bm25', 10)}), r AS ({S.RELEVANT}), c AS (SELECT coalesce(g.query_id, r.query_id) AS query_id, count(*) FILTER (WHERE g.doc_id IS NOT NULL AND r.doc_id IS NOT NULL) AS tp, count(*) FILTER (WHERE r.doc_id IS NULL) AS fp, count(*) FILTER (WHERE g.doc_id IS NULL) AS fn
    FROM g FULL JOIN r ON g.query_id = r.query_id AND g.doc_id = r.doc_id GROUP BY 1), n AS (SELECT count(*) AS n FROM articles), m AS (SELECT *, n - tp - fp - fn AS tn, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS p, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS q FROM c, n)
    SELECT query_id, tp, fp, fn, tn, round(p, 6) AS precision, round(q, 6) AS recall, round(coalesce(2 * p * q / nullif(p + q, 0), 0), 6) AS f1, round((tp + tn) / n::DOUBLE, 6) AS accuracy FROM m""")
def confusion_matrix(spark, d):
    return evaluation.confusion(_run(spark, d, "bm25", 10), relevant(spark, d), corpus(spark, d).agg(F.count(F.lit(1)).alias("n")))


@R.add(f"""WITH k AS (SELECT unnest([5, 10, 20]) AS k), r AS ({_run_sql('bm25')}), g AS ({S.RELEVANT}), s AS (SELECT query_id, count(*) AS n_rel FROM g GROUP BY query_id), h AS (SELECT r.query_id, k, count(*) FILTER (WHERE rank <= k AND g.doc_id IS NOT NULL) AS hits FROM r CROSS JOIN k LEFT JOIN g ON r.query_id = g.query_id AND r.doc_id = g.doc_id GROUP BY ALL),
    m AS (SELECT h.query_id, k, hits / k::DOUBLE AS p, coalesce(hits / nullif(n_rel, 0)::DOUBLE, 0) AS q FROM h LEFT JOIN s ON h.query_id = s.query_id) SELECT query_id, k::BIGINT AS k, round(p, 6) AS precision, round(q, 6) AS recall, round(coalesce(2 * p * q / nullif(p + q, 0), 0), 6) AS f1 FROM m""")
def prf_at_ks(spark, d):
    return evaluation.prf_at_ks(_run(spark, d, "bm25", 50), relevant(spark, d), [5, 10, 20])


@R.add("SELECT matcher, round(avg(matched::INT), 6) AS relevant_rate, count(*) AS n, count_if(matched) AS relevant_rows FROM entity_matches GROUP BY matcher")
def engine_relevance(spark, d):
    """Share of accepted results a matcher; null judgements count as rows without a vote."""
    m = table(spark, d, "entity_matches")
    return m.groupBy("matcher").agg(F.round(F.avg(F.col("matched").cast("int")), 6).alias("relevant_rate"), F.count(F.lit(1)).alias("n"), F.count_if("matched").alias("relevant_rows"))


@R.add("SELECT lang, count(*) AS n, count_if(bm25 IS NOT NULL) AS with_bm25, count_if(fuzzy IS NOT NULL) AS with_fuzzy, count_if(title IS NOT NULL) AS with_title FROM hybrid_results_labse GROUP BY lang")
def engine_coverage(spark, d):
    h = table(spark, d, "hybrid_results_labse")
    return h.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("bm25").alias("with_bm25"), F.count("fuzzy").alias("with_fuzzy"), F.count("title").alias("with_title"))


@R.add(f"SELECT round(avg(p), 6) AS mean_precision FROM (SELECT r.query_id, count(g.doc_id) / count(*)::DOUBLE AS p FROM ({_run_sql('semantic', 5)}) r LEFT JOIN ({S.RELEVANT}) g ON r.query_id = g.query_id AND r.doc_id = g.doc_id GROUP BY r.query_id)")
def engine_precision(spark, d):
    """Mean over queries of relevant rows over rows found in the top five."""
    rows = evaluation.judged(_run(spark, d, "semantic", 5), relevant(spark, d))
    return rows.groupBy("query_id").agg(F.avg("rel").alias("p")).agg(F.round(F.avg("p"), 6).alias("mean_precision"))


@R.add("SELECT lang, round(min(time_ms), 6) AS fastest, round(avg(time_ms), 6) AS mean_ms, round(max(time_ms), 6) AS slowest FROM hybrid_results_labse GROUP BY lang")
def latency_by_lang(spark, d):
    h = table(spark, d, "hybrid_results_labse")
    return h.groupBy("lang").agg(F.round(F.min("time_ms"), 6).alias("fastest"), F.round(F.avg("time_ms"), 6).alias("mean_ms"), F.round(F.max("time_ms"), 6).alias("slowest"))


# A choice of this library: a keyword judge's rules over this corpus' topics (strong, weak).
JUDGE = {"pension backlog": (["pension"], ["workers", "taka"]), "vaccine register": (["vaccine"], ["hospital"]), "night market permit": (["night market"], ["traders"]), "district budget": (["budget"], ["taka"])}
_JUDGE = ", ".join("('{}', {}, {})".format(q, strong, weak) for q, (strong, weak) in JUDGE.items())


@R.add(f"""SELECT j.query, article_id AS doc_id, (CASE WHEN list_bool_or(list_transform(strong, lambda k: contains(hay, k))) THEN 2 WHEN list_bool_or(list_transform(weak, lambda k: contains(hay, k))) THEN 1 ELSE 0 END)::BIGINT AS grade
    FROM (SELECT article_id, coalesce(lower(title), '') || chr(10) || coalesce(lower(body), '') AS hay FROM articles), (VALUES {_JUDGE}) j(query, strong, weak)""")
def judge_keywords(spark, d):
    rules = spark.createDataFrame([(q, s, w) for q, (s, w) in JUDGE.items()], "query string, strong array<string>, weak array<string>")
    docs = corpus(spark, d).select(F.col("article_id").alias("doc_id"), "title", "body", F.explode(F.array(*map(F.lit, JUDGE))).alias("query"))
    return evaluation.judge_keywords(docs, rules)


QUERIES, ORACLE = R.queries, R.oracle
