"""Curation queries: cleaning, validation, duplicates, statistics, extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondhan.functions import text as T
from sondhan.operators import cleaning, dedup, greedy, stats
from sondhan.plans import sql as S
from sondhan.session import scratch, spread, table
from sondhan.sources import files, html

R = S.Registry()


def _articles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles")


def _rules_sql(x: str, source: str) -> str:
    own = x
    cases = ""
    for name, patterns in cleaning.SOURCE_RULES.items():
        cleaned = x
        for p in patterns:
            cleaned = f"regexp_replace({cleaned}, '(?ims){p}', '', 'g')"
        names = [name, *[a for a, n in cleaning.SOURCE_ALIASES.items() if n == name]]
        cases += " WHEN {} IN ({}) THEN {}".format(source, ", ".join(f"'{n}'" for n in names), cleaned)
    own = f"(CASE{cases} ELSE {x} END)"
    for p in cleaning.COMMON_RULES:
        own = f"regexp_replace({own}, '(?im){p}', '', 'g')"
    return own


def _ws_sql(x: str) -> str:
    for pattern, to in (("\\n{3,}", "chr(10)||chr(10)"), ("\\t", "' '"), (" {2,}", "' '"), (" *\\n *", "chr(10)"), ("\\r", "''")):
        x = f"regexp_replace({x}, '{pattern}', {to}, 'g')"
    return x


CLEAN = S.strip(_ws_sql(_rules_sql("coalesce(body, '')", "coalesce(source, '')")))
TITLE = S.strip(f"regexp_replace({S.collapse('coalesce(title, chr(32))')}, '^(?i)(?:BREAKING|UPDATE|EXCLUSIVE):\\s*', '')")
_D = S.strip("date")
DATE = f"""(SELECT strftime(coalesce(
    CASE WHEN regexp_full_match(d, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN try_strptime(d, '%Y-%m-%d') END, CASE WHEN regexp_full_match(d, '\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}') THEN try_strptime(d, '%d-%m-%Y') END,
    CASE WHEN regexp_full_match(d, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') THEN try_strptime(d, '%d/%m/%Y') END, CASE WHEN regexp_full_match(d, '[A-Za-z]{{4,9}} +\\d{{1,2}}, \\d{{4}}') THEN try_strptime(d, '%B %d, %Y') END,
    CASE WHEN regexp_full_match(d, '[A-Za-z]{{3}} +\\d{{1,2}}, \\d{{4}}') THEN try_strptime(d, '%b %d, %Y') END, CASE WHEN regexp_full_match(d, '\\d{{4}}/\\d{{1,2}}/\\d{{1,2}}') THEN try_strptime(d, '%Y/%m/%d') END,
    CASE WHEN regexp_matches(d, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}T') THEN try_strptime(split_part(d, 'T', 1), '%Y-%m-%d') END), '%Y-%m-%d') FROM (SELECT {_D} AS d))"""


def _count(x: str) -> str:
    return f"len({S.words(x)})"


def _reason(url: str, title: str, body: str) -> str:
    return f"CASE WHEN coalesce({url}, '') = '' THEN 'no_url' WHEN coalesce({title}, '') = '' OR coalesce({body}, '') = '' THEN 'empty' WHEN {_count(body)} < 50 THEN 'short' END"


CLEANED = f"SELECT article_id, url, {TITLE} AS title, {CLEAN} AS body, coalesce({DATE}, date) AS date, language, source, tokens AS raw_tokens, crawled_at FROM articles"


@R.add(f"SELECT article_id, {_ws_sql('body')} AS body FROM articles")
def normalize_ws(spark, d):
    return _articles(spark, d).select("article_id", cleaning.normalize_ws(F.col("body")).alias("body"))


@R.add(f"SELECT article_id, {CLEAN} AS body FROM articles")
def clean_text(spark, d):
    return _articles(spark, d).select("article_id", cleaning.clean_text(F.col("body"), F.col("source")).alias("body"))


@R.add(f"SELECT article_id, {TITLE} AS title FROM articles")
def clean_title(spark, d):
    return _articles(spark, d).select("article_id", cleaning.clean_title(F.col("title")).alias("title"))


@R.add(f"SELECT article_id, {DATE} AS day FROM articles")
def normalize_date(spark, d):
    return _articles(spark, d).select("article_id", cleaning.normalize_date(F.col("date")).alias("day"))


@R.add(f"SELECT article_id, {_count('body')} AS tokens FROM articles")
def token_count(spark, d):
    return _articles(spark, d).select("article_id", T.token_count(F.col("body")).alias("tokens"))


@R.add(f"SELECT article_id, title, body, date, {_count('body')} AS tokens FROM ({CLEANED})")
def clean_article(spark, d):
    return cleaning.clean_articles(spread(_articles(spark, d))).select("article_id", "title", "body", "date", "tokens")


@R.add(f"SELECT article_id, coalesce({_reason('url', 'title', 'body')}, 'kept') AS reason FROM ({CLEANED})")
def validate_reasons(spark, d):
    c = cleaning.clean_articles(_articles(spark, d))
    return c.select("article_id", F.coalesce(cleaning.reject_reason(F.col("url"), F.col("title"), F.col("body")), F.lit("kept")).alias("reason"))


@R.add(f"SELECT reason, count(*) AS n FROM (SELECT coalesce({_reason('url', 'title', 'body')}, 'kept') AS reason FROM ({CLEANED})) GROUP BY reason")
def removal_counts(spark, d):
    return validate_reasons(spark, d).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@R.add("""SELECT language, source, grouping(language, source)::BIGINT AS grouping, count(*) AS articles, coalesce(sum(tokens), 0)::BIGINT AS tokens_sum, min(tokens)::BIGINT AS tokens_min, max(tokens)::BIGINT AS tokens_max,
    round(avg(tokens), 6) AS tokens_avg, min(nullif(date, '')) AS date_min, max(nullif(date, '')) AS date_max FROM articles GROUP BY GROUPING SETS ((language), (source), (language, source), ())""")
def corpus_stats(spark, d):
    return stats.corpus_stats(_articles(spark, d))


@R.add(f"""WITH c AS ({CLEANED}), k AS (SELECT *, {_count('body')} AS t FROM c), v AS (SELECT count(*) AS after, sum(t) AS tokens_after FROM k WHERE ({_reason('url', 'title', 'body')}) IS NULL),
    b AS (SELECT count(*) AS before, sum({_count('body')}) AS tokens_before FROM articles)
    SELECT before, after, before - after AS removed, round(CASE WHEN before = 0 THEN 0 ELSE 100.0 * after / before END, 6) AS retention, tokens_before::BIGINT AS tokens_before, tokens_after::BIGINT AS tokens_after FROM b, v""")
def quality_metrics(spark, d):
    raw = _articles(spark, d)
    kept = F.col("__reason").isNull()
    c = cleaning.clean_articles(raw.withColumn("__raw", T.token_count(F.col("body"))))
    c = c.withColumn("__reason", cleaning.reject_reason(F.col("url"), F.col("title"), F.col("body")))
    out = c.agg(F.count(F.lit(1)).alias("before"), F.count_if(kept).alias("after"), F.sum("__raw").alias("tokens_before"), F.sum(F.when(kept, F.col("tokens"))).alias("tokens_after"))
    share = F.coalesce(F.try_divide(F.lit(100.0) * F.col("after"), F.col("before")), F.lit(0.0))
    return out.select("before", "after", (F.col("before") - F.col("after")).alias("removed"), F.round(share, 6).alias("retention"), "tokens_before", "tokens_after")


@R.add("SELECT source, count(*) AS n, arg_min(url, article_id) AS sample FROM articles GROUP BY source")
def count_with_sample(spark, d):
    return stats.count_with_sample(_articles(spark, d), "source", "url", "article_id")


URL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(url, '')), '^https?://', ''), '^www\\.', ''), '/+$', ''), '\\?.*$', '')"


@R.add(f"SELECT article_id, {URL} AS nurl FROM articles")
def url_normalize(spark, d):
    return _articles(spark, d).select("article_id", dedup.normalize_url(F.col("url")).alias("nurl"))


_DEDUP = f"""SELECT nurl, article_id FROM (SELECT *, row_number() OVER (PARTITION BY nurl ORDER BY coalesce(try_cast(crawled_at AS TIMESTAMP), TIMESTAMP '0001-01-01') DESC, article_id) AS rn
    FROM (SELECT article_id, crawled_at, {URL} AS nurl FROM articles) WHERE nurl <> '') WHERE rn = 1"""


@R.add(_DEDUP)
def dedup_url(spark, d):
    rows = _articles(spark, d).select("article_id", "url", "crawled_at")
    return dedup.dedup_url(rows, "url", "crawled_at", "article_id").select("nurl", "article_id")


@R.add(f"SELECT nurl, article_id FROM (SELECT *, row_number() OVER (PARTITION BY nurl ORDER BY coalesce(tokens, 0) DESC, article_id) AS rn FROM (SELECT article_id, tokens, {URL} AS nurl FROM articles) WHERE nurl <> '') WHERE rn = 1")
def dedup_url_longest(spark, d):
    return dedup.dedup_longest(_articles(spark, d).select("article_id", "url", "tokens"), "url", "tokens", "article_id").select("nurl", "article_id")


@R.add(f"SELECT (SELECT count(*) FROM articles) AS total, (SELECT count(*) FROM ({_DEDUP})) AS kept, (SELECT count(*) FROM articles WHERE {URL} <> '') - (SELECT count(*) FROM ({_DEDUP})) AS url_duplicates")
def dedup_stats(spark, d):
    rows = _articles(spark, d).select(dedup.normalize_url(F.col("url")).alias("nurl"))
    per = rows.groupBy("nurl").agg(F.count(F.lit(1)).alias("n"))
    named = F.when(F.col("nurl") != "", F.col("n")).otherwise(0)
    return per.agg(F.sum("n").alias("total"), F.count_if(F.col("nurl") != "").alias("kept"), (F.sum(named) - F.count_if(F.col("nurl") != "")).alias("url_duplicates"))


@R.add(f"SELECT nurl, min(article_id) AS first_seq FROM (SELECT article_id, {URL} AS nurl FROM articles) WHERE nurl <> '' GROUP BY nurl")
def distinct_first(spark, d):
    return dedup.first_of(url_normalize(spark, d).filter("nurl <> ''"), "nurl", "article_id")


@R.add(f"SELECT doc_id, list_sort({S.shingles('text', 3)}) AS shingles FROM documents")
def shingles(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_sort(T.shingles(F.col("text"), 3)).alias("shingles"))


_SPLIT = "SELECT article_id, source, language, {t} AS ts, {b} AS bs FROM articles".format(t=S.shingles("title", 2), b=S.shingles("body", 3))
_PAIRS = f"""WITH s AS MATERIALIZED ({_SPLIT}), p AS (SELECT x.article_id AS a, y.article_id AS b, {S.jaccard('x.ts', 'y.ts')} AS tj, x.bs AS xb, y.bs AS yb FROM s x JOIN s y ON x.source IS NOT DISTINCT FROM y.source AND x.language IS NOT DISTINCT FROM y.language AND x.article_id < y.article_id
    WHERE len(x.ts) > 0 AND len(y.ts) > 0 AND len(x.bs) > 0 AND len(y.bs) > 0 AND 0.85 * greatest(len(x.bs), len(y.bs)) <= least(len(x.bs), len(y.bs)) + 1e-9)
    SELECT a, b, round(tj, 6) AS title_j, round({S.jaccard('xb', 'yb')}, 6) AS body_j FROM p WHERE tj >= 0.5 AND {S.jaccard('xb', 'yb')} >= 0.85"""


def _near(spark, d):
    return dedup.near_duplicates(spread(_articles(spark, d).select("article_id", "source", "language", "title", "body")), "article_id", ["source", "language"], "title", "body")


@R.add(_PAIRS)
def near_dup_pairs(spark, d):
    return _near(spark, d).select("a", "b", F.round("title_j", 6).alias("title_j"), F.round("body_j", 6).alias("body_j"))


@R.add(f"""SELECT x.entity_id AS a, y.entity_id AS b, round({S.jaccard('x.g', 'y.g')}, 6) AS j FROM (SELECT entity_id, list_distinct({S.trigrams('lower(canonical_en)')}) AS g FROM entity_records WHERE canonical_en IS NOT NULL) x
    JOIN (SELECT entity_id, list_distinct({S.trigrams('lower(canonical_en)')}) AS g FROM entity_records WHERE canonical_en IS NOT NULL) y ON x.entity_id < y.entity_id WHERE {S.jaccard('x.g', 'y.g')} >= 0.8""")
def jaccard_pairs(spark, d):
    """English canonical names whose trigram sets have a Jaccard index of 0.8 or more, met on their rarest trigrams."""
    names = table(spark, d, "entity_records").filter("canonical_en is not null").select("entity_id", F.array_distinct(T.trigrams(F.col("canonical_en"))).alias("s")).withColumn("m", F.size("s"))
    grams = names.select("entity_id", "m", F.explode("s").alias("g"))
    rare = grams.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    ranked = grams.join(rare, "g").groupBy("entity_id", "m").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("gs"))
    head = (F.col("m") - F.ceil(0.8 * F.col("m") - 1e-9) + 1).cast("int")
    heads = ranked.select(F.col("entity_id").alias("a"), "m", F.explode(F.slice("gs", 1, head)).alias("x")).select("a", "m", F.col("x.g").alias("g"))
    met = heads.join(heads.select(F.col("a").alias("b"), F.col("m").alias("m2"), "g"), "g").filter("a < b and least(m, m2) >= 0.8 * greatest(m, m2) - 1e-9").select("a", "b").distinct()
    sets = names.select("entity_id", "s")
    both = met.join(sets.select(F.col("entity_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("entity_id").alias("b"), F.col("s").alias("sb")), "b")
    j = T.jaccard(F.col("sa"), F.col("sb"))
    return both.filter(j >= 0.8).select("a", "b", F.round(j, 6).alias("j"))


_LOSER = f"""SELECT p.a, p.b, CASE WHEN x.t IS NOT NULL AND y.t IS NOT NULL THEN CASE WHEN x.t < y.t THEN p.a ELSE p.b END WHEN x.t IS NOT NULL THEN p.b WHEN y.t IS NOT NULL THEN p.a WHEN x.n < y.n THEN p.a ELSE p.b END AS loser
    FROM ({_PAIRS}) p JOIN (SELECT article_id, try_cast(crawled_at AS TIMESTAMP) AS t, coalesce(tokens, 0) AS n FROM articles) x ON p.a = x.article_id
    JOIN (SELECT article_id, try_cast(crawled_at AS TIMESTAMP) AS t, coalesce(tokens, 0) AS n FROM articles) y ON p.b = y.article_id"""


@R.add(_LOSER)
def dup_loser(spark, d):
    dates = _articles(spark, d).select("article_id", F.expr("try_cast(crawled_at as timestamp_ntz)").alias("t"), F.coalesce("tokens", F.lit(0)).alias("n"))
    x, y = dates.toDF("a", "ta", "na"), dates.toDF("b", "tb", "nb")
    pairs = _near(spark, d).select("a", "b").join(x, "a").join(y, "b")
    return pairs.select("a", "b", dedup.duplicate_loser(F.col("ta"), F.col("tb"), F.col("na"), F.col("nb"), F.col("a"), F.col("b")).alias("loser"))


@R.add(f"""WITH p AS ({_PAIRS}), e AS (SELECT a AS k, title_j = 1 AND body_j = 1 AS same FROM p UNION ALL SELECT b, title_j = 1 AND body_j = 1 FROM p)
    SELECT s.article_id, 1 + count_if(coalesce(e.same, false)) AS copies, count(e.k) AS links FROM ({_SPLIT}) s LEFT JOIN e ON e.k = s.article_id WHERE len(s.ts) > 0 AND len(s.bs) > 0 GROUP BY s.article_id""")
def near_dup_classes(spark, d):
    """One row an article: how many articles are the same, and how many it is linked to."""
    sets = dedup.near_sets(spread(_articles(spark, d).select("article_id", "source", "language", "title", "body")), "article_id", ["source", "language"], "title", "body")
    return dedup.near_classes(sets, dedup.near_class_pairs(sets, ["source", "language"])).select(F.col("k").alias("article_id"), "copies", "links")


@R.add()
def dedup_removed(spark, d):
    """Rows that both kinds of duplicates take away, of all articles."""
    u = dedup_stats(spark, d).select("total", "url_duplicates")
    c = dedup_content(spark, d).agg(F.count(F.lit(1)).alias("content_duplicates"))
    return u.crossJoin(F.broadcast(c)).withColumn("total_removed", F.col("url_duplicates") + F.col("content_duplicates"))


@R.add()
def dedup_content(spark, d):
    """Articles that the greedy scan of each block removes."""
    return greedy.scan_losers(dup_loser(spark, d)).withColumnRenamed("loser", "article_id")


@R.add("SELECT article_id, language, CASE WHEN regexp_matches(substring(coalesce(body, ''), 1, 200), '" + S.BENGALI + "') THEN 'bn' ELSE 'en' END AS script FROM articles")
def script_lang(spark, d):
    return _articles(spark, d).select("article_id", "language", T.script_lang(F.col("body")).alias("script"))


@R.add("SELECT article_id, source, language FROM articles WHERE language IN ('en', 'bn')")
def split_by_lang(spark, d):
    """The two corpora; ``write_by_language`` puts each into a folder of its own."""
    return _articles(spark, d).filter("language in ('en', 'bn')").select("article_id", "source", "language")


@R.add("SELECT article_id, url, tokens FROM articles ORDER BY article_id LIMIT 100")
def scan_limit(spark, d):
    return _articles(spark, d).select("article_id", "url", "tokens").orderBy("article_id").limit(100)


@R.add("SELECT article_id, url FROM (SELECT *, row_number() OVER (ORDER BY article_id) AS rn, greatest(1, (SELECT count(*) FROM articles) // 100) AS stride FROM articles) WHERE (rn - 1) % stride = 0 ORDER BY article_id LIMIT 100")
def stride_sample(spark, d):
    return files.systematic_sample(_articles(spark, d).select("article_id", "url"), "article_id", 100)


@R.add("SELECT source, category, article_id FROM (SELECT *, row_number() OVER (PARTITION BY source, category ORDER BY article_id) AS rn FROM articles) WHERE rn <= 5")
def quota_per_group(spark, d):
    return dedup.quota(_articles(spark, d).select("source", "category", "article_id"), ["source", "category"], ["article_id"], 5).select("source", "category", "article_id")


@R.add("SELECT url, source, tokens, coalesce(len(tags), -1)::INT AS n_tags FROM articles")
def scan_jsonl(spark, d):
    """The articles written as JSON lines beside a broken line, and read again by the lenient reader."""
    folder = scratch(spark)
    _articles(spark, d).select(*[f.name for f in files.ARTICLE.fields]).write.option("ignoreNullFields", False).json(f"{folder}/good")
    spark.createDataFrame([('{"url": "broken',), ("",)], "value string").coalesce(1).write.text(f"{folder}/bad")
    return files.read_jsonl(spark, f"{folder}/*").select("url", "source", "tokens", F.when(F.col("tags").isNull(), -1).otherwise(F.size("tags")).alias("n_tags"))


# --- extraction from pages

_PAGES = f"SELECT article_id, url, source, {S.PAGE} AS html FROM articles"


def _pages(spark, d):
    return _articles(spark, d).select("article_id", "url", "source", F.expr(S.PAGE).alias("html"))


def _untag(x: str) -> str:
    x = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{ch}')"
    return x


@R.add(f"SELECT DISTINCT unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS url FROM ({_PAGES})")
def page_links(spark, d):
    return _pages(spark, d).select(F.explode(html.links(F.col("html"))).alias("url")).distinct()


@R.add(f"SELECT article_id, coalesce(nullif({S.collapse(_untag(chr(114) + 'egexp_extract(html, ' + chr(39) + '(?is)<h1[^>]*>(.*?)</h1>' + chr(39) + ', 1)'))}, ''), nullif(regexp_extract(html, '(?i)<meta property=\"og:title\" content=\"([^\"]*)\"', 1), '')) AS title FROM ({_PAGES})")
def page_title(spark, d):
    return _pages(spark, d).select("article_id", html.page_title(F.col("html")).alias("title"))


@R.add("SELECT article_id, regexp_replace(title, '\\s*\\|\\s*প্রথম আলো$', '') AS title FROM (SELECT article_id, CASE WHEN article_id % 2 = 0 THEN title || ' | প্রথম আলো' ELSE title END AS title FROM articles)")
def title_without_site(spark, d):
    """Titles, every other one with the suffix a site adds, without it."""
    title = F.when(F.col("article_id") % 2 == 0, F.concat("title", F.lit(" | প্রথম আলো"))).otherwise(F.col("title"))
    return _articles(spark, d).select("article_id", html.strip_site(title).alias("title"))


@R.add(f"""SELECT DISTINCT 'https://news.example/a/b.html' AS page, link FROM (SELECT unnest(['https://news.example' || p, 'https://news.example/a/x' || article_id || '.html']) AS link FROM (SELECT article_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '#.*$', '') AS p FROM articles WHERE url IS NOT NULL AND regexp_matches(url, '^[a-z]+://[^/]+/'))) WHERE NOT regexp_matches(lower(link), '{"|".join(html.SKIP_PARTS)}')""")
def discovered_links(spark, d):
    """Links of a page that holds the paths of all addresses in double quotes and a relative one in single quotes."""
    path = F.regexp_replace("url", "^[a-z]+://[^/]*", "")
    page = F.concat(F.lit('<p><a class=x href="'), path, F.lit("\">1</a> <A HREF='x"), F.col("article_id").cast("string"), F.lit(".html'>2</A><a href=\"#top\">3</a><a href=\"mailto:a@b.c\">4</a>"))
    rows = _articles(spark, d).filter(F.col("url").rlike("^[a-z]+://[^/]+/")).select(F.lit("https://news.example/a/b.html").alias("page_url"), page.alias("html"))
    return html.discover_links(rows, "page_url", "html").distinct()


_SECT = ", ".join(f"'{x}'" for x in html.SECTIONS)


@R.add(f"""SELECT article_id, CASE WHEN hit IS NULL THEN 'general' WHEN hit = 'news' AND pieces[list_position(pieces, hit) + 1] <> 'news' THEN pieces[list_position(pieces, hit) + 1] ELSE hit END AS category
    FROM (SELECT article_id, pieces, list_filter(pieces, lambda x: x IN ({_SECT}))[1] AS hit FROM (SELECT article_id, string_split(coalesce(url, ''), '/') AS pieces FROM articles))""")
def url_category_legacy(spark, d):
    return _articles(spark, d).select("article_id", html.legacy_category(F.col("url")).alias("category"))


@R.add(f"SELECT article_id, array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1), lambda p: {S.collapse(_untag('p'))}), lambda p: length(p) > 20), chr(10) || chr(10)) AS body FROM ({_PAGES})")
def page_body(spark, d):
    return _pages(spark, d).select("article_id", html.page_body(F.col("html")).alias("body"))


@R.add()
def page_body_rules(spark, d):
    """Bodies by the site rules and the tolerant parser."""
    return html.extract_bodies(_pages(spark, d), "article_id", "html", "source")


@R.add(f"SELECT article_id, coalesce(nullif(regexp_extract(html, '(?i)<time[^>]*datetime=\"([^\"]*)\"', 1), ''), 'x') AS date FROM ({_PAGES})")
def page_date(spark, d):
    return _pages(spark, d).select("article_id", html.page_date(F.col("html")).alias("date"))


@R.add(f"SELECT article_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<a [^>]*href=\"[^\"]*/(?:tags|topic)/[^\"]*\"[^>]*>(.*?)</a>', 1), lambda t: {S.collapse(_untag('t'))}), lambda t: t <> '')[1:10] AS tags FROM ({_PAGES})")
def page_tags(spark, d):
    return _pages(spark, d).select("article_id", html.page_tags(F.col("html")).alias("tags"))


_SKIP = "|".join(html.SKIP_PARTS)


@R.add(f"SELECT article_id, NOT regexp_matches(lower(coalesce(url, '')), '{_SKIP}') AS valid FROM articles")
def url_valid(spark, d):
    return _articles(spark, d).select("article_id", html.is_article_url(F.col("url")).alias("valid"))


_RULE_ROWS = ", ".join("('{}', '{}', '{}')".format(s, v, rule.replace("'", "''")) for (s, v), rule in html.LINK_RULES.items())


@R.add(f"""SELECT a.article_id, r.source AS site, r.variant, regexp_matches(a.url, r.rule) AND NOT (r.source = 'dhaka_tribune' AND contains(a.url, '/video/')) AND NOT (r.source = 'dhaka_post' AND length(a.url) <= 30) AS hit
    FROM articles a, (VALUES {_RULE_ROWS}) r(source, variant, rule) WHERE a.url IS NOT NULL""")
def url_rules(spark, d):
    """Every address against every site rule (the rules are a fixed table)."""
    rules = F.array(*[F.struct(F.lit(s).alias("site"), F.lit(v).alias("variant")) for s, v in html.LINK_RULES])
    rows = _articles(spark, d).filter("url is not null").select("article_id", "url", F.explode(rules).alias("r"))
    return rows.select("article_id", "r.site", "r.variant", html.matches_rule(F.col("url"), F.col("r.site"), F.col("r.variant")).alias("hit"))


@R.add("SELECT article_id, regexp_extract(regexp_replace(coalesce(url, ''), '^[a-z]+://[^/]*/?', ''), '^([^/?#]*)', 1) AS category FROM articles")
def url_category(spark, d):
    return _articles(spark, d).select("article_id", html.url_category(F.col("url")).alias("category"))


@R.add("SELECT article_id, length(coalesce(body, '')) > 100 AND coalesce(url, '') <> '' AND coalesce(title, '') <> '' AS valid FROM articles")
def article_valid(spark, d):
    a = _articles(spark, d)
    return a.select("article_id", ((F.length(T.or_empty(F.col("body"))) > 100) & (T.or_empty(F.col("url")) != "") & (T.or_empty(F.col("title")) != "")).alias("valid"))


@R.add("SELECT DISTINCT url FROM articles WHERE regexp_matches(url, '-\\d+$')")
def sitemap_urls(spark, d):
    """Addresses of sitemap documents, one a source, rebuilt from the articles."""
    loc = F.concat(F.lit("<url><loc>"), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    xml = _articles(spark, d).filter("url is not null").select(F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), loc, F.lit("</urlset>")).alias("xml"))
    return html.sitemap_urls(xml, "xml")


@R.add(f"SELECT DISTINCT url FROM articles WHERE url IS NOT NULL AND NOT regexp_matches(lower(url), '{_SKIP}')")
def feed_links(spark, d):
    link = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><link href="'), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit('"/></entry></feed>'))
    return html.feed_links(_articles(spark, d).filter("url is not null").select(link.alias("xml")), "xml")


@R.add("SELECT source, strftime(CAST('2026-01-31' AS DATE) - CAST(n AS INTEGER), '%Y-%m-%d') AS day FROM sources, (SELECT unnest(range(0, 30)) AS n)")
def date_spine(spark, d):
    """The archive pages to read: one a source and day, thirty days back from a fixed day."""
    day = F.explode(F.sequence(F.date_sub(F.lit("2026-01-31").cast("date"), 29), F.lit("2026-01-31").cast("date"), F.expr("interval 1 day")))
    return table(spark, d, "sources").select("source", day.alias("day")).select("source", F.date_format("day", "yyyy-MM-dd").alias("day"))


@R.add("SELECT article_id, title AS headline, url, length(regexp_replace(body, '[<>]', '', 'g')) AS n_body FROM (SELECT article_id, title, url, trim(coalesce(body, '')) AS body FROM articles) WHERE length(body) >= 120")
def nested_json_flatten(spark, d):
    """Stories of the paged API's nested JSON, rebuilt from the articles."""
    element = F.struct(F.lit("text").alias("type"), F.concat(F.lit("<p>"), F.regexp_replace("body", "[<>]", ""), F.lit("</p>")).alias("text"))
    solid = _articles(spark, d).withColumn("body", F.trim(T.or_empty(F.col("body")))).filter(F.length("body") >= 120)
    story = F.to_json(F.struct(F.col("title").alias("headline"), "url", F.array(F.struct(F.array(element).alias("story-elements"))).alias("cards")))
    return solid.select("article_id", html.story_json(story).alias("s")).select("article_id", "s.headline", "s.url", F.length("s.body").alias("n_body"))


QUERIES, ORACLE = R.queries, R.oracle
