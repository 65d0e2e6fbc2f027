"""Articles out of captured pages: link discovery, titles, bodies, dates, feeds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondhan.functions.text import BENGALI, collapse, or_empty

# Addresses that are no article.
SKIP_PARTS = ["/video/", "/photo/", "/author/", "/topic/", "/tag/", "/category/", "/page/", "/search", "/login", "/register"]

# What an article address looks like, by (source, variant).
LINK_RULES = {
    ("daily_star", "default"): r"/news/.*-\d{5,}$", ("daily_star", "sitemap"): r"-\d+$", ("newage", "default"): r"/post/[^/]+/\d+", ("dhaka_tribune", "default"): r"/\d{4,}/",
    ("daily_sun", "default"): r"/\d{6}/[a-z0-9-]+", ("daily_sun", "cloud"): r"(?i)/[a-z-]+/\d+/[a-z0-9-]+", ("new_nation", "default"): r"/news/\d{6,}/", ("bdnews24", "default"): r"/[a-f0-9]{12,}$",
    ("bdnews24", "cloud"): r"/[a-z0-9-]+/[a-f0-9]{12}$", ("kaler_kantho", "default"): r"/\d{5,}$", ("kaler_kantho", "cloud"): r"/online/[^/]+/\d{4}/\d{2}/\d{2}/\d+",
    ("bangla_tribune", "default"): r"/\d{6}/", ("dhaka_post", "default"): r"/[a-z0-9-]+$", ("prothom_alo", "default"): r"/[a-z0-9]{8,12}$",
}

# Containers, paragraph minimum, whether Bangla is needed, fallback minimum, body minimum.
SITE_RULES = {
    "daily_star": (["article", "article-content", "field-body"], 20, False, 50, 100), "newage": (["news-details", "article-content", "article"], 20, False, 50, 100),
    "dhaka_tribune": (["story-body", "article-content", "article"], 20, False, None, 100), "daily_sun": (["news-details", "article-content", "article"], 20, False, 50, 100),
    "new_nation": (["entry-content", "article-content", "article"], 20, False, 50, 100), "prothom_alo": (["story-element", "article"], 10, True, 30, 50),
    "bdnews24": (["article", "story", "content"], 20, True, None, 50), "kaler_kantho": (["news-content", "article-content"], 20, False, None, 50),
    "bangla_tribune": (["article", "news-details", "content"], 20, True, None, 50), "dhaka_post": (["article", "detail", "content"], 20, True, None, 50),
}
DEFAULT_RULE = (["article", "article-content", "content"], 20, False, 50, 100)


def is_article_url(url: Column) -> Column:
    return ~F.lower(or_empty(url)).rlike("|".join(SKIP_PARTS))


def matches_rule(url: Column, source: Column, variant: Column) -> Column:
    out = F.lit(False)
    for (s, v), rule in LINK_RULES.items():
        hit = url.rlike(rule)
        if (s, v) == ("dhaka_tribune", "default"):
            hit = hit & ~F.contains(url, F.lit("/video/"))
        if (s, v) == ("dhaka_post", "default"):
            hit = hit & (F.length(url) > 30)
        out = F.when((source == s) & (variant == v), hit).otherwise(out)
    return out


def links(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(or_empty(html), F.lit('<a [^>]*href="([^"]*)"'), F.lit(1)))


def discover_links(pages: DataFrame, url: str, html: str, rule: str | None = None) -> DataFrame:
    """(page, link): addresses a page links to, in either kind of quotes, made absolute, each once; only articles, and those that match ``rule``.

    Relative ones are taken from the page's folder, ``//host`` takes its scheme, fragments and other schemes are left out.
    """
    found = F.regexp_extract_all(or_empty(F.col(html)), F.lit("(?is)<a\\s[^>]*?href\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)')"), F.lit(0))
    rows = pages.select(F.col(url).alias("page"), F.explode(F.array_distinct(found)).alias("tag"))
    href = F.trim(F.regexp_extract("tag", "(?is)href\\s*=\\s*[\"']([^\"']*)[\"']$", 1))
    root, scheme = F.regexp_extract("page", "^([a-z]+://[^/]+)", 1), F.regexp_extract("page", "^([a-z]+:)", 1)
    folder = F.when(F.col("page").rlike("^[a-z]+://[^/]+$"), F.concat("page", F.lit("/"))).otherwise(F.regexp_replace("page", "[^/]*(?:[?#].*)?$", ""))
    full = F.when(href.rlike("^(?i)https?://"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(root, href)).when(href.rlike("^[a-z]+:|^#") | (href == ""), F.lit(None)).otherwise(F.concat(folder, href))
    links_ = rows.select("page", F.regexp_replace(full, "#.*$", "").alias("link")).filter("link is not null").filter(is_article_url(F.col("link"))).distinct()
    return links_.filter(F.col("link").rlike(rule)) if rule else links_


# Sections of the older category rule.
SECTIONS = ["news", "business", "sports", "opinion", "environment", "tech-startup"]


def legacy_category(url: Column) -> Column:
    """The first path piece that is a section, for news the piece after it (unless that is news or missing); 'general' without one."""
    pieces = F.split(or_empty(url), "/")
    hit = F.get(F.filter(pieces, lambda x: x.isin(SECTIONS)), F.lit(0))
    after = F.get(pieces, F.array_position(pieces, hit).cast("int"))
    return F.when(hit.isNull(), "general").when((hit == "news") & (after != "news"), after).otherwise(hit)


# Fixed value: what one site adds to its titles.
SITE_SUFFIX = "\\s*\\|\\s*প্রথম আলো$"


def strip_site(title: Column) -> Column:
    return F.regexp_replace(title, SITE_SUFFIX, "")


def untag(c: Column) -> Column:
    text = F.regexp_replace(c, "<[^>]*>", "")
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(ch))
    return text


def page_title(html: Column) -> Column:
    h1 = collapse(untag(F.regexp_extract(or_empty(html), "(?is)<h1[^>]*>(.*?)</h1>", 1)))
    og = F.regexp_extract(or_empty(html), '(?i)<meta property="og:title" content="([^"]*)"', 1)
    return F.coalesce(F.nullif(h1, F.lit("")), F.nullif(og, F.lit("")))


def page_body(html: Column, least: int = 20, bangla: bool = False) -> Column:
    """Paragraphs longer than ``least`` characters, two line feeds between them; JVM-side, for well-formed pages."""
    paras = F.transform(F.regexp_extract_all(or_empty(html), F.lit("(?is)<p[^>]*>(.*?)</p>"), F.lit(1)), lambda p: collapse(untag(p)))
    keep = F.filter(paras, lambda p: (F.length(p) > least) & (p.rlike(BENGALI) if bangla else F.lit(True)))
    return F.array_join(keep, "\n\n")


def page_date(html: Column) -> Column:
    t = F.regexp_extract(or_empty(html), '(?i)<time[^>]*datetime="([^"]*)"', 1)
    inner = collapse(untag(F.regexp_extract(or_empty(html), "(?is)<time[^>]*>(.*?)</time>", 1)))
    meta = F.regexp_extract(or_empty(html), '(?i)<meta property="article:published_time" content="([^"]*)"', 1)
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (t, inner, meta)])


def page_tags(html: Column, most: int = 10) -> Column:
    found = F.regexp_extract_all(or_empty(html), F.lit('(?is)<a [^>]*href="[^"]*/(?:tags|topic)/[^"]*"[^>]*>(.*?)</a>'), F.lit(1))
    return F.slice(F.filter(F.transform(found, lambda t: collapse(untag(t))), lambda t: t != ""), 1, most)


def url_category(url: Column) -> Column:
    """The first path segment ('' for the root)."""
    path = F.regexp_replace(or_empty(url), "^[a-z]+://[^/]*/?", "")
    return F.regexp_extract(path, "^([^/?#]*)", 1)


def url_date(url: Column) -> Column:
    y = F.regexp_extract(or_empty(url), "/(\\d{4}/\\d{2}/\\d{2})/", 1)
    return F.nullif(F.replace(y, F.lit("/"), F.lit("-")), F.lit(""))


def sitemap_urls(df: DataFrame, xml: str, keep: str = "-\\d+$") -> DataFrame:
    return df.select(F.explode(F.expr(f"xpath(`{xml}`, '//*[local-name()=\"loc\"]/text()')")).alias("url")).filter(F.col("url").rlike(keep)).distinct()


def feed_links(df: DataFrame, xml: str) -> DataFrame:
    href = "xpath(`" + xml + "`, '//*[local-name()=\"entry\"]/*[local-name()=\"link\"]/@href')"
    return df.select(F.explode(F.expr(href)).alias("url")).filter(is_article_url(F.col("url"))).distinct()


def story_json(story: Column, schema: str | None = None) -> Column:
    """struct(headline, body, url, published) of an API story: text elements without tags, longer than 20 characters; the summary replaces a body under 100."""
    kind = schema or "headline string, url string, summary string, `published-at` bigint, cards array<struct<`story-elements`:array<struct<type:string,text:string>>>>"
    s = F.from_json(story, kind)
    texts = F.filter(F.flatten(F.transform(s["cards"], lambda c: c["story-elements"])), lambda e: e["type"] == "text")
    parts = F.filter(F.transform(texts, lambda e: F.trim(F.regexp_replace(e["text"], "<[^>]+>", ""))), lambda t: F.length(t) > 20)
    body = F.array_join(parts, "\n\n")
    return F.struct(
        s["headline"].alias("headline"), F.when(F.length(body) < 100, F.coalesce(F.nullif(s["summary"], F.lit("")), body)).otherwise(body).alias("body"), s["url"].alias("url"),
        F.date_format(F.timestamp_millis(s["published-at"]), "yyyy-MM-dd'T'HH:mm:ss").alias("published"),
    )


#: Which fetcher variants a source may use, the first that is there goes first.
PRIORITY = ["tavily", "cloud", "selenium", "default"]


def source_plan(sources: DataFrame, source: str, wanted: list[str]) -> DataFrame:
    """(source, variant, rule): the link rule of each source under the variants that are wanted, by PRIORITY; sources without a rule are left out."""
    rules = [(s, v, PRIORITY.index(v) if v in PRIORITY else len(PRIORITY), r) for (s, v), r in LINK_RULES.items() if v in (*wanted, "default")]
    table = sources.sparkSession.createDataFrame(rules, f"`{source}` string, variant string, turn int, rule string")
    return sources.select(source).distinct().join(F.broadcast(table), source).groupBy(source).agg(F.min_by(F.struct("variant", "rule"), "turn").alias("r")).select(source, "r.variant", "r.rule")


def paged(fetch: Callable[[int, int], dict | None], limit: int, page: int = 50, failures: int = 3) -> Iterator[dict]:
    """Items of a paged source: pages of at most 50 until one is empty, ``limit`` is reached or ``failures`` pages in a row fail (None)."""
    got = offset = missed = 0
    while got < limit and missed < failures:
        answer = fetch(offset, min(page, 50))
        if answer is None:
            missed += 1
            continue
        missed = 0
        items = answer.get("items") or []
        if not items:
            return
        for item in items[: limit - got]:
            got += 1
            yield item
        offset += len(items)


class _Paragraphs(HTMLParser):
    """Text of paragraphs, by the containers they lie in; tolerant of unclosed tags and of markup inside scripts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, set[str]]] = []
        self.rows: list[tuple[set[str], str]] = []
        self.text: list[str] | None = None

    def _flush(self):
        if self.text is not None:
            inside = set().union(*(names for _, names in self.stack)) if self.stack else set()
            self.rows.append((inside, " ".join("".join(self.text).split())))
            self.text = None

    def handle_starttag(self, tag, attrs):
        if tag == "p":
            self._flush()
            self.text = []
        elif tag not in ("br", "img", "meta", "link", "input", "hr"):
            names = {tag, *(dict(attrs).get("class") or "").split()}
            self.stack.append((tag, names))

    def handle_endtag(self, tag):
        if tag == "p":
            self._flush()
        elif any(t == tag for t, _ in self.stack):
            if tag in ("div", "article", "section", "body"):
                self._flush()
            while self.stack and self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if self.text is not None and not (self.stack and self.stack[-1][0] in ("script", "style")):
            self.text.append(data)


def body_of(html: str | None, source: str | None) -> str:
    """Body by the source's rules: the first container with a long enough paragraph, else the fallback over all; '' if too short."""
    containers, least, bangla, fallback, shortest = SITE_RULES.get(source or "", DEFAULT_RULE)
    parser = _Paragraphs()
    parser.feed(html or "")
    parser._flush()
    good = lambda t, n: len(t) > n and (not bangla or any("ঀ" <= c <= "৿" for c in t))
    for name in containers:
        found = [t for inside, t in parser.rows if name in inside and good(t, least)]
        if found:
            break
    else:
        found = [t for _, t in parser.rows if fallback is not None and good(t, fallback)]
    body = "\n\n".join(found)
    return body if len(body) >= shortest else ""


def extract_bodies(df: DataFrame, key: str, html: str, source: str) -> DataFrame:
    """(key, body) by an HTML parser in Arrow batches, for pages as they are found."""
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f[key], "body": [body_of(h, s) for h, s in zip(f[html], f[source], strict=True)]})

    return df.select(key, html, source).mapInPandas(run, f"`{key}` {kind}, body string")
