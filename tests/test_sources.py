import json

from pyspark.sql import functions as F

from sondhan.sources import files, html
from sondhan.streaming import ingest

PAGE = '<html><head><meta property="og:title" content="OG"></head><body><script>var x="</p>";</script><div class="nav"><p>menu</p></div><article class="story-body"><h1>A &amp; B</h1><p>First paragraph that is long enough to stay.<p>Second paragraph, unclosed, long enough as well, and then some more words to pass the least length.</article><a href="https://x/tags/a">Tag</a></body></html>'


def test_parser_is_tolerant():
    body = html.body_of(PAGE, "dhaka_tribune")
    assert body.split("\n\n") == ["First paragraph that is long enough to stay.", "Second paragraph, unclosed, long enough as well, and then some more words to pass the least length."]
    assert html.body_of(None, None) == "" and html.body_of("", "daily_star") == "" and html.body_of("<p>" + "x" * 200_000, None) == "x" * 200_000
    assert html.body_of("<article><p>" + "English only text that is long enough, really.</p></article>", "bdnews24") == ""


def test_columns(spark):
    r = spark.createDataFrame([(PAGE,), (None,)], "h string").select(html.page_title(F.col("h")).alias("t"), html.page_tags(F.col("h")).alias("g"), html.links(F.col("h")).alias("l"))
    assert [tuple(x) for x in r.collect()] == [("A & B", ["Tag"], ["https://x/tags/a"]), (None, [], [])]


def test_url_filters(spark):
    urls = spark.createDataFrame([("https://a/Tag/x",), ("https://a/story-12345",), (None,)], "u string")
    assert [r[0] for r in urls.select(html.is_article_url(F.col("u"))).collect()] == [False, True, True]


def test_story_json(spark):
    story = json.dumps({"headline": "H", "url": "u", "summary": "s" * 30, "published-at": 0, "cards": [{"story-elements": [{"type": "text", "text": "<p>" + "long text " * 12 + "</p>"}, {"type": "image", "text": "x"}, {"type": "text", "text": "short"}]}]})
    s = spark.createDataFrame([(story,), (None,)], "j string").select(html.story_json(F.col("j")).alias("s")).select("s.*").collect()
    assert s[0].body == ("long text " * 12).strip() and s[0].published == "1970-01-01T00:00:00" and s[1].headline is None


def test_feeds(spark):
    xml = spark.createDataFrame([('<urlset xmlns="http://s"><url><loc>http://a/x-1</loc></url><url><loc>http://a/x</loc></url></urlset>',)], "x string")
    assert [r.url for r in html.sitemap_urls(xml, "x").collect()] == ["http://a/x-1"]
    atom = spark.createDataFrame([('<feed xmlns="http://a"><entry><link href="http://a/s"/></entry><entry><link href="http://a/video/1"/></entry></feed>',)], "x string")
    assert [r.url for r in html.feed_links(atom, "x").collect()] == ["http://a/s"]


def articles(n, start=0):
    return [{"url": f"https://www.a.com/{i % 7}", "title": "T", "body": "word " * 60, "date": "2025-01-01", "language": "en", "source": "s", "category": "c", "tokens": 0, "named_entities": [], "tags": ["x"], "crawled_at": "2025-01-01T00:00:00"} for i in range(start, start + n)]


def test_json_lines_round_trip(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text("\n".join([*(json.dumps(x) for x in articles(5)), "{broken", ""]))
    df = files.read_jsonl(spark, str(path))
    assert df.count() == 5
    assert tuple(files.count_rejects(spark, str(path)).first()) == (6, 1)
    files.write_parquet(df, str(tmp_path / "p"), "zstd")
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.schema["tags"].dataType.simpleString() == "string" and back.count() == 5
    files.write_by_language(df, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l/all")).count() == 5


def test_append_once(spark, tmp_path):
    df = spark.createDataFrame(articles(20), files.ARTICLE)
    assert files.append_once(df, str(tmp_path / "t")) == 7
    assert files.append_once(df, str(tmp_path / "t")) == 0


def test_systematic_sample(spark):
    got = [r.id for r in files.systematic_sample(spark.range(103), "id", 10).collect()]
    assert got == list(range(0, 100, 10))


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in range(3):
        (src / f"{k}.jsonl").write_text("\n".join(json.dumps(x) for x in articles(10, k * 5)))
    stream = spark.readStream.schema(files.ARTICLE).option("maxFilesPerTrigger", 1).json(str(src))
    ingest.write(ingest.ingest(stream), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    batch = ingest.ingest(files.read_jsonl(spark, str(src)))
    streamed = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.nurl for r in streamed.select("nurl").collect()) == sorted(r.nurl for r in batch.select("nurl").collect())
    assert streamed.count() == 7
