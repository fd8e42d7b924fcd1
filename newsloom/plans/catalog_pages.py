"""Queries of the core on pages, feeds and responses in their different shapes; registered with those of the catalogue."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.plans.catalog import query
from newsloom.plans.materialize import shared_dir
from newsloom.sources import archive, html
from newsloom.sources.tables import table


def _text(*parts):
    return F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))


@query(
    """SELECT url_id, CASE url_id % 4 WHEN 0 THEN 'T & ' || hostname WHEN 3 THEN NULL ELSE hostname END AS title, CASE url_id % 4 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Bo' END AS author,
    CASE url_id % 4 WHEN 0 THEN '2024-03-05' WHEN 1 THEN '2023-01-02' END AS published, CASE url_id % 4 WHEN 0 THEN 'S' END AS sitename, CASE url_id % 4 WHEN 1 THEN 'de' END AS language,
    CASE url_id % 4 WHEN 0 THEN 'Hash: ' || url_hash || chr(10) || 'a b' WHEN 1 THEN url_hash WHEN 3 THEN 'only ' || url_hash || ' < text' END AS text FROM urls"""
)
def page_metadata(spark, d):
    """Pages in four shapes: metadata of social sites, a time tag, too short a text, no markup at all."""
    m = F.col("url_id") % 4
    h = F.col("url_hash")
    social = _text(
        "<html><head><meta property='og:title' content='T &amp; ", F.col("hostname"), "'><meta name=author content=Ann><meta property='article:published_time' content='2024-03-05T10:00:00Z'><meta property='og:site_name' content='S'>"
        "<title>other</title></head><body><aside>side</aside><p>Hash: ", h, "</p><!-- note --><ul><li>a   b</ul><footer>f</footer>",
    )
    timed = _text("<html lang=de-AT><head><meta property='article:author' content=Bo><title>", F.col("hostname"), "</title></head><body><article><time datetime='2023-01-02 08:00'></time>", h, "<script>x</script></article></body>")
    short = _text("<title>", F.col("hostname"), "</title><p>short</p>")
    body = F.when(m == 0, social).when(m == 1, timed).when(m == 2, short).otherwise(_text("only ", h, " &lt; text"))
    return table(spark, d, "urls").select("url_id", html.page(body).alias("p")).select("url_id", *(f"p.{c}" for c in ("title", "author", "published", "sitename", "language", "text")))


@query(
    """SELECT url_id, p AS position, CASE url_id % 3 WHEN 0 THEN 'A & ' || p WHEN 1 THEN 'B ' || p END AS title, url || '#' || p AS link, CASE url_id % 3 WHEN 0 THEN 'Tue' WHEN 1 THEN '2024-01-0' || (p + 1) END AS published, true AS feed
    FROM urls, (VALUES (0), (1)) t(p) WHERE url_id % 3 < 2 AND NOT (url_id % 3 = 1 AND p = 0) UNION ALL SELECT url_id, 0, NULL, 'x', NULL, true FROM urls WHERE url_id % 3 = 2"""
)
def feed_shapes(spark, d):
    """Feeds in three shapes: RSS with text as it is, Atom with linked entries (the first of them without a link), and entries without title."""
    link = lambda i: _text(F.col("url"), f"#{i}")
    m = F.col("url_id") % 3
    rss = _text("<rss version='2.0'><channel><item><title><![CDATA[A & 0]]></title><link>", link(0), "</link><pubDate>Tue</pubDate></item>\n<item><title>A & 1</title><link>\n", link(1), "\n</link><pubDate>Tue</pubDate></item></channel></rss>")
    atom = _text("<?xml version='1.0'?><feed><entry><title>B 0</title><updated>2024-01-01</updated></entry><entry><title type='html'>B 1</title><link rel='alternate' href='", link(1), "'/><published>2024-01-02</published><updated>2024-09-09</updated></entry></feed>")
    bare = F.lit("  <feed><entry><link href='x'/></entry></feed>")
    f = table(spark, d, "urls").select("url_id", F.when(m == 0, rss).when(m == 1, atom).otherwise(bare).alias("body"))
    f = f.where(html.is_feed(F.lit("text/html"), F.col("body"))).withColumn("id", F.col("url_id").cast("string"))
    e = html.feed_entries(f, "id", "body")
    return e.select(F.col("url").cast("long").alias("url_id"), "position", "title", "link", "published", F.lit(True).alias("feed"))


@query("SELECT url_id, CASE WHEN url_id % 5 < 4 THEN '/next/' || url_id END AS next, CASE url_id % 4 WHEN 0 THEN '/rss.xml' WHEN 1 THEN '/atom' WHEN 2 THEN 'https://x/feed' END AS feed, url_id % 3 AS stories, 'a & b <c> é' AS words FROM urls")
def page_links(spark, d):
    """Links that a page names: its next page by each way of marking it, its feed, and how many look like stories; and text with its entities resolved."""
    u, five, four = F.col("url_id").cast("string"), F.col("url_id") % 5, F.col("url_id") % 4
    nexts = [_text("<a rel='next' href='/next/", u, "'>n</a>"), _text("<a href='/next/", u, "' rel=\"next\">n</a>"), _text("<li class='pager-next'><a href='/next/", u, "'>2</a></li>"), _text("<a href='/next/", u, "'> Older posts</a>")]
    way = F.lit("<a href='/prev'>newer</a>")
    for i, x in enumerate(nexts):
        way = F.when(five == i, x).otherwise(way)
    feed = F.when(four == 0, "<link rel=alternate type='application/rss+xml' href='/rss.xml'>").when(four == 1, "<link href='/atom' type='application/atom+xml'>").when(four == 2, "<a href='https://x/feed'>f</a>").otherwise("")
    stories = F.when(F.col("url_id") % 3 > 0, "<a href='/2024/x'></a>").otherwise("")
    more = F.when(F.col("url_id") % 3 > 1, "<a href='/news/y'></a><a href='/news/y'></a>").otherwise("")
    body = F.concat(way, feed, stories, more)
    return table(spark, d, "urls").select("url_id", html.next_page(body).alias("next"), html.feed_link(body).alias("feed"), html.article_links(body).cast("long").alias("stories"), html.unescaped(F.lit("a &amp; b &lt;c&gt; &eacute;")).alias("words"))


@query("SELECT 'https://x/' || s || '/' || least(i, 3) AS url, least(i, 3) AS depth FROM (SELECT DISTINCT institution_id % 7 AS s FROM institutions), (VALUES (0), (1), (2), (3)) t(i)")
def followed_pages(spark, d):
    """Pages reached over links to the next page, in at most three steps."""
    sites = table(spark, d, "institutions").select((F.col("institution_id") % 7).cast("string").alias("s")).distinct()
    at = lambda i: _text("https://x/", F.col("s"), "/", i)
    steps = sites.select("s", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"))
    bodies = steps.select(at(F.col("i").cast("string")).alias("url"), _text("<a rel='next' href='", (F.col("i") + 1).cast("string"), "'>").alias("body"))
    return html.pages_from(sites.select(at("0").alias("url")), bodies, 3)


@query(
    """SELECT analysis_id, CASE analysis_id % 4 WHEN 0 THEN 'One. Two.' WHEN 1 THEN 'Only' ELSE '' END AS summary, CASE analysis_id % 4 WHEN 0 THEN 'a; b' WHEN 1 THEN 'c' ELSE '' END AS points, CAST(CASE analysis_id % 4 WHEN 0 THEN 7.5 ELSE 5.0 END AS DOUBLE) AS relevance,
    analysis_id % 4 = 0 AS is_ai_related, CAST(CASE analysis_id % 4 WHEN 0 THEN 8.0 WHEN 2 THEN 9.0 ELSE 1.0 END AS DOUBLE) AS scientific, CAST(CASE analysis_id % 4 WHEN 0 THEN 2.5 ELSE 1.0 END AS DOUBLE) AS financial, CAST(CASE analysis_id % 4 WHEN 0 THEN 3.0 ELSE 1.0 END AS DOUBLE) AS partnership,
    CASE analysis_id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE true END AS verdict FROM ai_analyses"""
)
def response_shapes(spark, d):
    """Responses in four shapes: complete, with values that cannot be read, with one label only, and free text; and a verdict in words."""
    m, three = F.col("analysis_id") % 4, F.col("analysis_id") % 3
    whole = "SUMMARY: One.\n  Two.\nKEY_POINTS:\n- a\nnot a point\n - b\nRELEVANCE: 7.5\nAI_RELATED: YES, it is\nSCIENTIFIC_IMPACT: 8/10 high\nFINANCIAL_IMPACT: 2.5\nPARTNERSHIP_IMPACT: 3 of 10"
    unread = "KEY_POINTS:\r\n- c\r\nSUMMARY: Only\r\nRELEVANCE: 8/10\r\nAI_RELATED: maybe yes\r\nSCIENTIFIC_IMPACT: high"
    r = X.response(F.when(m == 0, whole).when(m == 1, unread).when(m == 2, "  SCIENTIFIC_IMPACT: 9/10").otherwise("Nothing of the kind."))
    said = F.when(three == 0, "3. Is this AI-related? Well, Yes.").when(three == 1, "AI related: no").otherwise("no verdict")
    a = table(spark, d, "ai_analyses").select("analysis_id", r.alias("r"), X.said_yes(said).alias("verdict"))
    return a.select("analysis_id", "r.summary", F.array_join("r.key_points", "; ").alias("points"), *(f"r.{c}" for c in ("relevance", "is_ai_related", "scientific", "financial", "partnership")), "verdict")


@query("SELECT 'page-' || max(institution_id % 9) || '.html' AS file, count(DISTINCT institution_id % 9) AS old, count(DISTINCT institution_id % 9) AS days FROM institutions")
def file_listing(spark, d):
    """The last file of a folder by name, the files older than a day two days hence, and the days of two folders of which the first wins."""
    home = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    n = (F.col("institution_id") % 9).cast("string")
    pages = table(spark, d, "institutions").select(_text("page-", n, ".html").alias("file")).distinct()
    names = [r.file for r in pages.collect()]  # nine names at most
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(home).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(home))
    for x in names:
        out = fs.create(path(f"{home}/{x}"))
        out.writeBytes(x)
        out.close()
    last = archive.latest_file(spark, home, "page-*.html").select(F.element_at(F.split("file", "/"), -1).alias("file"))
    old = archive.older_than(spark, home, 1, F.current_timestamp() + F.make_dt_interval(F.lit(2))).agg(F.count("*").alias("old"))
    day = lambda i: _text("2024-01-0", i, ".html")
    first = pages.select(day(F.regexp_extract("file", r"(\d)", 1)).alias("file"), F.lit(0).alias("folder"), F.lit('<main data-total-articles="1">').alias("html"))
    second = pages.select(day("9").alias("file"), F.lit(1).alias("folder"), F.lit('<main data-total-articles="2">').alias("html")).limit(1)
    days = archive.archive_days(first.unionByName(second)).agg((F.count("*") + F.count_if(F.col("day").isNull())).alias("days"))
    return last.crossJoin(old).crossJoin(days)
