import os
from datetime import datetime

from pyspark.sql import functions as F

from newsloom.sources import archive, configs, html, sinks
from newsloom.streaming import incremental


def test_pages_and_links(spark):
    body = '<html lang="de-DE"><head><title>T &amp; U</title><meta name="author" content="A"><meta property="article:published_time" content="2024-01-02T03:04"></head><body><nav>menu</nav><p>' + "word " * 20 + '</p><a href="/news/2024/x">x</a><a href="../news/y">y</a><a href="https://o/tag/z/">z</a><a rel="next" href="/p/2">n</a></body></html>'
    df = spark.createDataFrame([("https://s/a/b", body), ("https://s/p/2", "<p>short"), ("https://s/c", None), ("https://s/d", "")], "url string, body string")
    got = {r.url: r.p for r in df.select("url", html.page("body").alias("p")).collect()}
    assert (got["https://s/a/b"].title, got["https://s/a/b"].author, got["https://s/a/b"].published, got["https://s/a/b"].language) == ("T & U", "A", "2024-01-02", "de")
    assert "menu" not in got["https://s/a/b"].text and got["https://s/p/2"].text is None and got["https://s/c"].text is None
    assert {r.link for r in html.links(df, "url", "body").collect()} == {"https://s/news/2024/x", "https://s/a/../news/y"}
    assert {(r.url, r.depth) for r in html.pages_from(df.limit(1).select("url"), df).collect()} == {("https://s/a/b", 0), ("https://s/p/2", 1)}
    assert df.select(html.title_of(F.col("body"))).first()[0] == "T &amp; U"
    assert [r[0] for r in df.select(html.feed_link(F.lit('<link rel="alternate" type="application/rss+xml" href="/f.xml">'))).limit(1).collect()] == ["/f.xml"]
    assert html.markdown_to_html("# H\na\nb\n\n- i\n[l](u) & c\n```\n<x>\n```", "u").split("\n")[6:-3] == ["<h1>H</h1>", "<p>a b</p>", "<li>i</li>", '<p><a href="u">l</a> &amp; c</p>', "<pre><code>", "&lt;x&gt;", "</code></pre>"]
    assert html.markdown_pages(df, "url", "body").count() == 4


def test_feeds(spark):
    atom = '<feed><entry><title>A</title><link href="https://s/1"/><updated>2024</updated></entry><entry><title>no</title></entry></feed>'
    df = spark.createDataFrame([("f", atom), ("g", None), ("h", "<rss></rss>")], "url string, body string")
    assert [(r.title, r.link, r.published) for r in html.feed_entries(df, "url", "body").collect()] == [("A", "https://s/1", "2024")]
    assert [r[0] for r in df.select(html.is_feed(F.lit("text/html"), F.col("body"))).collect()] == [True, False, True]


def test_configurations_of_every_generation(spark, tmp_path):
    one = '[{"name": "A", "news_url": "https://a/news", "location": "X, Y"}]'
    two = '{"universities": [{"name": "B", "location": {"city": "C"}, "news_sources": {"primary": {"url": "https://b", "ai_tag_url": "https://b/ai", "verified": false}}}]}'
    three = '{"facilities": [{"name": "D", "canonical_name": "DD", "news_sources": [{"type": "rss", "url": "https://d/f"}, {"type": "primary", "url": "https://d"}]}, {"name": "E", "news_sources": []}]}'
    four = '{"news_services": [{"name": "F", "url": "https://f", "rss_feeds": {"main": "https://f/rss"}}, {"name": "G", "url": "https://placeholder.org", "rss_feeds": "https://g/rss"}]}'
    for i, t in enumerate((one, two, three, four, "broken")):
        (tmp_path / f"{i}.json").write_text(t)
    docs = configs.read_documents(spark, [str(tmp_path / f"{i}.json") for i in range(5)] + [str(tmp_path / "missing.json")])
    got = {r.name: r for r in configs.normalised(docs).collect()}
    assert set(got) == {"A", "B", "DD", "E", "F", "G"} and got["DD"].url == "https://d" and got["E"].url is None and got["B"].location == "C"
    assert (got["F"].rss_feed, got["G"].rss_feed) == ("https://f/rss", "https://g/rss")
    assert {r.name for r in configs.eligible(configs.normalised(docs)).collect()} == {"A", "DD", "F"}
    assert {r.crawl_url for r in configs.eligible(configs.normalised(docs), prefer_feed=True).collect()} == {"https://a/news", "https://d", "https://f/rss", "https://g/rss"}


def test_archives(spark, tmp_path):
    for folder in "ab":
        os.makedirs(tmp_path / folder)
    (tmp_path / "a" / "2025-01-02.html").write_text('<div data-total-articles="7">')
    (tmp_path / "b" / "2025-01-02.html").write_text("<strong>Total Articles:</strong> 9")
    (tmp_path / "b" / "2025-01-03.html").write_text('<div class="article">' * 3)
    (tmp_path / "b" / "2025-13-03.html").write_text("x")
    pages = archive.archive_files(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert {(str(r.day), r.articles) for r in archive.archive_days(pages).collect()} == {("2025-01-02", 7), ("2025-01-03", 3)}
    assert archive.latest_file(spark, str(tmp_path / "b"), "*.html").first().file.endswith("2025-13-03.html")
    assert archive.older_than(spark, str(tmp_path / "b"), 30, F.current_timestamp()).count() == 0


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([(1, "T", None, "s"), (2, None, "U, V", None)], "article_id long, title string, university_name string, summary string").withColumn("published_date", F.lit("2024-01-01").cast("date"))
    s = spark.createDataFrame([(5, 1)], "analysis_id long, article_id long")
    out = sinks.export(a, s, str(tmp_path), "2024-01-01", "now")
    assert set(out) == {"json", "csv", "html", "text"} and spark.read.csv(out["csv"], header=True).count() == 2
    assert "csv" not in sinks.export(a.limit(0), s.limit(0), str(tmp_path / "e"), "2024-01-01", "now")
    order = [F.col("article_id")]
    assert sinks.message_blocks(a, order, 1).orderBy("n").collect()[-1].value.count("1 more") == 1
    assert sinks.text_lines(a, order).orderBy("n").first().value.startswith("1. T\n   Unknown University | January 01, 2024")
    t = str(tmp_path / "t")
    assert sinks.appended_once(a, t, "article_id").count() >= 0 and sinks.appended_once(a, t, "article_id") is not None and spark.read.parquet(t).count() == 2
    d = a.withColumn("report_date", F.lit("2024-01-01"))
    sinks.write_daily(d, str(tmp_path / "d"))
    sinks.write_daily(d.limit(1).withColumn("report_date", F.lit("2024-01-02")), str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 3


def test_stream_drains_once(spark, tmp_path):
    src, target, ck = str(tmp_path / "s"), str(tmp_path / "t"), str(tmp_path / "c")
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "id long, v double")
    df.repartition(3).write.parquet(src)
    for _ in range(2):
        incremental.drain(spark, src, "id long, v double", lambda x: x.where("v > 3"), "id", target, ck, 1)
    assert spark.read.parquet(target).count() == 6
    df.limit(10).write.mode("append").parquet(src)  # the same keys again
    incremental.drain(spark, src, "id long, v double", lambda x: x.where("v > 3"), "id", target, ck, 1)
    assert spark.read.parquet(target).count() == 6


def test_windows(spark):
    e = spark.createDataFrame([(datetime(2024, 1, 1, 1), "a", 1, 1.0), (datetime(2024, 1, 1, 2), "a", 1, 2.0), (datetime(2024, 1, 3), "b", 1, None)], "ts timestamp, event_type string, user_id long, value double")
    assert {(r.event_type, r.events, r.total) for r in incremental.tumbling(e).collect()} == {("a", 2, 3.0), ("b", 1, None)}
    assert incremental.sliding(e).where("events = 3").count() == 3
    assert incremental.sessions(e).count() == 2


def test_token_bucket_on_a_stream(spark, tmp_path):
    rows = [("h", i, s * 1_000_000) for i, s in enumerate([0, 1, 1, 2, 60])] + [("g", 9, 0)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "key string, id long, t long").coalesce(1).write.parquet(src)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = incremental.limited(spark.readStream.schema("key string, id long, t long").parquet(src), 0.1, 2.0)
    q = out.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.id: r.allowed for r in spark.table("limited").collect()} == {0: True, 1: True, 2: False, 3: False, 4: True, 9: True}


def test_windows_of_a_stream_drop_late_rows(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "ts timestamp, event_type string, user_id long, value double"
    for i, days in enumerate(([1, 2], [10], [1], [20])):
        spark.createDataFrame([(datetime(2024, 1, x), "a", 1, 1.0) for x in days], schema).coalesce(1).write.mode("append").parquet(src)
        q = incremental.tumbling(spark.readStream.schema(schema).parquet(src), "1 day", "2 days").writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {str(r.start)[:10]: r.events for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got == {"2024-01-01": 1, "2024-01-02": 1, "2024-01-10": 1}  # the late row of the first day came after its window was closed
