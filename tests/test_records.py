"""Operators on source records, host states, classes and documents of exports."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.functions import urls as U
from newsloom.operators import audit, classify, corrections, dedup, quality, rate, reconcile, similar
from newsloom.plans import materialize
from newsloom.sources import archive, configs, html, sinks, tables


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


DIM = [
    ("Auburn University", None, "peer"), ("University of Arizona", "UA", "peer"), ("Stanford University", None, "r1"), ("Massachusetts Institute of Technology", "MIT", "r1"), ("Texas Advanced Computing Center", "TACC", "hpc"),
    ("Argonne National Laboratory", "ANL", "national_lab"), ("Institute for Data Analysis", "IDA", "national_lab"), ("ETH Zurich", None, "global"), ("Oslo", None, "global"), ("University of Florida", None, "r1"), ("Lab", "", "national_lab"), (None, "X", "peer"),
]


def test_classes_of_a_report(spark):
    dim = spark.createDataFrame(DIM, "name string, abbreviation string, category string")
    want = {
        "Auburn University": "peer", "auburn university": "peer", "MIT": "r1", "ANL": "national_lab", "anl": "national_lab", "TACC": "hpc", "eth": "global", "The Texas Advanced Computing Center News": "hpc",
        "Auburn University Montgomery": "peer",  # holds a listed name
        "Florida": "r1",  # the abbreviation IDA is too short to be held
        "University of Oslo College": "r1",  # Oslo is guarded and too short
        "Argonne": "national_lab", "Unknown Place": "r1", "": "r1", None: "r1", "University of Arizona": "peer",
    }
    got = dict(rows(classify.classified(spark.createDataFrame([(k,) for k in want] * 2, "name string"), dim)))
    assert got == want
    assert classify.classified(spark.createDataFrame([], "name string"), dim).count() == 0
    assert dict(rows(classify.classified(spark.createDataFrame([("MIT",)], "name string"), dim.limit(0)))) == {"MIT": "r1"}


def test_short_names_are_held_too(spark):
    dim = spark.createDataFrame([("Q", None, "peer"), ("Zz", None, "r1"), ("Longer Name", None, "peer")], "name string, abbreviation string, category string")
    got = dict(rows(classify.fuzzy_class(spark.createDataFrame([("Iraq",), ("Fuzzy",), ("er",), ("x",)], "name string"), dim)))
    assert got == {"Iraq": "peer", "Fuzzy": "r1", "er": "peer", "x": "r1"}


def test_canonical_name_falls_back_on_the_site(spark):
    dim = classify.host_dim(spark.createDataFrame([(1, "news.a.edu", "A")], "seq long, host string, name string"))
    hosts = spark.createDataFrame([(" NEWS.A.edu ", "s"), ("x.a.edu", "s"), ("b.edu", "Site B"), ("b.edu", ""), ("c.edu", None), (None, "S"), ("", None)], "host string, sitename string")
    got = {(r.host, r.sitename): r.canonical for r in classify.canonical_names(hosts, dim).collect()}
    assert got == {(" NEWS.A.edu ", "s"): "A", ("x.a.edu", "s"): "A", ("b.edu", "Site B"): "Site B", ("b.edu", ""): "b.edu", ("c.edu", None): "c.edu", (None, "S"): "S", ("", None): "Unknown"}


def test_words_are_parted_by_any_white_space(spark):
    said = ["a b", "a\xa0b c", "a b\x1cc\x85d", " \xa0 ", "", None, "x" * 50_000]
    got = [r.n for r in spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, t string").select("i", X.word_count(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [0 if x is None else len(x.split()) for x in said]


def test_quality_of_documents(spark):
    full = {
        "name": "A", "location": {"city": "c", "state": "s", "country": "k"}, "news_sources": {"primary": {"url": "u", "ai_tag_url": "t", "verified": True}, "rss_feeds": [{"url": f"f{i}", "active": True, "verified": i < 3} for i in range(4)]},
        "social_media": {p: {"url": "x"} for p in ("twitter", "linkedin", "facebook", "youtube")}, "media_relations": {"page_url": "p", "email": "e", "phone": "1"}, "ai_research": {"has_ai_institute": True, "ai_centers": ["c"], "ai_focus_areas": ["f"]},
    }
    docs = spark.createDataFrame([(1, json.dumps(full)), (2, "{}"), (3, "no"), (4, None), (5, json.dumps({"name": "B", "news_sources": {"primary": {"verified": True}}})), (6, "[]")], "id int, document string")
    got = {r.id: r for r in quality.validated(docs, spark.createDataFrame([("u", False), ("u", None)], "url string, ok boolean")).collect()}
    assert abs(got[1].score - 1) < 1e-9 and got[1].errors == [] and got[1].warnings == ["Primary URL not accessible", "RSS feed invalid: f3"]
    for i in (2, 3, 4, 6):
        assert got[i].score == 0 and len(got[i].errors) == 3 and got[i].name == "Unknown"
    assert abs(got[5].score - (0.05 + 0.3 * 0.75)) < 1e-9 and got[5].errors == ["Missing required field: location.state"]
    e = docs.select("id", quality.schema_errors(F.col("document"), {"$.name": "STRING"}).alias("e"))
    assert {r.id: r.e for r in e.collect()} == {1: [], 2: ["$.name is missing"], 3: ["no JSON"], 4: ["no JSON"], 5: [], 6: ["$.name is missing"]}


def test_host_states(spark):
    t = lambda m: datetime(2024, 1, 1, 0, m)
    hosts = spark.createDataFrame([("a", t(0), 2.0, None, None), ("b", None, None, 3.0, t(5))], "hostname string, last_crawl_time timestamp_ntz, crawl_delay double, robots_txt_delay double, blocked_until timestamp_ntz")
    crawls = spark.createDataFrame([("a", t(3), None, 9.0), ("a", t(2), 7.0, None), ("c", t(4), None, None)], "hostname string, at timestamp_ntz, crawl_delay double, robots_txt_delay double")
    assert rows(rate.updated_hosts(hosts, crawls), "hostname") == [("a", t(3), 2.0, 9.0, None), ("b", None, None, 3.0, t(5)), ("c", t(4), 1.0, None, None)]
    blocks = spark.createDataFrame([("a", t(1), 60), ("a", t(0), 600), ("d", t(2), 60)], "hostname string, at timestamp_ntz, seconds int")
    assert rows(rate.blocked_hosts(hosts, blocks).select("hostname", "last_crawl_time", "blocked_until"), "hostname") == [("a", t(0), t(2)), ("b", None, t(5)), ("d", t(2), t(3))]


def test_token_bucket_pieces_change_nothing(spark):
    import random

    random.seed(4)
    at, log = 0, []
    for i in range(400):
        at += random.choice([1, 2, 3, 20, 21, 22, 400])
        log.append(("h", i, at))
    df = spark.createDataFrame(log + [("g", 900, None), ("g", 901, None), ("g", 902, 5)], "k string, id long, s long").withColumn("at", F.timestamp_seconds("s"))
    tokens, last, want = 2.0, None, {}
    for _, i, t in log:
        tokens = 2.0 if last is None else min(2.0, tokens + (t - last) * 0.1)
        last = t
        want[i] = tokens >= 1
        tokens -= tokens >= 1
    got = {r.id: r.allowed for r in rate.token_bucket(df, "k", "at", "id", 0.1, 2.0).collect()}
    assert {i: got[i] for i in want} == want and got[900] and got[901] and got[902]


def test_corrections_in_their_layouts(spark):
    docs = [
        ("batches_1_2", json.dumps({"batch_1_peer_institutions": {"broken_urls": [{"name": "A", "corrected_url": "n"}]}, "batch_2_major_facilities": {"broken_urls": [{"name": "B", "original_url": "o", "corrected_url": "n"}]}})),
        ("batch_3", json.dumps({"broken_urls": [{"name": "C", "url": "o", "correct_url": "n"}]})), ("batch_4", json.dumps({"verified_urls": [{"name": "D", "status": "corrected", "url": "n"}, {"name": "E", "status": "ok", "url": "n"}]})),
        ("batch_6", json.dumps({"corrections": [{"university": "F", "original_url": "o", "corrected_url": "n"}]})), ("batch_5", "{"), ("batch_5", None), ("batch_3", "{}"), ("other", "{}"),
    ]
    got = corrections.batch_corrections(spark.createDataFrame(docs, "batch string, document string"))
    assert sorted(rows(got.select("name", "old_url", "new_url", "category"))) == [("A", "", "n", "peer"), ("B", "o", "n", "facility"), ("C", "o", "n", "r1"), ("D", "", "n", "r1"), ("F", "o", "n", "r1")]
    assert sorted(rows(corrections.by_category(got))) == [("facility", 1), ("peer", 1), ("r1", 3)]
    first = corrections.unified([spark.createDataFrame([("Annex", "n2", 2), ("A U Annex", "n9", 9), ("A U", "n1", 1)], "name string, new_url string, place int")])
    assert rows(corrections.matched(spark.createDataFrame([(1, "A U Annex", "x")], "seq int, name string, url string"), first)) == [(1, "A U Annex", "x", "n1", True)]
    records = spark.createDataFrame([(1, "UAB", "o"), (2, "X", "o"), (3, None, "o"), (4, "Y", None)], "seq int, name string, url string")
    verified = spark.createDataFrame([("U of A at B", "n"), ("X", "o"), ("Y", "m"), ("Y", "n")], "name string, new_url string")
    variations = spark.createDataFrame([("U of A at B", "UAB", 1), ("X", "UAB", 2)], "name string, variation string, place int")
    assert rows(corrections.by_variation(records, verified, variations), "seq") == [(1, "UAB", "n", True), (2, "X", "o", False), (3, None, "o", False), (4, "Y", "m", True)]
    found = spark.createDataFrame([(1, "https://a/"), (2, "https://b")], "id int, url string")
    probes = spark.createDataFrame([("https://a/tags/artificial-intelligence", True), ("https://a/tag/artificial-intelligence", True), ("https://b/topic/artificial-intelligence", None)], "url string, ok boolean")
    assert rows(corrections.with_tag_pages(found, probes), "id") == [(1, "https://a/", "https://a/tag/artificial-intelligence"), (2, "https://b", None)]


def test_unmatched_names_against_all_pairs(spark):
    from difflib import SequenceMatcher

    names = ["The University of Oslo", "Univ. of Oslo", "Lund", "Lund College", "Trondheim Tech", "Trondheim Tesh", "A – B, C & D", "", None, "Zz", "Tromsø University"]
    listed = ["University of Oslo", "Lund Collage", "Trondheim Tech!", "a - b c and d", None, " "]
    form = lambda x: " ".join(x.lower().strip().removeprefix("the ").split()).replace("–", "-").replace(",", "").replace("&", "and")
    there = {form(x) for x in listed if x and x.strip()}
    want = {n for n in names if n and not any(form(n) in r or r in form(n) or SequenceMatcher(None, form(n), r).ratio() >= 0.85 for r in there)}
    got = similar.unmatched(spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame([(x,) for x in listed], "name string"))
    assert {r.name for r in got.collect()} == want and len(want) == 3


def test_records_written_down(spark, tmp_path):
    a = spark.createDataFrame([("x", "p", 1), ("y", "q", 2), (None, "r", 3)], "k string, v string, n int")
    log = reconcile.change_log(reconcile.repaired(a, [("t", F.when(F.col("n") < 3, F.concat("v", F.lit("2"))))], "v"), "k", "v", dry_run=True)
    assert rows(log, "k") == [("x", "p", "p2", "t", False), ("y", "q", "q2", "t", False)]
    assert rows(reconcile.changes_by(log, "tier")) == [("t", 2, 2, "p2")]
    assert rows(reconcile.migration_stats(spark.createDataFrame([(["a", "b"],), (None,), ([],)], "s array<string>"), "s")) == [(3, 2, 1)]
    path = str(tmp_path / "t")
    assert sinks.written_back(a, path) == 1 and sinks.written_back(a.limit(1), path) == 2
    assert sinks.version_of(spark, path, 1).count() == 3 and sinks.version_of(spark, path, 2).count() == 1
    assert rows(dedup.flagged(a, spark.createDataFrame([("x",), ("x",), (None,)], "k string"), "k", "v", "gone"), "n") == [("x", "gone", 1), ("y", "q", 2), (None, "r", 3)]


def test_documents_of_exports(spark):
    a = spark.createDataFrame([(2, "B \"q\"", None, None, "s", "u2"), (1, None, "U", None, None, None)], "article_id long, title string, university_name string, published_date date, summary string, url string")
    s = spark.createDataFrame([(7, 1, None)], "analysis_id long, article_id long, consensus_summary string")
    whole = lambda df: "\n".join(r.value for r in df.orderBy("n").collect())
    got = json.loads(whole(sinks.json_envelope(a, s, "2024-01-01", "now", {"lookback_days": 1})))
    assert got["article_count"] == 2 and [x["article_id"] for x in got["articles"]] == [1, 2] and got["articles"][0]["title"] is None and got["ai_analyses"][0]["analysis_id"] == 7 and got["metadata"] == {"lookback_days": 1}
    assert json.loads(whole(sinks.json_envelope(a.limit(0), s.limit(0), "d", "n")))["articles"] == []
    order = [F.col("article_id")]
    text = whole(sinks.text_report(a, order, "2024-01-01"))
    assert text.startswith("Digest - 2024-01-01\n" + "=" * 60 + "\n\nFound 2 AI-related articles\n") and "\n2. B \"q\"\n   Unknown University | Date unknown\n   s\n   Read more: u2" in text
    assert whole(sinks.text_report(a.limit(0), order, "d")) == "No articles found."
    import email

    mail = email.message_from_string(whole(sinks.multipart(a, order, "2024-01-01", "f@x", ["t@x", "u@x"], "now")))
    assert mail["Subject"] == "Digest - 2024-01-01 (2 articles)" and mail["To"] == "t@x, u@x" and [p.get_content_type() for p in mail.walk()] == ["multipart/alternative", "text/plain", "text/html"]
    assert mail.get_payload()[0].get_payload().strip() == text.strip()
    days = spark.createDataFrame([("2024-01-01",), ("2024-01-02",), (None,)], "day string").withColumn("day", F.to_date("day"))
    files = [r.file for r in sinks.page_files(days, F.lit("2024-01-02").cast("date"), ["a"]).orderBy("file").collect()]
    assert files == ["a/archive/2024-01-01.html", "a/archive/2024-01-02.html", "a/index.html"]


def test_lists_and_totals(spark):
    d = spark.createDataFrame([("a", 1, 0), ("b", 0, 0), ("c", 2, 5), ("d", 3, 0)], "hostname string, errors int, articles int")
    assert [r.hostname for r in audit.failing(d).collect()] == ["a", "d"] and audit.failing(d, 1).count() == 1
    s = spark.createDataFrame([(i, k) for i, k in enumerate(["peer", "Facility X", "r1", None, "peer"])], "seq int, kind string")
    assert [(r.priority, r.chosen) for r in audit.priority_split(s, 2).orderBy("seq").collect()] == [(True, True), (True, True), (False, False), (False, False), (True, False)]
    h = archive.health_reports(spark.createDataFrame([("x", '{"sources_attempted": 3, "stats": {"errors": 2}, "failed_domains": ["q"]}'), ("y", "no"), ("z", None)], "file string, document string"))
    assert rows(h.select("file", "attempted", "errors", "failed"), "file") == [("x", 3, 2, ["q"]), ("y", None, None, None), ("z", None, None, None)]
    assert configs.chosen_files("all")[0] == "peer_institutions.json" and configs.chosen_files("r1", own="my.json") == ["my.json"] and configs.chosen_files("r1", " x.json ,") == ["x.json"]
    b = spark.createDataFrame([("<a href=\"/Tag/AI/x\">", "https://h.edu/a"), ("<a href='https://z/ai/'>", "https://h.edu"), ("<a href='ai/x'>", "https://h.edu"), (None, None)], "b string, u string")
    assert [r[0] for r in b.select(html.subject_link(F.col("u"), F.col("b"))).collect()] == ["https://h.edu/tag/ai/x", "https://z/ai/", None, None]
    c = spark.createDataFrame([("x.edu", "X Y"), ("x.edu", "X&Y"), (None, "abc"), (None, None)], "d string, a string")
    sizes = [r[0] for r in c.select(F.size(U.candidates(F.col("d"), F.lit(None), F.col("a")))).collect()]
    assert sizes == [9, 5, 4, 0]


def test_tables_are_released_and_clusters_need_a_folder(spark):
    t = materialize.materialize(spark.range(3), "t")
    assert t.count() == 3 and materialize.release() >= 1
    with pytest.raises(Exception):
        spark.read.parquet(t.inputFiles()[0]).count()

    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://x:7077"
            getConf = staticmethod(lambda: {})

    with pytest.raises(RuntimeError):
        materialize.shared_dir(Cluster())


def test_catalogue_of_tables(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "a.parquet"))
    assert rows(tables.described(spark, str(tmp_path), ["a"])) == [("a", 1, 4)]


def test_numbers_as_text(spark):
    said = [0.0, 0.0002, 0.87, 1.0, 100.0, 123456.789, -0.5, 1 / 3, None, 1e-9]
    got = [r.t for r in spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, x double").select("i", X.number(F.col("x")).alias("t")).orderBy("i").collect()]
    assert got[:8] == [repr(x) for x in said[:7]] + [got[7]] and abs(float(got[7]) - 1 / 3) < 1e-15 and got[8] is None and float(got[9]) == 1e-9
