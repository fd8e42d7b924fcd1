from urllib.parse import parse_qs, urlencode, urlparse, urlunparse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.functions import urls as U


def one(spark, column, *values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", column(F.col("v")).alias("out")).orderBy("i").collect()]


def expected_normal(url):
    p = urlparse(url.lower())
    q = {k: v for k, v in parse_qs(p.query).items() if k not in U.TRACKING}
    return urlunparse((p.scheme, p.netloc, p.path if p.path == "/" else p.path.rstrip("/"), p.params, urlencode(q, doseq=True), ""))


VECTORS = {
    "HTTP://A.com": "http://a.com",
    "http://a.com/": "http://a.com/",
    "http://a.com//": "http://a.com",
    "http://a.com/x/?utm_source=q&b=2&a=1&b=3#z": "http://a.com/x?b=2&b=3&a=1",
    "http://a.com/?k=": "http://a.com/",
    "http://a.com/p;v=1/?q=a b&c=%2F": "http://a.com/p;v=1?q=a+b&c=%2F",
    "https://a.com/x?q=caf%C3%A9&r=~a*b": "https://a.com/x?q=caf%C3%A9&r=~a%2Ab",
}


def test_normal_form_of_urls(spark):
    assert one(spark, U.normalized, *VECTORS) == list(VECTORS.values())
    assert one(spark, U.normalized, None, "") == [None, ""]
    assert one(spark, U.normalized, *VECTORS.values()) == list(VECTORS.values())  # it is its own normal form


@settings(max_examples=5, deadline=None)
@given(st.lists(st.builds(lambda h, p, q: f"https://{h}.Org/{p}?{q}", st.from_regex(r"[a-z]{1,8}", fullmatch=True), st.from_regex(r"[A-Za-z0-9/_.-]{0,12}", fullmatch=True), st.from_regex(r"([a-c]=[a-z0-9%20+]{0,4}&?){0,4}", fullmatch=True)), min_size=20, max_size=20))
def test_normal_form_agrees_with_the_standard_library(spark, urls):
    urls = [u for u in urls if "%" not in u]
    assert one(spark, U.normalized, *urls) == [expected_normal(u) for u in urls]


def test_parts_of_urls(spark):
    assert one(spark, U.authority, "https://News.A.edu:80/x", "nothing", None) == ["news.a.edu:80", "", None]
    assert one(spark, U.base_domain, "news.a.edu", "a.edu", "local", None) == ["a.edu", "a.edu", "local", None]
    assert [str(x) for x in one(spark, U.date_in, "https://a/2024/05/06/x", "https://a/2024/05/x", "https://a/2024/15/01/x", "https://a")] == ["2024-05-06", "2024-05-01", "None", "None"]
    assert one(spark, U.correction, "http://a", "https://a", "a/", "a") == ["https://a", "http://a", "a", "a/"]
    assert one(spark, U.followed, "https://a/news/x", "https://a/news/", "https://a/tag/x/news/y", "https://a/b") == [True, False, False, False]
    assert one(spark, U.listing_title, "Écoles News", "News", "Newspaper wins", "The Archives", None) == [True, True, False, True, None]
    assert one(spark, lambda c: U.candidates(c, F.lit("https://news.a.edu/")), "a.edu")[0] == ["https://www.a.edu/news", "https://newsroom.a.edu", "https://today.a.edu", "https://a.edu/news"]


def test_text(spark):
    assert one(spark, X.word_count, "a  b\nc", "", None, " ") == [3, 0, 0, 0]
    assert one(spark, X.plain, "## T\n**b** [l](u) `c` <i>x</i>\n---", None, "") == ["T\nb l c x", "", ""]
    assert one(spark, X.plain_line, "Title [**K**: a, **L**: b]", "```py\nx\n```a  b", None) == ["Title", "a b", ""]
    assert one(spark, lambda c: X.shortened(c, 5), "abc def", "abcdefg", "abc", None) == ["abc...", "abcde...", "abc", None]
    assert one(spark, X.long_date, "2026-01-05", "soon", "", None) == ["January 05, 2026", "soon", "Date unknown", "Date unknown"]
    assert one(spark, X.display_name, "University of Central Florida News | UCF Today", "FloridaAtlantic", None, "", "news.my-school.edu", "GreatCollege") == [
        "University of Central Florida", "Florida Atlantic University", "Unknown", "Unknown", "My School", "Great College",
    ]
    assert one(spark, X.matching_name, "The University of X", None) == ["x", None]
    assert one(spark, X.file_name_key, "The A & B—C,  D") == ["a and b c d"]
    assert one(spark, X.suspicious_name, "MIT", "psu.edu", "Rice University", "news") == [True, True, False, True]
    assert one(spark, X.escaped, "<a & 'b'>") == ["&lt;a &amp; &#x27;b&#x27;&gt;"]
    assert one(spark, X.said_yes, "AI-related: No", "3. Is this AI-related? yes", "nothing said", None) == [False, True, True, True]
    assert one(spark, X.subject_named, "uses nlp and robotics", "none", None) == ["NLP", "Other", "Other"]


def test_responses(spark):
    r = one(spark, X.response, "SUMMARY: one\n two\nKEY_POINTS:\n- a\n-b\nRELEVANCE: 7\nAI_RELATED: yes, it is\nSCIENTIFIC_IMPACT: 8/10\nFINANCIAL_IMPACT: high", "RELEVANCE: 8/10\nAI_RELATED: no", "")
    assert (r[0].summary, r[0].key_points, r[0].relevance, r[0].is_ai_related, r[0].scientific, r[0].financial) == ("one two", ["a", "b"], 7.0, True, 8.0, 1.0)
    assert (r[1].relevance, r[1].is_ai_related) == (5.0, False)
    assert (r[2].summary, r[2].key_points, r[2].relevance) == ("", [], 5.0)
    p = one(spark, X.picks, "PICK_1: none\nPICK_2:\nARTICLE_ID: 7\nEDITORIAL_NOTE: good\nwork\nIMPACT_CATEGORY: Policy", "no picks")
    assert [(x.rank, x.article_id, x.note, x.category) for x in p[0]] == [(2, 7, "good\nwork", "Policy")] and p[1] == []


@pytest.mark.parametrize("name", ["o'neil a1b"])
def test_initials(spark, name):
    assert one(spark, X.initials, "University of New Lands", name) == ["unl", "oa"]
