import hashlib
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newsloom.operators import audit, bloom, classify, consensus, corrections, curate, dedup, latest, ordered, rate, reconcile, reports, similar


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_first_seen_and_upsert(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, None), (None, 3, "z"), (None, 4, "w")], "k string, seq int, v string")
    assert rows(dedup.first_of_each(df, ["k"], [F.col("seq")]), "seq", "v") == [("b", 1, None), ("a", 1, "y"), (None, 3, "z")]
    seen = spark.createDataFrame([("a",), ("a",)], "k string")
    assert dedup.unseen(df, seen, "k").count() == 3 and dedup.already_seen(df, seen, "k").count() == 2
    assert rows(dedup.upserted(df.where("k = 'a'"), spark.createDataFrame([("a", 9, "n"), ("c", 1, "m")], df.schema), "k"), "k") == [("a", 9, "n"), ("c", 1, "m")]
    assert rows(dedup.duplicate_groups(df, "k", "seq")) == [("a", 2, 1)]
    assert dedup.first_of_each(df.limit(0), ["k"], [F.col("seq")]).count() == 0


def test_latest_and_as_of(spark):
    a = spark.createDataFrame([(1, 10, 5, "p"), (1, 10, 6, "q"), (1, 12, 7, "r"), (2, None, 8, "s")], "k long, at int, id long, v string").withColumn("at", F.timestamp_seconds(F.col("at") * 1_000_000))
    assert rows(latest.latest_per(a, "k", "at", "id").select("id", "v")) == [(7, "r")]
    assert rows(latest.latest_per(a, "k", "at", "id", F.timestamp_seconds(F.lit(11_000_000))).select("id", "v")) == [(6, "q")]
    left = spark.createDataFrame([(1, 9), (1, 10), (1, 20), (3, 5), (1, None)], "k long, t int").withColumn("at", F.timestamp_seconds(F.col("t") * 1_000_000))
    got = latest.as_of_join(left, a, "k", "at", "at", "id", ["v"]).select("k", "t", "v")
    assert rows(got, "k", "t") == [(1, None, None), (1, 9, None), (1, 10, "q"), (1, 20, "r"), (3, 5, None)]


def test_consensus(spark):
    arts = spark.createDataFrame([(i,) for i in range(1, 5)], "article_id long")
    v = spark.createDataFrame(
        [(1, 1, True, 8.0, ""), (1, 2, False, None, "b"), (2, 2, True, None, "o"), (3, 1, True, 4.0, "c"), (3, 2, True, None, "o"), (3, 3, None, None, "g")],
        "article_id long, priority int, vote boolean, relevance double, summary string",
    )
    got = {r.article_id: r for r in consensus.consensus(arts, v).collect()}
    assert (got[1].is_ai_related, got[1].relevance, got[1].summary) == (False, 8.0, "b") and abs(got[1].confidence - 2 / 3) < 1e-9  # a tie is no
    assert (got[2].is_ai_related, got[2].relevance) == (True, 5.0) and abs(got[2].confidence - 1 / 3) < 1e-9
    assert (got[3].providers, got[3].summary) == (2, "c")
    assert (got[4].is_ai_related, got[4].relevance, got[4].confidence, got[4].summary) == (None, 0.0, 0.0, "Analysis unavailable")


def test_classes(spark):
    dim = spark.createDataFrame([("TACC", "hpc"), ("Argonne Lab", "national_lab"), ("Auburn University", "peer"), ("auburn university", "r1")], "name string, category string")
    names = spark.createDataFrame([("tacc",), ("AUBURN UNIVERSITY",), ("Other",), ("The Argonne Lab Annex",), (None,)], "name string")
    assert dict(rows(classify.exact_class(names, dim))) == {"tacc": "hpc", "AUBURN UNIVERSITY": "peer", "Other": "r1", "The Argonne Lab Annex": "r1", None: "r1"}
    assert dict(rows(classify.fuzzy_class(names, dim)))["The Argonne Lab Annex"] == "national_lab"
    l, r = ["abc", "xabcx", "ab", "zzz"], ["abc", "bcx", "q", "xabcxy"]  # noqa: E741
    got = set(rows(classify.containing(spark.createDataFrame([(x,) for x in l], "l string"), spark.createDataFrame([(x,) for x in r], "r string"))))
    assert got == {(a, b) for a in l for b in r if len(a) > 2 and len(b) > 2 and (a in b or b in a)}
    entries = spark.createDataFrame([(1, "news.a.edu", "A1"), (2, "news.a.edu", "A2"), (3, "x.a.edu", "A3"), (4, "b.edu", "B")], "seq long, host string, name string")
    hosts = spark.createDataFrame([("news.a.edu",), ("y.a.edu",), ("b.edu",), ("c.edu",)], "host string")
    assert dict(rows(classify.canonical_names(hosts, classify.host_dim(entries)))) == {"news.a.edu": "A2", "y.a.edu": "A1", "b.edu": "B", "c.edu": "c.edu"}


def test_similar_names_against_all_pairs(spark):
    from difflib import SequenceMatcher

    a = ["University of Oslo", "Univ. of Oslo", "Oslo University", "Tech", "Tech.", "aaaaaaaaaaaa", "Lund College", "", None, "x"]
    b = ["University of Oslo", "Oslo Universität", "Tech", "aaaaaaaaaaa", "Lund Collage", "University of Osla"]
    got = {(r.l, r.r) for r in similar.similar_names(spark.createDataFrame([(x,) for x in a], "l string"), spark.createDataFrame([(x,) for x in b], "r string")).collect()}
    assert got == {(x, y) for x in a for y in b if x and len(x) > 1 and SequenceMatcher(None, x, y).ratio() >= 0.85}


def test_common_letters_bound_the_ratio():
    import random
    from difflib import SequenceMatcher

    random.seed(2)
    words = ["".join(random.choices("abcéß ", k=random.choice([0, 1, 5, 30, 63, 64]))) for _ in range(60)]
    pairs = [(x, y) for x in words for y in words]

    def longest(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            row = _step(row, c, y)
        return row[-1]

    def _step(row, c, y):
        new = [0]
        for j, d in enumerate(y):
            new.append(max(new[-1], row[j + 1], row[j] + (c == d)))
        return new

    got = similar.common_letters([x for x, _ in pairs], [y for _, y in pairs]).tolist()
    assert got == [longest(x, y) for x, y in pairs]
    assert all(2 * g >= SequenceMatcher(None, x, y).ratio() * (len(x) + len(y)) - 1e-9 for g, (x, y) in zip(got, pairs))


def test_bloom_holds_what_was_added(spark):
    size = 997
    old = spark.createDataFrame([(f"u{i}",) for i in range(60)] + [(None,)], "k string")
    new = spark.createDataFrame([(f"u{i}",) for i in range(40, 300)], "k string")
    bits = {int(hashlib.sha256(f"u{i}{s}".encode()).hexdigest(), 16) % size for i in range(60) for s in range(3)}
    expected = {f"u{i}" for i in range(40, 300) if all(int(hashlib.sha256(f"u{i}{s}".encode()).hexdigest(), 16) % size in bits for s in range(3))}
    assert {r.k for r in bloom.maybe_seen(new, "k", bloom.built(old, "k", size), size).collect()} == expected
    rate_at = spark.createDataFrame([(0,), (100_000,)], "n long").select(bloom.false_positive_rate(F.col("n")).alias("r")).collect()
    assert rate_at[0].r == 0 and 2.4e-5 < rate_at[1].r < 2.7e-5


def test_rates(spark):
    log = spark.createDataFrame([("h", i, datetime(2024, 1, 1) + timedelta(seconds=s)) for i, s in enumerate([0, 1, 1, 2, 60])] + [("g", 9, datetime(2024, 1, 1))], "host string, id long, at timestamp")
    got = {r.id: (r.allowed, r.wait_s) for r in rate.gaps(log, "host", "at", "id", 1.0).collect()}
    assert got == {0: (True, 0.0), 1: (True, 0.0), 2: (False, 1.0), 3: (True, 0.0), 4: (True, 0.0), 9: (True, 0.0)}
    bucket = {r.id: r.allowed for r in rate.token_bucket(log, "host", "at", "id", 0.1, 2.0).collect()}
    assert bucket == {0: True, 1: True, 2: False, 3: False, 4: True, 9: True}
    now = F.lit("2024-01-01 00:00:10").cast("timestamp_ntz")
    hosts = spark.createDataFrame([("a", "2024-01-01 00:00:08", 1.0, 0.0, None), ("b", "2024-01-01 00:00:08", 1.0, 5.0, None), ("c", None, None, None, "2024-01-01 00:01:00"), ("d", None, None, None, None)], "hostname string, l string, crawl_delay double, robots_txt_delay double, b string")
    hosts = hosts.withColumn("last_crawl_time", F.col("l").cast("timestamp_ntz")).withColumn("blocked_until", F.col("b").cast("timestamp_ntz"))
    assert {r.hostname: (r.delay_s, r.allowed) for r in rate.may_crawl(hosts, now).collect()} == {"a": (1.0, True), "b": (5.0, False), "c": (1.0, False), "d": (1.0, True)}


def test_audit(spark):
    s = spark.createDataFrame([("zero", 404, True, 0, False, False), ("never", None, True, 0, False, False), ("good", 200, True, 9, True, False), ("zero", 200, True, 9, False, False), ("zero", 200, True, 1, False, False), ("stale", 200, True, 9, False, True), ("good", 200, True, 9, True, True), ("never", None, False, 0, False, False)], "status string, http_status int, probed boolean, links int, rss_found boolean, rss_configured boolean")
    assert [r.action for r in audit.decided(s.withColumn("i", F.monotonically_increasing_id())).orderBy("i").collect()] == ["FIX_URL", "FIX_URL", "ADD_RSS", "INVESTIGATE", "REVIEW_NEWS_URL", "CHECK_AI_FILTER", "OK", "INVESTIGATE"]
    sizes = [r["count"] for r in audit.batches(spark.range(17), [F.col("id")], 5, 4).groupBy("part").count().orderBy("part").collect()]
    assert sizes == [4, 4, 3, 3, 3]
    bins = [r[0] for r in spark.createDataFrame([(0.0,), (0.25,), (0.9,), (1.0,)], "s double").select(audit.completeness_bin(F.col("s"))).collect()]
    assert bins == ["0-25", "25-50", "90-100", "90-100"]
    full = audit.confidence(**dict.fromkeys(audit.CONFIDENCE, F.lit(True)))
    only = audit.confidence(**{**dict.fromkeys(audit.CONFIDENCE, F.lit(None).cast("boolean")), "reachable": F.lit(True)})
    r = spark.range(1).select(full.alias("a"), only.alias("b"), audit.confidence_class(full).alias("c"), audit.confidence_class(only).alias("d")).first()
    assert tuple(r) == (100, 30, "VALID", "INVALID")


def test_reconcile(spark):
    df = spark.createDataFrame([("k", "u2", 1, False, 1), ("k", "u1", 3, True, 2), ("k", "u1", 2, None, 3), ("m", None, None, None, 4)], "k string, u string, p int, ok boolean, seq int")
    assert rows(reconcile.merged_sets(df, "k", "u", "p", "ok"), "k") == [("k", 3, "u1", "u2", 3, True), ("m", 1, None, "", None, None)]
    assert rows(reconcile.best_by_score(df.where("k = 'k'"), "k", "u", F.lit(1), "seq")) == [("k", "u2", 1)]
    a = spark.createDataFrame([("x", "p", False), ("y", "q", True), ("z", "r", None)], "k string, v string, ok boolean")
    b = spark.createDataFrame([("x", "P", True), ("y", "Q", True), ("z", "R", False)], "k string, v string, ok boolean")
    assert rows(reconcile.cross_file(a, b, "k", "v", "ok"), "k") == [("x", "P", True, True), ("y", "q", True, False), ("z", "r", False, False)]
    fixed = reconcile.repaired(a, [("t1", F.when(F.col("k") == "x", F.lit("p"))), ("t2", F.when(F.col("k") == "y", F.lit("n")))], "v")
    assert rows(fixed.select("k", "tier", "changed"), "k") == [("x", "t1", False), ("y", "t2", True), ("z", "review", False)]
    assert [r.v for r in reconcile.applied(fixed, "v", True).orderBy("k").collect()] == ["p", "q", "r"] and [r.v for r in reconcile.applied(fixed, "v", False).orderBy("k").collect()] == ["p", "n", "r"]


def test_reports(spark):
    a = spark.createDataFrame([(1, "A", ["x", "", "y", "z", "v"]), (2, None, ["x"]), (3, "A", None)], "article_id long, university_name string, keywords array<string>")
    assert rows(reports.institution_counts(a), "university") == [("A", 2, 1), ("Unknown", 1, 2)]
    assert rows(reports.top_topics(a)) == [("x", 2), ("y", 1), ("z", 1)]
    c = spark.createDataFrame([("peer",)], "category string")
    assert rows(reports.category_counts(c, ["peer", "hpc"]), "category") == [("hpc", 0), ("peer", 1)]
    v = reports.visible(spark.createDataFrame([("g", i) for i in range(5)], "g string, i int"), "g", [F.col("i")], 3)
    assert rows(v.select("i", "position", "more"), "i") == [(0, 1, 2), (1, 2, 2), (2, 3, 2)]
    m = spark.createDataFrame([(1, '{"impact_scores": {"scientific": 6}}'), (2, None), (3, "broken")], "article_id long, article_metadata string")
    assert {r.article_id: r.composite for r in curate.candidates(m).collect()} == {1: 4.0, 2: 3.0, 3: 3.0}


def test_order_over_whole_tables(spark):
    df = spark.range(1000).select(F.pmod(F.col("id") * 7919, F.lit(1000)).alias("v"), F.lit(1).alias("n1")).repartition(7)
    assert all(r.n == r.v + 1 for r in ordered.numbered(df, [F.col("v")]).collect())
    assert ordered.numbered(df.limit(0), [F.col("v")]).count() == 0
    for total, parts in ((17, 5), (3, 5), (20, 4), (1, 1)):
        got = [r[0] for r in spark.range(1, total + 1).select(ordered.even_parts(F.col("id"), F.lit(total), parts)).collect()]
        assert got == sorted(got) and [got.count(p) for p in range(1, parts + 1)] == [total // parts + (p <= total % parts) for p in range(1, parts + 1)]


def test_slices_of_time_change_nothing(spark):
    import random

    random.seed(1)
    data = [(random.choice("hhhg"), i, datetime(2024, 1, 1) + timedelta(hours=random.randrange(400)), random.choice([None, i])) for i in range(300)] + [("z", 900, None, 1)]
    df = spark.createDataFrame(data, "k string, id long, at timestamp, v long")
    want_previous, want_carried, last, value = {}, {}, {}, {}
    for k, i, at, v in sorted((x for x in data if x[2]), key=lambda x: (x[2], x[1])):
        want_previous[i], last[k] = last.get(k), at
        value[k] = v if v is not None else value.get(k)
        want_carried[i] = value[k]
    want_previous[900] = want_carried[900] = None
    assert {r.id: r.previous for r in ordered.previous(df, "k", "at", "id", 3600 * 30).collect()} == want_previous
    assert {r.id: r.carried for r in ordered.carried(df, "k", "at", ["id"], "v", 3600 * 50).collect()} == want_carried


def test_corrections(spark):
    a = spark.createDataFrame([("A U", "old", "new"), ("B", "o", "")], "institution string, original_url string, corrected_url string")
    b = spark.createDataFrame([("C College", None)], "name string, new_url string")
    assert rows(corrections.unified([a, b])) == [("A U", "old", "new", None)]
    records = spark.createDataFrame([(1, "The A-U", "x"), (2, "A U Annex", "y"), (3, "None", "z"), (4, None, "w")], "seq int, name string, url string")
    got = {r.seq: (r.new_url, r.changed) for r in corrections.matched(records, corrections.unified([a])).collect()}
    assert got == {1: ("new", True), 2: ("new", True), 3: ("z", False), 4: ("w", False)}
    c = spark.createDataFrame([(1, ["p", "q"]), (2, ["r"])], "id int, urls array<string>")
    p = spark.createDataFrame([("q", True), ("p", None), ("r", False)], "url string, ok boolean")
    assert rows(corrections.first_working(c, p)) == [(1, "q", 1)]
    u = spark.createDataFrame([("u/topic/ai", "u"), ("u", "u"), (None, "u")], "a string, b string")
    assert [r[0] for r in u.select(corrections.repaired_filter(F.col("a"), F.col("b"))).collect()] == ["u", "u", None]
