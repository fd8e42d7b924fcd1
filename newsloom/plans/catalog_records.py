"""Queries of the core on source files, exports, host states and lists; registered with those of the catalogue."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.functions import urls as U
from newsloom.operators import audit, classify, corrections, dedup, rate, reconcile, similar
from newsloom.operators.ordered import numbered
from newsloom.plans.catalog import _CLASSIFIED, DAY, NOW, _classes, _names, now, query
from newsloom.plans.materialize import shared_dir
from newsloom.sources import archive, configs, html, sinks, tables
from newsloom.sources.tables import table

_TITLE = "coalesce(nullif(title, ''), 'Untitled')"
_UNIVERSITY = "coalesce(nullif(university_name, ''), 'Unknown University')"
_DAY_ARTICLES = f"(SELECT a.article_id, a.title, a.university_name, a.published_date, a.summary, u.url, row_number() OVER (ORDER BY a.article_id) AS i FROM articles a JOIN urls u ON a.url_id = u.url_id WHERE a.is_ai_related AND a.published_date = DATE '{DAY}')"


def _day_articles(spark, d):
    a = table(spark, d, "articles").where(F.col("is_ai_related") & (F.col("published_date") == F.lit(DAY).cast("date")))
    return a.join(table(spark, d, "urls").select("url_id", "url"), "url_id")


# --- sources ----------------------------------------------------------------------------------------------------


@query(
    """SELECT kind, listed, services, array_to_string(files, ' ') AS files FROM (VALUES
    ('all', '', true, ['peer_institutions.json', 'r1_universities.json', 'major_facilities.json', 'national_laboratories.json', 'global_institutions.json', 'meta_news_services.json']),
    ('R1', '', false, ['r1_universities.json']), ('r1', ' a.json, b.json,', true, ['a.json', 'b.json']), ('unknown', '', false, ['universities.json']), ('meta_news', '', true, ['meta_news_services.json'])) t(kind, listed, services, files)"""
)
def source_sets(spark, d):
    """Files that each choice of sources reads."""
    asked = [("all", "", True), ("R1", "", False), ("r1", " a.json, b.json,", True), ("unknown", "", False), ("meta_news", "", True)]
    return spark.createDataFrame([(k, x, s, " ".join(configs.chosen_files(k, x, None, s))) for k, x, s in asked], "kind string, listed string, services boolean, files string")


_NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "urls", "articles", "ai_analyses", "host_crawl_state", "institutions", "pack_specs")


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, (SELECT count(*) FROM (DESCRIBE {n})) AS columns, (SELECT count(*) FROM {n}) AS rows" for n in _NAMES))
def table_catalogue(spark, d):
    return tables.described(spark, d, list(_NAMES))


@query(
    """SELECT hostname AS file, count(*) AS attempted, CAST(count_if(status = 'crawled') AS BIGINT) AS succeeded, CAST(count_if(status = 'failed') AS BIGINT) AS errors, max(hostname) AS failed FROM urls GROUP BY 1
    UNION ALL SELECT 'broken', NULL, NULL, NULL, NULL"""
)
def health_report_scan(spark, d):
    """Health reports written for each host and read back; one of them is no JSON."""
    u = table(spark, d, "urls").groupBy("hostname").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "crawled").alias("c"), F.count_if(F.col("status") == "failed").alias("e"))
    doc = F.to_json(F.struct(F.col("n").alias("sources_attempted"), F.col("c").alias("sources_succeeded"), F.struct(F.col("e").alias("errors")).alias("stats"), F.array("hostname").alias("failed_domains")))
    docs = u.select(F.col("hostname").alias("file"), doc.alias("document")).unionByName(spark.createDataFrame([("broken", '{"stats": ')], "file string, document string"))
    return archive.health_reports(docs).select("file", "attempted", "succeeded", "errors", F.col("failed")[0].alias("failed"))


@query(
    """SELECT 'https://' || domain || '/news' AS crawl_url, min(institution_id) AS seq FROM institutions WHERE institution_id % 4 > 1 GROUP BY 1
    UNION ALL SELECT 'https://' || domain || '/ai', institution_id FROM institutions WHERE institution_id % 4 = 1 AND institution_id % 3 <> 0 AND domain <> ''"""
)
def eligible_sources(spark, d):
    """Sources worth crawling: verified, with an address that is no placeholder; the page on the subject is preferred where there is one."""
    site = F.concat(F.lit("https://"), "domain")
    m = F.col("institution_id") % 4
    s = table(spark, d, "institutions").select(
        F.col("institution_id").alias("seq"), F.when(m == 0, F.lit("https://PLACEHOLDER.org")).otherwise(F.concat(site, F.lit("/news"))).alias("url"),
        F.when(m == 1, F.concat(site, F.lit("/ai"))).otherwise("").alias("ai_tag_url"), ((m != 1) | (F.col("institution_id") % 3 != 0)).alias("verified"), F.lit("").alias("rss_feed"),
    )
    return configs.eligible(s, prefer_tag=True).select("crawl_url", "seq")


@query(
    """SELECT url_id, CASE url_id % 3 WHEN 0 THEN 'https://' || hostname || '/tag/artificial-intelligence' WHEN 1 THEN 'https://x.example/ai/news' END AS link FROM urls"""
)
def subject_links(spark, d):
    m = F.col("url_id") % 3
    link = F.when(m == 0, "/Tag/Artificial-Intelligence").when(m == 1, "https://X.example/ai/news").otherwise("/sports/")
    body = F.concat(F.lit("<a HREF='/about'>a</a> <a class=x href=\""), link, F.lit('">b</a>'))
    return table(spark, d, "urls").select("url_id", html.subject_link(F.concat(F.lit("https://"), "hostname", F.lit("/a/b")), body).alias("link"))


@query("SELECT institution_id, len(list_distinct(list_transform(c, lambda x: rtrim(x, '/')))) AS candidates, CASE WHEN s IS NOT NULL THEN 'https://today.' || s || '.edu' END AS last_short FROM (SELECT institution_id, s, list_filter(['https://news.' || domain, 'https://www.' || domain || '/news', 'https://www.' || domain || '/news/', 'https://newsroom.' || domain, 'https://today.' || domain, 'https://' || domain || '/news', 'https://news.' || s || '.edu', 'https://www.' || s || '.edu/news', 'https://newsroom.' || s || '.edu', 'https://today.' || s || '.edu'], lambda x: x IS NOT NULL AND rtrim(x, '/') <> 'https://www.' || domain || '/news') AS c FROM (SELECT institution_id, domain, CASE WHEN length(abbreviation) <= 10 AND regexp_full_match(replace(lower(abbreviation), ' ', ''), '[a-z]+') THEN replace(lower(abbreviation), ' ', '') END AS s FROM institutions))")
def candidate_urls_short(spark, d):
    """Candidates by domain and by abbreviation, without the address in use: how many, and the last one by abbreviation."""
    i = table(spark, d, "institutions").select("institution_id", "abbreviation", U.candidates(F.col("domain"), F.concat(F.lit("https://www."), "domain", F.lit("/news/")), F.col("abbreviation")).alias("c"))
    last = F.try_element_at(F.filter("c", lambda x: x.rlike(r"^https://today\.[a-z]+\.edu$")), F.lit(1))
    return i.select("institution_id", F.size("c").cast("long").alias("candidates"), last.alias("last_short"))


# --- corrections ------------------------------------------------------------------------------------------------


def _batches(spark, d):
    """Reports of all batches in their layouts, written from the institutions."""
    i = table(spark, d, "institutions")
    old, new = F.concat(F.lit("http://"), "domain"), F.concat(F.lit("https://"), "domain")
    part = lambda k: i.where(F.col("institution_id") % 6 == k)
    broken = F.struct("name", old.alias("original_url"), new.alias("corrected_url"))
    two = part(0).select(F.to_json(F.struct(F.struct(F.array(broken).alias("broken_urls")).alias("batch_1_peer_institutions"))).alias("document")).unionByName(
        part(1).select(F.to_json(F.struct(F.struct(F.array(F.struct("name", new.alias("corrected_url"))).alias("broken_urls")).alias("batch_2_major_facilities"))).alias("document"))
    )
    three = part(2).select(F.to_json(F.struct(F.array(F.struct("name", old.alias("url"), new.alias("correct_url"))).alias("broken_urls"))).alias("document"))
    status = F.when(F.col("institution_id") % 4 < 2, "corrected").otherwise("ok")
    verified = F.to_json(F.struct(F.array(F.struct("name", old.alias("original_url"), new.alias("url"), status.alias("status"))).alias("verified_urls"))).alias("document")
    six = part(5).select(F.to_json(F.struct(F.array(F.struct(F.col("name").alias("university"), old.alias("original_url"), new.alias("corrected_url"))).alias("corrections"))).alias("document"))
    named = {"batches_1_2": two, "batch_3": three, "batch_4": part(3).select(verified), "batch_5": part(4).select(verified), "batch_6": six}
    out = spark.createDataFrame([("batch_3", "no JSON")], "batch string, document string")
    for batch, df in named.items():
        out = out.unionByName(df.select(F.lit(batch).alias("batch"), "document"))
    return out


_BATCHES = """(SELECT CASE institution_id % 6 WHEN 0 THEN 'batches_1_2' WHEN 1 THEN 'batches_1_2' ELSE 'batch_' || (institution_id % 6 + 1) END AS batch, name, CASE WHEN institution_id % 6 = 1 THEN '' ELSE 'http://' || domain END AS old_url,
    'https://' || domain AS new_url, CASE institution_id % 6 WHEN 0 THEN 'peer' WHEN 1 THEN 'facility' ELSE 'r1' END AS category FROM institutions WHERE institution_id % 6 NOT IN (3, 4) OR institution_id % 4 < 2)"""


@query(f"SELECT * FROM {_BATCHES}")
def batch_corrections(spark, d):
    return corrections.batch_corrections(_batches(spark, d))


@query(f"SELECT c.category, CAST(coalesce(n, 0) AS BIGINT) AS corrections FROM (VALUES ('peer'), ('r1'), ('facility')) c(category) LEFT JOIN (SELECT category, count(*) AS n FROM {_BATCHES} GROUP BY 1) b ON b.category = c.category")
def corrections_by_category(spark, d):
    return corrections.by_category(corrections.batch_corrections(_batches(spark, d)))


@query(
    """WITH i AS (SELECT institution_id AS seq, name, 'http://' || domain AS url FROM institutions), v AS (SELECT CASE WHEN institution_id % 2 = 0 THEN name ELSE 'The ' || name END AS name, min('https://' || domain) AS new_url FROM institutions GROUP BY 1),
    o AS (SELECT i.name, coalesce(a.new_url, b.new_url) AS n FROM (SELECT DISTINCT name FROM i) i LEFT JOIN v a ON a.name = i.name LEFT JOIN v b ON b.name = 'The ' || i.name)
    SELECT i.seq, i.name, coalesce(o.n, i.url) AS url, o.n IS NOT NULL AND o.n <> i.url AS changed FROM i JOIN o ON o.name = i.name"""
)
def name_variations(spark, d):
    i = table(spark, d, "institutions")
    records = i.select(F.col("institution_id").alias("seq"), "name", F.concat(F.lit("http://"), "domain").alias("url"))
    verified = i.select(F.when(F.col("institution_id") % 2 == 0, F.col("name")).otherwise(F.concat(F.lit("The "), "name")).alias("name"), F.concat(F.lit("https://"), "domain").alias("new_url"))
    variations = i.select(F.concat(F.lit("The "), "name").alias("name"), F.col("name").alias("variation"), F.col("institution_id").alias("place"))
    return corrections.by_variation(records, verified, variations)


@query(
    """SELECT institution_id AS id, 'https://' || domain || '/' AS url, CASE institution_id % 4 WHEN 0 THEN 'https://' || domain || '/topic/artificial-intelligence' WHEN 1 THEN 'https://' || domain || '/tag/artificial-intelligence'
    WHEN 2 THEN 'https://' || domain || '/tags/artificial-intelligence' END AS tag_url FROM institutions"""
)
def tag_pages(spark, d):
    i = table(spark, d, "institutions").select(F.col("institution_id").alias("id"), "domain")
    found = i.select("id", F.concat(F.lit("https://"), "domain", F.lit("/")).alias("url"))
    page = lambda s: F.concat(F.lit("https://"), "domain", F.lit(s))
    suffix = lambda k: page(corrections.TAG_SUFFIXES[k])
    m = F.col("id") % 4
    probes = i.select(F.explode(F.array(F.struct(suffix(0).alias("url"), (m == 0).alias("ok")), F.struct(suffix(1).alias("url"), (m < 2).alias("ok")), F.struct(suffix(2).alias("url"), (m < 3).alias("ok")))).alias("p")).select("p.*")
    return corrections.with_tag_pages(found, probes)


def _repairs(spark, d):
    tiers = [
        ("normal", F.when(F.col("url") != F.col("normalized_url"), F.col("normalized_url"))),
        ("scheme", F.when(F.col("url").startswith("http://"), F.replace("url", F.lit("http://"), F.lit("https://")))),
    ]
    return reconcile.repaired(table(spark, d, "urls").select("url_id", "url", "normalized_url"), tiers, "url")


_LOG = """(SELECT url_id, url AS old, CASE WHEN url <> normalized_url THEN normalized_url ELSE replace(url, 'http://', 'https://') END AS new, CASE WHEN url <> normalized_url THEN 'normal' ELSE 'scheme' END AS tier, false AS applied
    FROM urls WHERE url <> normalized_url OR starts_with(url, 'http://'))"""


@query(f"SELECT * FROM {_LOG}")
def change_log(spark, d):
    return reconcile.change_log(_repairs(spark, d), "url_id", "url", dry_run=True)


@query(f"SELECT tier, count(*) AS changes, count(DISTINCT new) AS values, min(new) AS sample FROM {_LOG} GROUP BY 1")
def changes_by_tier(spark, d):
    return reconcile.changes_by(reconcile.change_log(_repairs(spark, d), "url_id", "url", dry_run=False), "tier")


@query("SELECT count(*) AS entries, CAST(sum(1 + (region IS NOT NULL)::INT) AS BIGINT) AS sources, CAST(count_if(region IS NOT NULL) AS BIGINT) AS several FROM institutions")
def migration_totals(spark, d):
    url = lambda p: F.struct(F.lit("primary").alias("type"), F.concat(F.lit(p), "domain").alias("url"))
    s = reconcile.migrated(F.when(F.col("region").isNotNull(), url("https://")), F.array(url("https://news.")))
    return reconcile.migration_stats(table(spark, d, "institutions").select(s.alias("s")), "s")


@query(
    """SELECT r AS recommendation, count(*) AS urls FROM (SELECT CASE WHEN s >= 85 THEN 'proceed' WHEN s >= 60 THEN 'caution' WHEN s < 40 THEN 'review' ELSE 'skip' END AS r FROM (SELECT (CASE WHEN http_status_code = 200 THEN 30 ELSE 0 END) + 25
    + (CASE WHEN etag IS NOT NULL THEN 15 ELSE 0 END) + (CASE WHEN content_hash IS NOT NULL THEN 10 ELSE 0 END) + (CASE WHEN url_id % 2 = 0 THEN 10 ELSE 0 END) AS s FROM urls)) GROUP BY 1"""
)
def recommendations(spark, d):
    s = audit.confidence(
        reachable=F.col("http_status_code") == 200, institution=F.lit(True), branding=F.col("etag").isNotNull(), recent=F.lit(False), structured=F.col("content_hash").isNotNull(), article=F.col("url_id") % 2 == 0
    )
    return table(spark, d, "urls").groupBy(corrections.recommendation(s).alias("recommendation")).agg(F.count("*").alias("urls"))


# --- names ------------------------------------------------------------------------------------------------------


@query()
def missing_names(spark, d):
    """Names of articles that no listed institution equals, holds, is held by or is similar to."""
    return similar.unmatched(_names(spark, d), table(spark, d, "institutions").select("name"))


@query(
    """SELECT h.host, h.sitename, CASE WHEN h.host = '' THEN h.sitename ELSE coalesce(e.name, b.name, h.sitename, lower(h.host)) END AS canonical
    FROM (SELECT DISTINCT CASE WHEN url_id % 5 = 0 THEN '' ELSE upper(hostname) END AS host, 'Site ' || (url_id % 3) AS sitename FROM urls) h
    LEFT JOIN institutions e ON e.domain = lower(h.host) LEFT JOIN institutions b ON b.domain = regexp_extract(lower(h.host), '([^.]+\\.[^.]+)$', 1)"""
)
def canonical_site_name(spark, d):
    """Names of hosts with the name that the site gives itself; hosts without one fall back on it."""
    entries = table(spark, d, "institutions").select(F.col("institution_id").alias("seq"), F.col("domain").alias("host"), "name")
    host = F.when(F.col("url_id") % 5 == 0, "").otherwise(F.upper("hostname"))
    hosts = table(spark, d, "urls").select(host.alias("host"), F.concat(F.lit("Site "), (F.col("url_id") % 3).cast("string")).alias("sitename"))
    return classify.canonical_names(hosts, classify.host_dim(entries))


# --- exports ----------------------------------------------------------------------------------------------------


@query(
    f"""WITH a AS {_DAY_ARTICLES} SELECT 1 AS n, CASE WHEN count(*) = 0 THEN 'No articles found.' ELSE 'Digest - {DAY}' || chr(10) || repeat('=', 60) || chr(10) || chr(10) || 'Found ' || count(*) || ' AI-related articles' || chr(10) END AS head, NULL AS url FROM a
    UNION ALL SELECT i + 1, chr(10) || i || '. ' || {_TITLE} || chr(10) || '   ' || {_UNIVERSITY} || ' | ' || strftime(published_date, '%B %d, %Y'), url FROM a"""
)
def text_report(spark, d):
    """The text report of a day with its statistics in front; of each entry its first two lines and its address."""
    r = sinks.text_report(_day_articles(spark, d), [F.col("article_id")], DAY)
    item = F.col("n") > 1
    return r.select("n", F.when(item, F.regexp_extract("value", r"^(\n[^\n]*\n[^\n]*)", 1)).otherwise(F.col("value")).alias("head"), F.when(item, F.regexp_extract("value", r"Read more: (.*)$", 1)).alias("url"))


@query(
    f"""WITH a AS {_DAY_ARTICLES}, c AS (SELECT count(*) AS k FROM a) SELECT 1 AS n, 'Subject: Digest - {DAY} (' || k || ' articles)' AS value FROM c UNION ALL SELECT 2, 'From: a@x.example' FROM c UNION ALL SELECT 3, '--text/plain' FROM c
    UNION ALL SELECT 4, CASE WHEN k = 0 THEN 'No articles found.' ELSE 'Digest - {DAY}' END FROM c UNION ALL SELECT 4 + i, '' FROM a UNION ALL SELECT k + 5, '--text/html' FROM c UNION ALL SELECT k + 5 + i, '<div class="article"><h2>' FROM a, c UNION ALL SELECT 2 * k + 6, '--end' FROM c"""
)
def mail_message(spark, d):
    """The lines of a mail with a text and an HTML part; of each line how it begins."""
    m = sinks.multipart(_day_articles(spark, d), [F.col("article_id")], DAY, "a@x.example", ["b@x.example", "c@x.example"], "Thu, 20 Nov 2025 12:00:00 +0000")
    kind = F.regexp_extract("value", r"Content-Type: (text/\w+)", 1)
    v = (
        F.when(F.col("value").startswith("--"), F.when(kind == "", "--end").otherwise(F.concat(F.lit("--"), kind)))
        .when(F.col("value").startswith("<div"), F.substring("value", 1, 25))
        .otherwise(F.regexp_extract("value", r"^([^\n]*)", 1))
    )
    return m.select("n", v.alias("value"))


@query(
    f"""SELECT day, folder || '/' || file AS file, archived FROM (SELECT DISTINCT published_date AS day FROM articles WHERE published_date IS NOT NULL) d, (VALUES ('site'), ('docs')) f(folder),
    LATERAL (SELECT 'archive/' || strftime(day, '%Y-%m-%d') || '.html' AS file, true AS archived UNION ALL SELECT 'index.html', false WHERE day = DATE '{DAY}')"""
)
def page_files(spark, d):
    """Where each day's page goes: today's to the index and the archive, others to the archive, in two folders."""
    days = table(spark, d, "articles").select(F.col("published_date").alias("day")).distinct()
    return sinks.page_files(days, F.lit(DAY).cast("date"), ["site", "docs"])


@query("SELECT 2 AS version, institution_id, upper(name) AS name FROM institutions UNION ALL SELECT 1, institution_id, name FROM institutions")
def write_back_versions(spark, d):
    """A table written back twice: the second version holds the change, the first one stays as its backup."""
    path = f"{shared_dir(spark)}/institutions-{uuid.uuid4().hex}"
    i = table(spark, d, "institutions").select("institution_id", "name")
    first = sinks.written_back(i, path)
    second = sinks.written_back(sinks.version_of(spark, path, first).withColumn("name", F.upper("name")), path)
    both = [sinks.version_of(spark, path, v).withColumn("version", F.lit(v)) for v in (first, second)]
    return both[0].unionByName(both[1]).select("version", "institution_id", "name")


@query("SELECT url_id, CASE WHEN url_id IN (SELECT url_id FROM articles WHERE content IS NULL OR content = '') THEN 'excluded' ELSE status END AS status FROM urls")
def cascade_status(spark, d):
    """Addresses whose article is deleted are marked as excluded."""
    gone = table(spark, d, "articles").where("content IS NULL OR content = ''").select("url_id")
    return dedup.flagged(table(spark, d, "urls").select("url_id", "status"), gone, "url_id", "status", "excluded")


# --- hosts, lists and totals ------------------------------------------------------------------------------------


@query(
    """SELECT hostname, coalesce(c.at, h.last_crawl_time) AS last_crawl_time, CASE WHEN h.hostname IS NULL THEN 1.0 ELSE h.crawl_delay END AS crawl_delay, coalesce(c.robots, h.robots_txt_delay) AS robots_txt_delay FROM host_crawl_state h
    FULL JOIN (SELECT regexp_replace(hostname, '^www', 'new') AS hostname, max(last_checked) AS at, CAST(7 AS DOUBLE) AS robots FROM urls WHERE last_checked IS NOT NULL GROUP BY 1) c USING (hostname)"""
)
def host_state_update(spark, d):
    """Host states after all crawls; hosts without a state get one."""
    host = F.regexp_replace("hostname", "^www", "new")
    c = table(spark, d, "urls").where(F.col("last_checked").isNotNull()).select(host.alias("hostname"), F.col("last_checked").alias("at"), F.lit(None).cast("double").alias("crawl_delay"), F.lit(7.0).alias("robots_txt_delay"))
    return rate.updated_hosts(table(spark, d, "host_crawl_state"), c).drop("blocked_until")


@query(
    """SELECT hostname, coalesce(b.until, h.blocked_until) AS blocked_until, coalesce(h.last_crawl_time, b.at) AS last_crawl_time FROM host_crawl_state h
    FULL JOIN (SELECT regexp_replace(hostname, '^www', 'new') AS hostname, max(last_checked) AS at, max(last_checked) + INTERVAL 10 MINUTE AS until FROM urls WHERE http_status_code IN (429, 503) AND last_checked IS NOT NULL GROUP BY 1) b USING (hostname)"""
)
def host_block(spark, d):
    """Host states after answers that ask to wait: each blocks its host for ten minutes."""
    u = table(spark, d, "urls").where(F.col("http_status_code").isin(429, 503) & F.col("last_checked").isNotNull())
    b = u.select(F.regexp_replace("hostname", "^www", "new").alias("hostname"), F.col("last_checked").alias("at"), F.lit(600).alias("seconds"))
    return rate.blocked_hosts(table(spark, d, "host_crawl_state"), b).select("hostname", "blocked_until", "last_crawl_time")


@query("SELECT count(*) AS urls, CAST(count_if(status = 'crawled') AS BIGINT) AS crawled, CAST(count_if(status = 'failed') AS BIGINT) AS errors, count(DISTINCT hostname) AS attempted, count(DISTINCT CASE WHEN status = 'crawled' THEN hostname END) AS succeeded FROM urls")
def crawl_totals(spark, d):
    return audit.crawl_totals(table(spark, d, "urls"))


@query(
    """SELECT institution_id AS seq, category IN ('peer', 'hpc') AS priority, category IN ('peer', 'hpc') AND row_number() OVER (PARTITION BY category IN ('peer', 'hpc') ORDER BY institution_id) <= 20 AS chosen FROM institutions"""
)
def priority_sources(spark, d):
    kind = F.when(F.col("category") == "peer", "peer").when(F.col("category") == "hpc", "Computing Facility").otherwise(F.col("category"))
    s = table(spark, d, "institutions").select(F.col("institution_id").alias("seq"), kind.alias("kind"))
    return audit.priority_split(s).select("seq", "priority", "chosen")


@query("SELECT row_number() OVER (ORDER BY name) AS place, name FROM institutions")
def source_list(spark, d):
    """Listed institutions in the order of their names."""
    return numbered(table(spark, d, "institutions").select("name"), [F.col("name")], "place").select("place", "name")


@query("SELECT row_number() OVER (ORDER BY day DESC) AS place, day FROM (SELECT DISTINCT published_date AS day FROM articles WHERE published_date IS NOT NULL)")
def archive_index(spark, d):
    """Days of the archive, the newest first."""
    days = table(spark, d, "articles").where(F.col("published_date").isNotNull()).select(F.col("published_date").alias("day")).distinct()
    return numbered(days, [F.desc("day")], "place").select("place", "day")


@query("SELECT article_id, first_scraped FROM articles ORDER BY first_scraped DESC, article_id LIMIT 1")
def latest_article(spark, d):
    return table(spark, d, "articles").select("article_id", "first_scraped").orderBy(F.desc("first_scraped"), "article_id").limit(1)


@query(f"SELECT a.article_id FROM articles a JOIN ({_CLASSIFIED}) c ON c.name = a.university_name WHERE c.category = 'peer'")
def tab_filter(spark, d):
    """Articles of the tab of one class."""
    a = table(spark, d, "articles").select("article_id", F.col("university_name").alias("name"))
    return a.join(_classes(spark, d).where("category = 'peer'"), "name").select("article_id")


@query(
    """SELECT article_id, 'ARTICLE_ID: ' || article_id || chr(10) || 'TITLE: ' || coalesce(title, 'Untitled') || chr(10) || 'UNIVERSITY: ' || coalesce(university_name, 'Unknown') || chr(10) || 'SUMMARY: ' || substr(coalesce(summary, ''), 1, 200) AS block,
    substr(coalesce(content, ''), 1, 3000) AS short FROM articles WHERE is_ai_related"""
)
def prompt_blocks(spark, d):
    """An article's block in an editor's prompt, and its content as a short prompt takes it."""
    or_ = lambda c, x: F.coalesce(F.col(c), F.lit(x))
    block = F.concat(F.lit("ARTICLE_ID: "), F.col("article_id").cast("string"), F.lit("\nTITLE: "), or_("title", "Untitled"), F.lit("\nUNIVERSITY: "), or_("university_name", "Unknown"), F.lit("\nSUMMARY: "), F.substring(or_("summary", ""), 1, 200))
    return table(spark, d, "articles").where("is_ai_related").select("article_id", block.alias("block"), F.substring(or_("content", ""), 1, 3000).alias("short"))


@query(f"SELECT hostname, last_crawl_time < TIMESTAMP '{NOW}' AS before FROM host_crawl_state WHERE last_crawl_time IS NOT NULL ORDER BY last_crawl_time DESC, hostname LIMIT 20")
def newest_hosts(spark, d):
    h = table(spark, d, "host_crawl_state").where(F.col("last_crawl_time").isNotNull())
    return h.orderBy(F.desc("last_crawl_time"), "hostname").limit(20).select("hostname", (F.col("last_crawl_time") < now()).alias("before"))


@query(
    """SELECT coalesce(u.url_id, a.url_id) AS id, coalesce(a.status, u.status) AS status, u.hostname AS host, a.hash FROM urls u
    FULL JOIN (SELECT url_id, 'scraped' AS status, max(content_hash) AS hash FROM articles WHERE url_id IS NOT NULL GROUP BY 1) a ON a.url_id = u.url_id"""
)
def metadata_merge(spark, d):
    """Maps of addresses put together with those of their articles: entries of the articles win, others stay."""
    pairs = lambda keys, *values: F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*values)).alias("m")
    old = table(spark, d, "urls").select(F.col("url_id").alias("id"), pairs(("status", "host"), "status", "hostname"))
    new = table(spark, d, "articles").where(F.col("url_id").isNotNull()).select(F.col("url_id").alias("id"), pairs(("status", "hash"), F.lit("scraped"), "content_hash"))
    return dedup.merged_maps(old, new, "id", "m").select("id", *(F.col("m")[k].alias(k) for k in ("status", "host", "hash")))


@query(
    """SELECT raw, display FROM (VALUES ('tamu.edu', 'Texas A&M University'), ('FloridaAtlantic', 'Florida Atlantic University'), ('University of Central Florida News | UCF Today', 'University of Central Florida'), ('my-lab_site.edu', 'My Lab Site'),
    ('www.cs.example.org', 'Example'), ('UMassLowell', 'UMass Lowell'), ('BigRiver College Newsroom', 'Big River College'), ('', 'Unknown'), (NULL, 'Unknown'), (' | x', 'Unknown'), ('The Brink', 'Boston University')) t(raw, display)"""
)
def display_name_shapes(spark, d):
    """Display names by each rule: listed ones, names with a tail, bare hosts, words written together, and missing ones."""
    raw = ["tamu.edu", "FloridaAtlantic", "University of Central Florida News | UCF Today", "my-lab_site.edu", "www.cs.example.org", "UMassLowell", "BigRiver College Newsroom", "", None, " | x", "The Brink"]
    return spark.createDataFrame([(x,) for x in raw], "raw string").select("raw", X.display_name(F.col("raw")).alias("display"))
