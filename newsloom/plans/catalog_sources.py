"""Queries of the core on source records, reports and prompts; registered with those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.operators import audit, corrections, dedup, latest, quality, reconcile, reports
from newsloom.plans.catalog import _SQL_SPACE, _SQL_TOPIC, _sql_plain, DAY, NOW, now, query
from newsloom.plans.materialize import shared_dir
from newsloom.sources import html, sinks
from newsloom.sources.tables import table


@query("SELECT institution_id, trim(concat_ws(', ', city, region)) AS location, replace(domain, 'www.', '') AS domain FROM institutions")
def location_text(spark, d):
    return table(spark, d, "institutions").select("institution_id", F.trim(F.concat_ws(", ", "city", "region")).alias("location"), F.replace("domain", F.lit("www."), F.lit("")).alias("domain"))


@query(
    f"""SELECT a.article_id, coalesce(t.topics, '') AS topics FROM articles a LEFT JOIN (SELECT article_id, string_agg(topic, ' | ' ORDER BY i) AS topics FROM (SELECT article_id, i, {_SQL_TOPIC} AS topic
    FROM (SELECT article_id, unnest(keywords[1:4]) AS k, generate_subscripts(keywords[1:4], 1) AS i FROM articles)) WHERE topic <> '' AND length(topic) < 50 GROUP BY 1) t USING (article_id) WHERE a.keywords IS NOT NULL"""
)
def topic_list(spark, d):
    return table(spark, d, "articles").where(F.col("keywords").isNotNull()).select("article_id", F.array_join(reports.topics_of(F.col("keywords")), " | ").alias("topics"))


@query("SELECT article_id, 'Title: ' || coalesce(title, '') || chr(10) || chr(10) || 'Content: ' || substr(coalesce(content, ''), 1, 4000) AS prompt FROM articles WHERE last_analyzed IS NULL")
def prompts(spark, d):
    a = table(spark, d, "articles").where(F.col("last_analyzed").isNull())
    return a.select("article_id", F.concat(F.lit("Title: "), F.coalesce("title", F.lit("")), F.lit("\n\nContent: "), F.substring(F.coalesce("content", F.lit("")), 1, 4000)).alias("prompt"))


@query("SELECT analysis_id, trim(openai_summary) AS summary, gemini_sentiment IS NOT NULL AS is_ai_related FROM ai_analyses WHERE trim(openai_summary) <> ''")
def parse_short_response(spark, d):
    a = table(spark, d, "ai_analyses").where("trim(openai_summary) <> ''")
    written = F.concat(F.lit("SUMMARY: "), F.trim("openai_summary"), F.lit("\nAI_RELATED: "), F.when(F.col("gemini_sentiment").isNotNull(), "Yes.").otherwise("No."))
    return a.select("analysis_id", X.short_response(written).alias("r")).select("analysis_id", "r.summary", "r.is_ai_related")


@query(
    f"""SELECT article_id FROM articles WHERE is_ai_related AND ai_confidence_score >= 0.5 AND published_date BETWEEN DATE '{DAY}' - 30 AND DATE '{DAY}'"""
)
def report_by_confidence(spark, d):
    return reports.selected(table(spark, d, "articles"), days=(F.date_sub(F.lit(DAY).cast("date"), 30), F.lit(DAY).cast("date")), min_confidence=0.5).select("article_id")


@query("SELECT url_id FROM (SELECT url_id, CASE WHEN url_id % 10 = 0 THEN upper(status) WHEN url_id % 10 <> 1 THEN status END AS status FROM urls) WHERE status IS NULL OR status NOT IN ('pending', 'crawled', 'failed', 'redirect', 'excluded')")
def invalid_status(spark, d):
    """Rows whose status is none of the known ones; some are spoilt first, because the tables hold none."""
    m = F.col("url_id") % 10
    u = table(spark, d, "urls").withColumn("status", F.when(m == 0, F.upper("status")).when(m != 1, F.col("status")))
    return u.where(~F.coalesce(F.col("status").isin("pending", "crawled", "failed", "redirect", "excluded"), F.lit(False))).select("url_id")


@query("SELECT url_id FROM urls WHERE status = 'failed' AND (http_status_code IS NULL OR http_status_code IN (403, 404))")
def fallback_candidates(spark, d):
    return table(spark, d, "urls").where((F.col("status") == "failed") & (F.col("http_status_code").isNull() | F.col("http_status_code").isin(403, 404))).select("url_id")


@query("SELECT url_id, http_status_code IN (408, 429, 500, 502, 503, 504) AS retry FROM urls WHERE status = 'failed' AND http_status_code IS NOT NULL")
def retry_candidates(spark, d):
    return table(spark, d, "urls").where((F.col("status") == "failed") & F.col("http_status_code").isNotNull()).select("url_id", F.col("http_status_code").isin(408, 429, 500, 502, 503, 504).alias("retry"))


@query(
    """SELECT url_id, CASE WHEN status = 'crawled' THEN 'verified but broken' ELSE 'unverified but working' END AS mismatch FROM urls
    WHERE (status = 'crawled' AND NOT coalesce(http_status_code IN (200, 301, 302, 303, 307, 308), false)) OR (status <> 'crawled' AND http_status_code IN (200, 301, 302, 303, 307, 308))"""
)
def verified_mismatch(spark, d):
    u = table(spark, d, "urls").select("url_id", (F.col("status") == "crawled").alias("verified"), audit.outcome(F.col("http_status_code"), F.lit(0)).alias("outcome"))
    return corrections.mismatches(u).select("url_id", "mismatch")


_KEY = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '^the ', ''), '[-–—,]', ' ', 'g'), '&', ' and ', 'g'), '\\s+', ' ', 'g'))"


@query(
    f"""WITH i AS (SELECT institution_id AS seq, {_KEY.format('name')} AS l, 'https://' || domain AS url FROM institutions),
    c AS (SELECT {_KEY.format("upper(name)")} AS r, 'https://new.' || domain AS new_url, institution_id AS place FROM institutions WHERE institution_id % 3 = 0
      UNION ALL SELECT {_KEY.format("'The ' || city")}, 'https://other.' || domain, institution_id FROM institutions WHERE institution_id % 3 = 1),
    m AS (SELECT i.l, arg_min(c.new_url, (c.place, c.r, c.new_url)) AS new_url FROM i JOIN c ON length(r) >= 3 AND length(l) >= 3 AND (contains(l, r) OR contains(r, l)) GROUP BY 1)
    SELECT i.seq, coalesce(m.new_url, i.url) AS new_url, m.new_url IS NOT NULL AND m.new_url <> i.url AS changed FROM i LEFT JOIN m USING (l)"""
)
def apply_corrections(spark, d):
    """Corrections in two report layouts, written from the table, matched by the same name or by one that holds the other, the first one winning."""
    i = table(spark, d, "institutions")
    place = F.col("institution_id").alias("place")
    one = i.where("institution_id % 3 = 0").select(F.upper("name").alias("institution"), F.lit("x").alias("old_url"), F.concat(F.lit("https://new."), "domain").alias("new_url"), place)
    two = i.where("institution_id % 3 = 1").select(F.concat(F.lit("The "), "city").alias("university"), F.lit("x").alias("original_url"), F.concat(F.lit("https://other."), "domain").alias("corrected_url"), place)
    records = i.select(F.col("institution_id").alias("seq"), "name", F.concat(F.lit("https://"), "domain").alias("url"))
    return corrections.matched(records, corrections.unified([one, two])).select("seq", "new_url", "changed")


@query("SELECT url_id, url || '/topic/ai' AS broken, normalized_url AS repaired FROM urls")
def repair_filter_urls(spark, d):
    u = table(spark, d, "urls").withColumn("a", F.concat("url", F.lit("/topic/ai")))
    return u.select("url_id", F.col("a").alias("broken"), corrections.repaired_filter(F.col("a"), F.col("normalized_url")).alias("repaired"))


@query(
    """SELECT hostname, CASE WHEN ok > 0 THEN 'ok' WHEN redirects > 0 THEN 'replace' ELSE 'both_failed' END AS verdict
    FROM (SELECT hostname, count_if(http_status_code = 200) AS ok, count_if(http_status_code IN (301, 302)) AS redirects FROM urls GROUP BY 1)"""
)
def verification_table(spark, d):
    u = table(spark, d, "urls").groupBy("hostname").agg(F.count_if(F.col("http_status_code") == 200).alias("ok"), F.count_if(F.col("http_status_code").isin(301, 302)).alias("redirects"))
    return u.select("hostname", corrections.verification(F.col("ok") > 0, F.col("redirects") > 0).alias("verdict"))


@query(
    """SELECT article_id, CASE WHEN (len(list_filter(regexp_split_to_array(lower(university_name), '\\s+'), lambda w: length(w) > 3 AND contains(lower(content), w))) > 0) AND n >= 2 THEN 'institution_news'
    WHEN n >= 2 THEN 'news' ELSE 'other' END AS page, s AS score FROM (SELECT article_id, university_name, content,
    (contains(lower(content), 'news')::INT + contains(lower(content), 'press release')::INT + contains(lower(content), 'article')::INT + contains(lower(content), 'story')::INT + contains(lower(content), 'stories')::INT
    + contains(lower(content), 'newsroom')::INT + contains(lower(content), 'media')::INT + contains(lower(content), 'announcements')::INT + contains(lower(content), 'latest')::INT) AS n,
    (CASE WHEN regexp_matches(lower(content), 'news|press|article|story') THEN 50 ELSE 0 END) + (CASE WHEN contains(lower(content), '2025') THEN 30 ELSE 0 END) + (CASE WHEN contains(lower(content), 'schema.org') THEN 10 ELSE 0 END)
    + (CASE WHEN regexp_matches(lower(content), 'university|college') THEN 10 ELSE 0 END) AS s FROM articles WHERE content IS NOT NULL AND university_name <> '')"""
)
def news_page_class(spark, d):
    a = table(spark, d, "articles").where(F.col("content").isNotNull() & (F.col("university_name") != ""))
    return a.select("article_id", corrections.news_page(F.col("content"), F.col("university_name")).alias("page"), corrections.candidate_score(F.col("content"), "2025").alias("score"))


@query(
    """SELECT url_id, CASE WHEN contains(url, '/research/') THEN 'Research pages' WHEN contains(url, '/engineering') THEN hostname || ' School of Engineering news'
    WHEN contains(url, '/cs.') OR contains(url, '/computer-science') THEN hostname || ' Computer Science news' WHEN coalesce(status, '') <> '' THEN hostname || ' - ' || status || ' news and updates'
    ELSE hostname || ' official news and press releases' END AS description FROM urls"""
)
def source_descriptions(spark, d):
    return table(spark, d, "urls").select("url_id", corrections.source_description(F.col("url"), F.col("hostname"), F.col("status"), {"/research/": "Research pages"}).alias("description"))


@query(
    """SELECT i.institution_id AS id, 'https://www.' || i.domain AS url, 1 AS position FROM institutions i WHERE EXISTS (SELECT 1 FROM urls u WHERE u.hostname = 'www.' || i.domain AND u.status = 'crawled')
    AND NOT EXISTS (SELECT 1 FROM urls u WHERE u.hostname = 'news.' || i.domain AND u.status = 'crawled') UNION ALL
    SELECT i.institution_id, 'https://news.' || i.domain, 0 FROM institutions i WHERE EXISTS (SELECT 1 FROM urls u WHERE u.hostname = 'news.' || i.domain AND u.status = 'crawled')"""
)
def first_working_candidate(spark, d):
    at = lambda p: F.concat(F.lit(f"https://{p}."), "domain")
    c = table(spark, d, "institutions").select(F.col("institution_id").alias("id"), F.array(at("news"), at("www")).alias("urls"))
    probes = table(spark, d, "urls").select(F.concat(F.lit("https://"), "hostname").alias("url"), (F.col("status") == "crawled").alias("ok"))
    return corrections.first_working(c, probes)


@query(
    """SELECT i.institution_id, h.last_crawl_time IS NOT NULL AS crawled FROM institutions i LEFT JOIN host_crawl_state h ON h.hostname = 'www.' || i.domain"""
)
def sources_left_state(spark, d):
    h = table(spark, d, "host_crawl_state").select("hostname", "last_crawl_time")
    i = table(spark, d, "institutions").select("institution_id", F.concat(F.lit("www."), "domain").alias("hostname"))
    return i.join(h, "hostname", "left").select("institution_id", F.col("last_crawl_time").isNotNull().alias("crawled"))


@query("SELECT trim(split_part(status || '-' || coalesce(CAST(http_status_code AS VARCHAR), 'none'), '-', 1)) AS issue, count(*) AS n, count(DISTINCT hostname) AS hosts FROM urls GROUP BY 1")
def issue_types(spark, d):
    issue = F.trim(F.split_part(F.concat("status", F.lit("-"), F.coalesce(F.col("http_status_code").cast("string"), F.lit("none"))), F.lit("-"), F.lit(1)))
    return table(spark, d, "urls").groupBy(issue.alias("issue")).agg(F.count("*").alias("n"), F.count_distinct("hostname").alias("hosts"))


@query("SELECT status, retry_count, count(*) AS n FROM urls GROUP BY CUBE (status, retry_count)")
def counts_cube(spark, d):
    return table(spark, d, "urls").cube("status", "retry_count").agg(F.count("*").alias("n"))


@query(
    """SELECT CAST(count_if(s >= 85) AS BIGINT) AS proceed, CAST(count_if(s >= 60 AND s < 85) AS BIGINT) AS caution, CAST(count_if(s < 60) AS BIGINT) AS skip, count_if(http_status_code = 200) * 100.0 / count(*) AS rate
    FROM (SELECT http_status_code, (CASE WHEN http_status_code = 200 THEN 30 ELSE 0 END) + (CASE WHEN hostname IS NOT NULL THEN 25 ELSE 0 END) + (CASE WHEN etag IS NOT NULL THEN 15 ELSE 0 END)
    + (CASE WHEN content_hash IS NOT NULL THEN 10 ELSE 0 END) + 10 AS s FROM urls)"""
)
def recommendation_counts(spark, d):
    s = audit.confidence(
        reachable=F.col("http_status_code") == 200, institution=F.col("hostname").isNotNull(), branding=F.col("etag").isNotNull(), recent=F.lit(False),
        structured=F.col("content_hash").isNotNull(), article=F.lit(True),
    )
    u = table(spark, d, "urls").select("http_status_code", s.alias("s"))
    return u.agg(
        F.count_if(F.col("s") >= 85).alias("proceed"), F.count_if((F.col("s") >= 60) & (F.col("s") < 85)).alias("caution"), F.count_if(F.col("s") < 60).alias("skip"),
        F.try_divide(F.count_if(F.col("http_status_code") == 200) * 100.0, F.count("*")).alias("rate"),
    )


@query("SELECT CAST(count_if(is_ai_related) AS BIGINT) AS ai, count(*) AS total, bool_or(is_ai_related) AS any_ai, max(first_scraped) = (SELECT max(first_scraped) FROM articles) AS newest FROM articles")
def status_counts(spark, d):
    a = table(spark, d, "articles")
    return a.agg(F.count_if("is_ai_related").alias("ai"), F.count("*").alias("total"), F.bool_or("is_ai_related").alias("any_ai"), F.max("first_scraped").isNotNull().alias("newest"))


@query("SELECT short_id, url_id FROM (SELECT substr(sha256(normalized_url), 1, 12) AS short_id, url_id, row_number() OVER (PARTITION BY substr(sha256(normalized_url), 1, 12) ORDER BY first_seen DESC, url_id DESC) AS n FROM urls) WHERE n = 1")
def search_stubs(spark, d):
    from newsloom.functions import urls as U

    u = table(spark, d, "urls").select(U.short_id(F.col("normalized_url")).alias("short_id"), "url_id", "first_seen")
    return dedup.first_of_each(u, ["short_id"], [F.desc("first_seen"), F.desc("url_id")]).select("short_id", "url_id")


@query(
    """SELECT a.article_id, coalesce(s.relevance_score >= 5, a.is_ai_related) AS is_ai_related, s.analysis_id IS NOT NULL AS updated FROM articles a
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY analyzed_at DESC, analysis_id DESC) AS n FROM ai_analyses WHERE analyzed_at IS NOT NULL) s ON s.article_id = a.article_id AND s.n = 1"""
)
def update_verdicts(spark, d):
    """Rows updated from another table: the latest analysis decides where it says something."""
    s = latest.latest_per(table(spark, d, "ai_analyses").select("article_id", "analysis_id", "analyzed_at", "relevance_score"), "article_id", "analyzed_at", "analysis_id")
    a = table(spark, d, "articles").select("article_id", "is_ai_related").join(s, "article_id", "left")
    return a.select("article_id", F.coalesce(F.col("relevance_score") >= 5, F.col("is_ai_related")).alias("is_ai_related"), F.col("analysis_id").isNotNull().alias("updated"))


@query(
    """SELECT article_id, coalesce(json_extract_string(article_metadata, '$.hostname'), 'none') AS host, coalesce(json_extract_string(article_metadata, '$.categories[0]'), 'none') AS category FROM articles"""
)
def json_paths(spark, d):
    meta = F.try_parse_json("article_metadata")
    return table(spark, d, "articles").select(
        "article_id", F.coalesce(F.try_variant_get(meta, "$.hostname", "string"), F.lit("none")).alias("host"), F.coalesce(F.try_variant_get(meta, "$.categories[0]", "string"), F.lit("none")).alias("category")
    )


@query(
    """SELECT institution_id, CASE institution_id % 4 WHEN 0 THEN 'no JSON' WHEN 1 THEN '$.location.state is missing' WHEN 2 THEN '$.name is not of type string' END AS errors FROM institutions WHERE institution_id % 4 <> 3"""
)
def schema_violations(spark, d):
    """Documents that are no JSON, lack a required field or hold it in another type, with what is wrong."""
    m = F.col("institution_id") % 4
    place = F.struct(F.col("city"), F.when(m != 1, F.coalesce("region", F.lit("none"))).alias("state"))
    good = F.to_json(F.struct("name", place.alias("location")))
    written = F.when(m == 0, F.regexp_replace(good, r"\}$", "")).when(m == 2, F.to_json(F.struct(F.col("institution_id").alias("name"), place.alias("location")))).otherwise(good)
    e = quality.schema_errors(written, {"$.name": "STRING", "$.location.city": "STRING", "$.location.state": "STRING"})
    return table(spark, d, "institutions").select("institution_id", F.array_join(e, "; ").alias("errors")).where("errors <> ''")


@query("SELECT day, count(*) AS articles FROM (SELECT unnest([published_date + CAST(i AS INTEGER) FOR i IN [0, 1, 2, 3, 4]]) AS day FROM articles WHERE is_ai_related AND published_date IS NOT NULL) GROUP BY 1")
def rolling_pages(spark, d):
    """How many articles each day's page shows, for every day: an article counts for five days."""
    a = table(spark, d, "articles").where(F.col("is_ai_related") & F.col("published_date").isNotNull())
    return a.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.date_add("published_date", i))).alias("day")).groupBy("day").agg(F.count("*").alias("articles"))


@query("SELECT doc_id, lang, length(text) AS n FROM documents WHERE length(trim(text)) >= 50")
def minimum_length(spark, d):
    return table(spark, d, "documents").where(F.length(F.trim("text")) >= 50).select("doc_id", "lang", F.length("text").cast("long").alias("n"))


@query()
def markdown_to_html(spark, d):
    return html.markdown_pages(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("url"), "text"), "url", "text")


_SQL_TEXT = f"regexp_replace({_sql_plain("coalesce(summary, '')")}, '^{_SQL_SPACE}+|{_SQL_SPACE}+$', '', 'g')"
_SQL_SHORT = "CASE WHEN length(s) <= 300 THEN s WHEN contains(substr(s, 1, 300), ' ') THEN regexp_extract(substr(s, 1, 300), '(?s)^(.*) ', 1) || '...' ELSE substr(s, 1, 300) || '...' END"


def _sql_escaped(x: str) -> str:
    return f"""replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')"""


@query(
    f"""WITH a AS (SELECT row_number() OVER (ORDER BY article_id) AS n, coalesce(nullif(title, ''), 'Untitled') AS t, coalesce(nullif(university_name, ''), 'Unknown University') AS u, {_SQL_TEXT} AS s
      FROM articles WHERE is_ai_related AND published_date = DATE '{DAY}'), b AS (SELECT n, t, u, {_SQL_SHORT} AS short FROM a)
    SELECT n, '### ' || n || '. ' || t || chr(10) || chr(10) || '**' || u || '**' || chr(10) || chr(10) || short AS markdown,
    '<div class="article"><h2>' || {_sql_escaped('t')} || '</h2><p>' || {_sql_escaped('u')} || '</p><p>' || {_sql_escaped('short')} || '</p></div>' AS html FROM b"""
)
def digest_formats(spark, d):
    """The Markdown and HTML blocks of a digest, side by side."""
    a = table(spark, d, "articles").where(F.col("is_ai_related") & (F.col("published_date") == F.lit(DAY).cast("date")))
    order = [F.col("article_id")]
    return sinks.markdown_lines(a, order).withColumnRenamed("value", "markdown").join(sinks.html_rows(a, order).withColumnRenamed("value", "html"), "n")


@query("SELECT url_id, event FROM (SELECT url_id, status AS event FROM urls WHERE status IN ('failed', 'redirect'))")
def stream_status_changes(spark, d):
    """A stream of records drained twice: the second run finds nothing new."""
    import uuid

    from newsloom.streaming.incremental import drain

    home = f"{shared_dir(spark)}/status-{uuid.uuid4().hex}"
    schema = table(spark, d, "urls").schema
    work = lambda df: df.where(F.col("status").isin("failed", "redirect")).select("url_id", F.col("status").alias("event"))
    for _ in range(2):
        drain(spark, f"{d}/urls.parque[t]", schema, work, "url_id", f"{home}/table", f"{home}/checkpoint")
    return spark.read.parquet(f"{home}/table")


@query(
    f"""SELECT h.hostname, h.last_crawl_time IS NULL OR h.last_crawl_time < TIMESTAMP '{NOW}' - INTERVAL 7 DAY AS stale, coalesce(u.n, 0) AS urls FROM host_crawl_state h
    LEFT JOIN (SELECT hostname, count(*) AS n FROM urls GROUP BY 1) u USING (hostname)"""
)
def stale_hosts(spark, d):
    n = table(spark, d, "urls").groupBy("hostname").agg(F.count("*").alias("n"))
    h = table(spark, d, "host_crawl_state").join(n, "hostname", "left")
    old = F.col("last_crawl_time").isNull() | (F.col("last_crawl_time") < now() - F.expr("INTERVAL 7 DAY"))
    return h.select("hostname", old.alias("stale"), F.coalesce("n", F.lit(0)).cast("long").alias("urls"))


@query(
    """SELECT name, array_to_string(list_sort(list(DISTINCT domain)), ' ') AS domains, count(*) AS entries FROM (SELECT city AS name, domain FROM institutions) GROUP BY 1 HAVING count(*) > 1"""
)
def duplicate_names(spark, d):
    i = table(spark, d, "institutions").select(F.col("city").alias("name"), "domain")
    return i.groupBy("name").agg(F.array_join(F.sort_array(F.collect_set("domain")), " ").alias("domains"), F.count("*").alias("entries")).where("entries > 1")


@query("SELECT institution_id, CASE WHEN s <> 'https://' || domain THEN s END AS primary_url FROM (SELECT institution_id, domain, CASE WHEN region IS NULL THEN 'https://feed.' || domain ELSE 'https://news.' || domain END AS s FROM institutions)")
def primary_source_pick(spark, d):
    at = lambda kind, p: F.struct(F.lit(kind).alias("type"), F.concat(F.lit(p), "domain").alias("url"))
    feed, news = at("rss", "https://feed."), at("primary", "https://news.")
    sources = F.when(F.col("region").isNull(), F.array(feed)).otherwise(F.array(feed, news))
    return table(spark, d, "institutions").select("institution_id", reconcile.primary_source(sources)["url"].alias("primary_url"))
