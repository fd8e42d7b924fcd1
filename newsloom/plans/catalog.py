"""Queries of the core over the engine's tables, and the SQL they are checked against.

Each query works on whole tables. ``QUERIES`` maps a name to (spark, folder) -> DataFrame, ``SQL`` maps
names to equivalent SQL where SQL can say the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.functions import urls as U
from newsloom.operators import audit, bloom, classify, consensus, curate, dedup, latest, quality, rate, reconcile, reports, similar
from newsloom.operators.ordered import numbered
from newsloom.plans.materialize import shared_dir
from newsloom.sources import archive, configs, html, sinks
from newsloom.sources.tables import table

#: The moment and the day that reports are made for.
NOW, DAY = "2025-12-30 00:00:00", "2025-11-20"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def now():
    return F.lit(NOW).cast("timestamp_ntz")


_LIST = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)

# --- addresses and hashes ---------------------------------------------------------------------------------------

# lists and patterns of the SQL are written out here, apart from those of the functions, so that neither covers an error of the other
_SQL_TRACKING = "'utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid', 'mc_cid', 'mc_eid'"
_SQL_FOLLOW = "/(news|press-release|press-releases|media|research|story|stories|article|articles|[0-9][0-9][0-9][0-9]/[0-9][0-9]|post|posts|feature|features)/"
_SQL_LEAVE = (
    "/(tag|category|author|archive|section|search|login|admin|calendar|events|galleries)/|/archives/[0-9]{4}/|/stories/archives/|/(news|news-events|news-and-events|press-releases|features-articles|accolades-honors|articles|stories)/?$"
    "|/news/(features|accolades|honors|announcements|updates)/?$|[.](pdf|jpg|jpeg|png|gif|zip|rar|exe)$"
)
_SQL_LISTING = "(?i)/(news|news-events|press-release|press-releases|news-release|news-releases|media|stories|articles|archive|all-news|category/[^/]+|tag/[^/]+|section/[^/]+)/?$|/(latest|the-latest|recent)[^/]*/?$"
_SQL_TITLES = (
    "(?i)^((News|Press Releases?|News Releases?|Media|Stories|Articles)\\s*$|News & Events|News and Events|Latest News|Latest Stories|All News|All Stories|Features & Articles"
    "|Accolades & Honors|The Latest News|Recent News|Archive|News Archive|[\\p{L}\\p{N}_]+\\s+News\\s*$)|Archives?\\s*$"
)
_SQL_SPACE = "[\\x{09}-\\x{0D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"

_SQL_QUERY = f"""list_filter(string_split(regexp_extract(lower(url), '\\?([^#]*)', 1), '&'),
  lambda p: contains(p, '=') AND NOT regexp_matches(p, '^[^=]*=$') AND NOT list_contains([{_SQL_TRACKING}], regexp_extract(p, '^([^=]*)=', 1)))"""
_SQL_BASE = "regexp_replace(lower(url), '[?#].*$', '')"
_SQL_NORMAL = f"""CASE WHEN regexp_matches({_SQL_BASE}, '^https?://[^/]*/$') THEN {_SQL_BASE} ELSE regexp_replace({_SQL_BASE}, '/+$', '') END
  || CASE WHEN len({_SQL_QUERY}) > 0 THEN '?' || array_to_string({_SQL_QUERY}, '&') ELSE '' END"""


@query(f"SELECT url_id, {_SQL_NORMAL} AS normal FROM urls")
def normalize_url(spark, d):
    return table(spark, d, "urls").select("url_id", U.normalized(F.col("url")).alias("normal"))


@query(f"SELECT url_id, sha256({_SQL_NORMAL}) AS url_hash, substr(sha256(url), 1, 12) AS short_id FROM urls")
def url_hash(spark, d):
    return table(spark, d, "urls").select("url_id", U.url_hash(F.col("url")).alias("url_hash"), U.short_id(F.col("url")).alias("short_id"))


@query("SELECT article_id, sha256(content) AS hash, sha256(content) = content_hash AS agrees FROM articles WHERE content IS NOT NULL")
def content_hash(spark, d):
    h = F.sha2("content", 256)
    return table(spark, d, "articles").where(F.col("content").isNotNull()).select("article_id", h.alias("hash"), (h == F.col("content_hash")).alias("agrees"))


@query(
    """SELECT url_id, regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1) AS host,
    regexp_extract(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), '([^.]+\\.[^.]+)$', 1) AS base FROM urls"""
)
def url_base_domain(spark, d):
    host = U.authority(F.col("url"))
    return table(spark, d, "urls").select("url_id", host.alias("host"), U.base_domain(host).alias("base"))


@query(
    """SELECT url_id, try_cast(regexp_extract(url, '/(20[0-9][0-9])/([0-9][0-9])/', 1) || '-' || regexp_extract(url, '/(20[0-9][0-9])/([0-9][0-9])/', 2) || '-01' AS DATE) AS published FROM urls"""
)
def url_pub_date(spark, d):
    return table(spark, d, "urls").select("url_id", U.date_in(F.col("url")).alias("published"))


@query(
    f"""SELECT url_id, regexp_matches(lower(url), '{_SQL_FOLLOW}') AND NOT regexp_matches(lower(url), '{_SQL_LEAVE}') AS followed,
    regexp_matches(url, '{_SQL_LISTING}') AS listing FROM urls"""
)
def link_allow_deny(spark, d):
    return table(spark, d, "urls").select("url_id", U.followed(F.lower("url")).alias("followed"), U.listing_url(F.col("url")).alias("listing"))


@query(
    f"""SELECT a.article_id FROM articles a LEFT JOIN urls u USING (url_id) WHERE coalesce(regexp_matches(u.url, '{_SQL_LISTING}'), false)
    OR coalesce(regexp_matches(a.title, '{_SQL_TITLES}'), false)"""
)
def nav_page_filter(spark, d):
    a = table(spark, d, "articles").select("article_id", "url_id", "title").join(table(spark, d, "urls").select("url_id", "url"), "url_id", "left")
    return a.where(F.coalesce(U.listing_url(F.col("url")), F.lit(False)) | F.coalesce(U.listing_title(F.col("title")), F.lit(False))).select("article_id")


@query("SELECT url_id, CASE WHEN regexp_matches(url, '(?i)^https://') THEN regexp_replace(url, '(?i)^https://', 'http://') ELSE regexp_replace(url, '(?i)^http://', 'https://') END AS correction FROM urls WHERE status = 'failed'")
def url_correction(spark, d):
    return table(spark, d, "urls").where("status = 'failed'").select("url_id", U.correction(F.col("url")).alias("correction"))


@query(
    """SELECT institution_id, c AS candidate FROM institutions, unnest(['https://news.' || domain, 'https://www.' || domain || '/news', 'https://newsroom.' || domain,
    'https://today.' || domain, 'https://' || domain || '/news']) t(c)"""
)
def candidate_urls(spark, d):
    return table(spark, d, "institutions").select("institution_id", F.explode(U.candidates(F.col("domain"), F.lit(None))).alias("candidate"))


# --- text -------------------------------------------------------------------------------------------------------


@query(
    f"""SELECT article_id, CAST(len(list_filter(regexp_split_to_array(content, '{_SQL_SPACE}+'), lambda w: w <> '')) AS INTEGER) AS words FROM articles
    WHERE len(list_filter(regexp_split_to_array(content, '{_SQL_SPACE}+'), lambda w: w <> '')) >= 100 AND title <> ''"""
)
def word_count_filter(spark, d):
    n = X.word_count(F.col("content"))
    return table(spark, d, "articles").where((F.col("title") != "") & (n >= 100)).select("article_id", n.alias("words"))


def _sql_plain(text: str) -> str:
    text = f"regexp_replace({text}, '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g')"  # links
    for mark in ("\\*\\*([^*]+)\\*\\*", "__([^_]+)__", "\\*([^*]+)\\*", "_([^_]+)_", "`([^`]+)`"):  # strong, emphasis, code
        text = f"regexp_replace({text}, '{mark}', '\\1', 'g')"
    return f"regexp_replace(regexp_replace(regexp_replace({text}, '^#{{1,6}}{_SQL_SPACE}+', '', 'gm'), '^[-*_]{{3,}}$', '', 'gm'), '<[^>]+>', '', 'g')"  # headings, rules, tags


@query(f"SELECT doc_id, regexp_replace({_sql_plain("coalesce(text, '')")}, '^{_SQL_SPACE}+|{_SQL_SPACE}+$', '', 'g') AS plain FROM documents")
def strip_markdown_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", X.plain(F.col("text")).alias("plain"))


_SQL_BLOCKS = "regexp_replace(regexp_replace(coalesce(text, ''), '```[a-zA-Z]*\\n?.*?```', '', 'gs'), '```', '', 'g')"
_SQL_HEAD = f"regexp_extract({_SQL_BLOCKS}, '^([^\\[]+)\\s*\\[', 1)"
_SQL_ONE = f"CASE WHEN {_SQL_HEAD} <> '' THEN regexp_replace({_SQL_HEAD}, '^{_SQL_SPACE}+|{_SQL_SPACE}+$', '', 'g') ELSE regexp_replace({_SQL_BLOCKS}, '[\\[\\]]', '', 'g') END"


@query(f"SELECT doc_id, regexp_replace(regexp_replace({_sql_plain('one')}, '{_SQL_SPACE}+', ' ', 'g'), '^{_SQL_SPACE}+|{_SQL_SPACE}+$', '', 'g') AS plain FROM (SELECT doc_id, {_SQL_ONE} AS one FROM documents)")
def strip_markdown_site(spark, d):
    return table(spark, d, "documents").select("doc_id", X.plain_line(F.col("text")).alias("plain"))


@query(
    """SELECT article_id, CASE WHEN length(summary) <= 100 THEN summary ELSE CASE WHEN contains(substr(summary, 1, 100), ' ')
    THEN regexp_extract(substr(summary, 1, 100), '(?s)^(.*) ', 1) ELSE substr(summary, 1, 100) END || '...' END AS short FROM articles WHERE summary IS NOT NULL"""
)
def shorten_summary(spark, d):
    return table(spark, d, "articles").where(F.col("summary").isNotNull()).select("article_id", X.shortened(F.col("summary"), 100).alias("short"))


_SQL_DISPLAY_CUT = "trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(split_part(university_name, ' | ', 1)), ' News$', '')), ' Today$', '')), ' Newsroom$', '')), ' Stories$', ''))"


@query(
    f"""SELECT DISTINCT university_name AS name, CASE WHEN coalesce(university_name, '') = '' THEN 'Unknown' ELSE
    coalesce(nullif(trim(regexp_replace({_SQL_DISPLAY_CUT}, '([a-z])([A-Z])', '\\1 \\2', 'g')), ''), 'Unknown') END AS display FROM articles"""
)
def clean_display_name(spark, d):
    n = table(spark, d, "articles").select(F.col("university_name").alias("name")).distinct()
    return n.select("name", X.display_name(F.col("name")).alias("display"))


@query("SELECT institution_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '^the ', ''), '^university of ', ''), '^university at ', '')) AS key FROM institutions")
def matching_names(spark, d):
    return table(spark, d, "institutions").select("institution_id", X.matching_name(F.col("name")).alias("key"))


@query(
    """SELECT institution_id, array_to_string(list_transform(list_filter(string_split(lower(trim(name)), ' '),
    lambda w: w <> '' AND NOT list_contains(['of', 'the', 'and', 'at', 'for', 'in', 'de'], w)), lambda w: substr(w, 1, 1)), '') AS initials FROM institutions"""
)
def name_initials(spark, d):
    return table(spark, d, "institutions").select("institution_id", X.initials(F.col("name")).alias("initials"))


@query(
    """SELECT university_name AS name, count(*) AS articles FROM articles WHERE university_name LIKE '%.edu' OR university_name LIKE '%.example'
    OR (length(university_name) < 10 AND university_name = upper(university_name) AND university_name <> lower(university_name))
    OR lower(university_name) IN ('news', 'university', 'college') GROUP BY 1"""
)
def suspicious_names(spark, d):
    a = table(spark, d, "articles").where(X.suspicious_name(F.col("university_name")))
    return a.groupBy(F.col("university_name").alias("name")).agg(F.count("*").alias("articles"))


@query("SELECT article_id FROM articles WHERE contains(lower(concat_ws(' ', title, university_name, summary)), 'wildfire')")
def search_filter(spark, d):
    return reports.searched(table(spark, d, "articles"), "wildfire", ["title", "university_name", "summary"]).select("article_id")


@query("SELECT institution_id, replace(replace(replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS html FROM institutions")
def escape_html(spark, d):
    return table(spark, d, "institutions").select("institution_id", X.escaped(F.col("name")).alias("html"))


# --- windows of articles, joins and reports ---------------------------------------------------------------------

_WINDOW = f"""first_scraped >= TIMESTAMP '{NOW}' - INTERVAL {{days}} DAY AND (published_date IS NULL OR published_date >= DATE '{NOW[:10]}' - {{age}})"""


@query(f"SELECT article_id FROM articles WHERE {_WINDOW.format(days=120, age=365)} AND last_analyzed IS NULL ORDER BY first_scraped, article_id LIMIT 1000")
def recent_unanalyzed(spark, d):
    return reports.unanalysed(table(spark, d, "articles"), now(), 120, 365, 1000).select("article_id")


@query(f"SELECT article_id FROM articles WHERE {_WINDOW.format(days=30, age=365)} AND last_analyzed IS NOT NULL")
def recent_analyzed(spark, d):
    return reports.analysed(table(spark, d, "articles"), now(), 30, 365).select("article_id")


_EXACT = """SELECT n.name, coalesce(c.category, 'r1') AS category FROM (SELECT DISTINCT university_name AS name FROM articles WHERE university_name IS NOT NULL) n
LEFT JOIN (SELECT lower(name) AS k, arg_min(category, CASE category WHEN 'national_lab' THEN 1 WHEN 'hpc' THEN 2 WHEN 'peer' THEN 3 WHEN 'global' THEN 4 ELSE 5 END) AS category
FROM institutions GROUP BY 1) c ON lower(n.name) = c.k"""


_PRIORITY = "CASE category WHEN 'national_lab' THEN 1 WHEN 'hpc' THEN 2 WHEN 'peer' THEN 3 WHEN 'global' THEN 4 ELSE 5 END"
_GUARD = "category IN ('national_lab', 'hpc', 'global')"
_HELD = """(SELECT lower(name) AS r, category FROM institutions WHERE name <> '' AND (NOT {0} OR length(name) >= 5)
    UNION ALL SELECT lower(abbreviation), category FROM institutions WHERE {0} AND length(abbreviation) >= 5)""".format(_GUARD)
_MATCHING = "trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '^the ', ''), '^university of ', ''), '^university at ', ''))"
_FUZZY = f"""SELECT n.name, arg_min(h.category, {_PRIORITY.replace('category', 'h.category')}) AS category FROM (SELECT DISTINCT university_name AS name, {_MATCHING.format('university_name')} AS l
    FROM articles WHERE university_name IS NOT NULL) n LEFT JOIN {_HELD} h ON n.l <> '' AND (contains(n.l, h.r) OR contains(h.r, n.l)) GROUP BY n.name"""
# the short names below are those that the tables hold among the written-out ones
_CLASSIFIED = f"""SELECT n.name, coalesce(e.category, CASE WHEN n.name <> '' THEN f.category END, 'r1') AS category FROM (SELECT DISTINCT university_name AS name FROM articles WHERE university_name IS NOT NULL) n
    LEFT JOIN (SELECT k, arg_min(category, {_PRIORITY}) AS category FROM (SELECT lower(name) AS k, category FROM institutions UNION ALL SELECT lower(abbreviation), category FROM institutions WHERE {_GUARD} AND abbreviation <> '')
      GROUP BY 1) e ON lower(n.name) = e.k LEFT JOIN ({_FUZZY}) f ON f.name = n.name"""


def _names(spark, d):
    return table(spark, d, "articles").select(F.col("university_name").alias("name")).where(F.col("name").isNotNull())


def _dim(spark, d):
    return table(spark, d, "institutions").select("name", "abbreviation", "category")


def _classes(spark, d):
    return classify.classified(_names(spark, d), _dim(spark, d))


@query(_EXACT)
def classify_exact_priority(spark, d):
    return classify.exact_class(_names(spark, d), _dim(spark, d).select("name", "category"))


@query(f"SELECT name, coalesce(category, 'r1') AS category FROM ({_FUZZY})")
def classify_fuzzy(spark, d):
    return classify.fuzzy_class(_names(spark, d), _dim(spark, d))


@query(_CLASSIFIED)
def classify_names(spark, d):
    return _classes(spark, d)


@query(
    f"""WITH w AS (SELECT a.article_id, coalesce(u.url, '') AS url, a.title, a.university_name, a.published_date, a.summary, s.relevance_score, s.consensus_summary,
      row_number() OVER (PARTITION BY coalesce(u.url, '') ORDER BY a.first_scraped DESC, s.analyzed_at DESC NULLS LAST, s.analysis_id DESC NULLS LAST, a.article_id) AS n
    FROM articles a LEFT JOIN ai_analyses s USING (article_id) LEFT JOIN urls u ON a.url_id = u.url_id
    WHERE a.is_ai_related AND a.published_date BETWEEN DATE '{DAY}' - 4 AND DATE '{DAY}'), c AS ({_CLASSIFIED})
    SELECT w.article_id, w.url, coalesce(nullif(w.title, ''), 'Untitled') AS title, coalesce(nullif(w.university_name, ''), 'Unknown University') AS university, w.published_date,
      w.relevance_score, coalesce(nullif(coalesce(nullif(w.consensus_summary, ''), w.summary), ''), '') AS summary, coalesce(c.category, 'r1') AS category
    FROM w LEFT JOIN c ON c.name = coalesce(nullif(w.university_name, ''), 'Unknown University') WHERE n = 1"""
)
def daily_report(spark, d):
    return reports.daily(table(spark, d, "articles"), table(spark, d, "ai_analyses"), table(spark, d, "urls"), DAY, lambda names: classify.classified(names, _dim(spark, d))).select(
        "article_id", "url", "title", "university", "published_date", "relevance_score", "summary", "category"
    )


@query(
    """SELECT a.article_id, u.url FROM articles a JOIN urls u ON a.url_id = u.url_id WHERE a.university_name IS NOT NULL"""
)
def article_urls(spark, d):
    a = table(spark, d, "articles").where(F.col("university_name").isNotNull()).select("article_id", "url_id")
    return a.join(table(spark, d, "urls").select("url_id", "url"), "url_id").select("article_id", "url")


@query("SELECT url_hash, min(url_id) AS url_id FROM urls GROUP BY 1")
def dedup_url_first(spark, d):
    return dedup.first_of_each(table(spark, d, "urls").select("url_hash", "url_id"), ["url_hash"], [F.col("url_id")])


@query("SELECT content_hash, arg_min(article_id, (first_scraped, article_id)) AS article_id FROM articles WHERE content IS NOT NULL GROUP BY 1")
def dedup_content_first(spark, d):
    a = table(spark, d, "articles").where(F.col("content").isNotNull()).select("content_hash", "first_scraped", "article_id")
    return dedup.first_of_each(a, ["content_hash"], [F.col("first_scraped"), F.col("article_id")]).select("content_hash", "article_id")


def _halves(spark, d):
    """Addresses found, and those crawled already: a page that stands in several rows may be among both."""
    u = table(spark, d, "urls").select("url_id", "url_hash", "status")
    old = F.coalesce(F.col("status") == "crawled", F.lit(False))
    return u.where(~old), u.where(old)


@query("SELECT url_id FROM urls u WHERE coalesce(status, '') <> 'crawled' AND NOT EXISTS (SELECT 1 FROM urls s WHERE s.status = 'crawled' AND s.url_hash = u.url_hash)")
def url_seen_antijoin(spark, d):
    new, old = _halves(spark, d)
    return dedup.unseen(new, old, "url_hash").select("url_id")


@query("SELECT url_id FROM urls u WHERE coalesce(status, '') <> 'crawled' AND EXISTS (SELECT 1 FROM urls s WHERE s.status = 'crawled' AND s.url_hash = u.url_hash)")
def url_seen_semijoin(spark, d):
    new, old = _halves(spark, d)
    return dedup.already_seen(new, old, "url_hash").select("url_id")


@query(
    """SELECT url_hash, max(url_id) AS url_id FROM urls WHERE coalesce(status, '') <> 'crawled' GROUP BY 1 UNION ALL
    SELECT url_hash, min(url_id) FROM urls WHERE status = 'crawled' AND url_hash NOT IN (SELECT url_hash FROM urls WHERE coalesce(status, '') <> 'crawled') GROUP BY 1"""
)
def url_upsert(spark, d):
    new, old = _halves(spark, d)
    incoming = new.groupBy("url_hash").agg(F.max("url_id").alias("url_id"))
    existing = old.groupBy("url_hash").agg(F.min("url_id").alias("url_id"))
    return dedup.upserted(existing, incoming, "url_hash")


@query("SELECT content_hash, count(*) AS copies, min(article_id) AS first_member FROM articles GROUP BY 1 HAVING count(*) > 1")
def content_dup_groups(spark, d):
    return dedup.duplicate_groups(table(spark, d, "articles"), "content_hash", "article_id")


@query("SELECT s.analysis_id FROM ai_analyses s WHERE s.article_id NOT IN (SELECT article_id FROM articles WHERE content IS NULL OR content = '')")
def cascade_delete(spark, d):
    gone = table(spark, d, "articles").where("content IS NULL OR content = ''").select("article_id")
    return dedup.without(table(spark, d, "ai_analyses"), gone, "article_id").select("analysis_id")


_LATEST = """SELECT article_id, analysis_id, relevance_score FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY analyzed_at DESC, analysis_id DESC) AS n
FROM ai_analyses WHERE analyzed_at IS NOT NULL {0}) WHERE n = 1"""


@query(_LATEST.format(""))
def latest_analysis_per_article(spark, d):
    a = table(spark, d, "ai_analyses").select("article_id", "analysis_id", "analyzed_at", "relevance_score")
    return latest.latest_per(a, "article_id", "analyzed_at", "analysis_id").select("article_id", "analysis_id", "relevance_score")


@query(_LATEST.format("AND analyzed_at <= TIMESTAMP '2025-06-01'"))
def analysis_asof(spark, d):
    a = table(spark, d, "ai_analyses").select("article_id", "analysis_id", "analyzed_at", "relevance_score")
    return latest.latest_per(a, "article_id", "analyzed_at", "analysis_id", F.lit("2025-06-01").cast("timestamp_ntz")).select("article_id", "analysis_id", "relevance_score")


@query(
    """SELECT article_id, analysis_id FROM (SELECT a.article_id, s.analysis_id, row_number() OVER (PARTITION BY a.article_id ORDER BY s.analyzed_at DESC, s.analysis_id DESC) AS n
    FROM articles a LEFT JOIN ai_analyses s ON s.article_id = a.article_id AND s.analyzed_at <= a.last_analyzed) WHERE n = 1"""
)
def asof_join_last_analyzed(spark, d):
    a = table(spark, d, "articles").select("article_id", "last_analyzed")
    s = table(spark, d, "ai_analyses").select("article_id", "analysis_id", "analyzed_at")
    return latest.as_of_join(a, s, "article_id", "last_analyzed", "analyzed_at", "analysis_id", ["analysis_id"]).select("article_id", "analysis_id")


@query(
    f"""SELECT a.article_id, a.title, u.url FROM articles a JOIN urls u ON a.url_id = u.url_id WHERE a.is_ai_related AND a.first_scraped >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR"""
)
def example_new_ai_articles_24h(spark, d):
    a = table(spark, d, "articles").where(F.col("is_ai_related") & (F.col("first_scraped") >= now() - F.expr("INTERVAL 24 HOUR"))).select("article_id", "url_id", "title")
    return a.join(table(spark, d, "urls").select("url_id", "url"), "url_id").select("article_id", "title", "url")


@query("SELECT university_name, count(*) AS articles FROM articles WHERE is_ai_related AND university_name IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def example_articles_by_university(spark, d):
    a = table(spark, d, "articles").where(F.col("is_ai_related") & F.col("university_name").isNotNull())
    return a.groupBy("university_name").agg(F.count("*").alias("articles")).orderBy(F.desc("articles"), "university_name").limit(20)


@query(
    f"""SELECT count(*) AS total, count(claude_summary) AS claude, count(openai_summary) AS openai, count(gemini_summary) AS gemini FROM ai_analyses
    WHERE analyzed_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY"""
)
def example_analysis_success(spark, d):
    a = table(spark, d, "ai_analyses").where(F.col("analyzed_at") >= now() - F.expr("INTERVAL 7 DAY"))
    return a.agg(F.count("*").alias("total"), *(F.count(f"{p}_summary").alias(p) for p in ("claude", "openai", "gemini")))


# --- votes and picks --------------------------------------------------------------------------------------------

_LATEST_ALL = "(SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY analyzed_at DESC, analysis_id DESC) AS n FROM ai_analyses WHERE analyzed_at IS NOT NULL)"
_VOTES = f"""SELECT article_id, 1 AS priority, relevance_score >= 5 AS vote, relevance_score AS relevance, claude_summary AS summary FROM {_LATEST_ALL} WHERE n = 1 AND claude_summary <> ''
UNION ALL SELECT article_id, 2, openai_category IN ('Research', 'Industry', 'Infrastructure'), NULL, openai_summary FROM {_LATEST_ALL} WHERE n = 1 AND openai_summary <> ''
UNION ALL SELECT article_id, 3, lower(gemini_sentiment) <> 'negative', NULL, gemini_summary FROM {_LATEST_ALL} WHERE n = 1 AND gemini_summary <> ''"""


def votes(analyses: DataFrame) -> DataFrame:
    """One row per article and provider (article_id, priority, vote, relevance, summary), from each article's latest analysis."""
    columns = ("claude_summary", "openai_summary", "openai_category", "gemini_summary", "gemini_sentiment", "relevance_score")
    a = latest.latest_per(analyses.select("article_id", "analysis_id", "analyzed_at", *columns), "article_id", "analyzed_at", "analysis_id")
    claude = F.struct(F.lit(1).alias("priority"), (F.col("relevance_score") >= 5).alias("vote"), F.col("relevance_score").alias("relevance"), F.col("claude_summary").alias("summary"))
    openai = F.struct(F.lit(2).alias("priority"), F.col("openai_category").isin("Research", "Industry", "Infrastructure").alias("vote"), F.lit(None).cast("double").alias("relevance"), F.col("openai_summary").alias("summary"))
    gemini = F.struct(F.lit(3).alias("priority"), (F.lower("gemini_sentiment") != "negative").alias("vote"), F.lit(None).cast("double").alias("relevance"), F.col("gemini_summary").alias("summary"))
    return a.select("article_id", F.inline(F.array(claude, openai, gemini))).where(F.col("summary") != "")


@query(
    f"""WITH v AS (SELECT * FROM ({_VOTES}) WHERE vote IS NOT NULL), c AS (SELECT article_id, count(*) AS providers, sum(CAST(vote AS INTEGER)) * 2 > count(*) AS verdict,
    coalesce(avg(relevance), 5.0) AS relevance, count(*) / 3.0 AS confidence, arg_min(summary, priority) AS summary FROM v GROUP BY 1)
    SELECT a.article_id, CAST(coalesce(c.providers, 0) AS BIGINT) AS providers, c.verdict AS is_ai_related, coalesce(c.relevance, 0.0) AS relevance, CAST(coalesce(c.confidence, 0.0) AS DOUBLE) AS confidence,
    CASE WHEN c.providers IS NULL THEN 'Analysis unavailable' ELSE c.summary END AS summary FROM articles a LEFT JOIN c USING (article_id)"""
)
def consensus_vote(spark, d):
    return consensus.consensus(table(spark, d, "articles"), votes(table(spark, d, "ai_analyses")))


@query(
    """SELECT is_ai_related IS NULL AND last_analyzed IS NOT NULL AS needs_retry, count(*) AS articles FROM articles GROUP BY 1"""
)
def needs_retry(spark, d):
    return table(spark, d, "articles").groupBy((F.col("is_ai_related").isNull() & F.col("last_analyzed").isNotNull()).alias("needs_retry")).agg(F.count("*").alias("articles"))


_IMPACT = " + ".join(f"coalesce(try_cast(json_extract_string(article_metadata, '$.impact_scores.{x}') AS DOUBLE), 3.0)" for x in ("scientific", "financial", "partnership"))


@query(f"SELECT article_id, ({_IMPACT}) / 3 AS composite FROM articles WHERE is_ai_related AND last_analyzed IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 50")
def impact_composite_top50(spark, d):
    a = table(spark, d, "articles").where(F.col("is_ai_related") & F.col("last_analyzed").isNotNull())
    return curate.candidates(a, 50).select("article_id", "composite")


@query(f"SELECT article_id FROM articles WHERE is_ai_related AND last_analyzed IS NOT NULL AND published_date >= TIMESTAMP '{DAY} 12:00:00' - INTERVAL 7 DAY")
def editorial_pool(spark, d):
    return curate.pool(table(spark, d, "articles"), F.lit(f"{DAY} 12:00:00").cast("timestamp_ntz")).select("article_id")


@query(
    f"""WITH p AS (SELECT article_id, row_number() OVER (ORDER BY ({_IMPACT}) DESC, article_id) AS rank FROM articles WHERE is_ai_related AND last_analyzed IS NOT NULL)
    SELECT a.article_id, a.title, row_number() OVER (ORDER BY rank) AS position FROM (SELECT * FROM p WHERE rank <= 50) p JOIN articles a USING (article_id) WHERE a.title IS NOT NULL"""
)
def picks_join_renumber(spark, d):
    a = table(spark, d, "articles")
    top = reports.ranked(curate.impacts(a.where(F.col("is_ai_related") & F.col("last_analyzed").isNotNull())), [F.desc("composite"), F.col("article_id")], 50).select("rank", "article_id")
    return curate.picked(top, a.where(F.col("title").isNotNull())).select("article_id", "title", F.col("position").cast("long").alias("position"))


# --- statistics and layouts -------------------------------------------------------------------------------------


@query("SELECT coalesce(nullif(university_name, ''), 'Unknown') AS university, count(*) AS articles, min(article_id) AS first_id FROM articles GROUP BY 1")
def stats_by_university(spark, d):
    return reports.institution_counts(table(spark, d, "articles"))


@query(
    f"""SELECT c.category, CAST(coalesce(n.n, 0) AS BIGINT) AS articles FROM (VALUES ('peer'), ('r1'), ('hpc'), ('national_lab'), ('global')) c(category)
    LEFT JOIN (SELECT e.category, count(*) AS n FROM articles a JOIN ({_CLASSIFIED}) e ON a.university_name = e.name GROUP BY 1) n ON n.category = c.category"""
)
def category_counts(spark, d):
    a = table(spark, d, "articles").select(F.col("university_name").alias("name")).join(_classes(spark, d), "name")
    return reports.category_counts(a, ["peer", "r1", "hpc", "national_lab", "global"])


@query(
    f"""WITH a AS (SELECT e.category, a.university_name AS name, a.article_id, coalesce(a.title, '') AS title FROM articles a JOIN ({_CLASSIFIED}) e ON a.university_name = e.name WHERE a.is_ai_related)
    SELECT category, name, items[1].id AS first_id, len(items) AS articles, items[len(items)].title AS last_title FROM (SELECT category, name, list({{'id': article_id, 'title': title}} ORDER BY article_id) AS items FROM a GROUP BY 1, 2)"""
)
def articles_grouped_nested(spark, d):
    """Pages of the nested layout read back: first and last item of each pair of groups and their number."""
    a = table(spark, d, "articles").where(F.col("is_ai_related")).select("article_id", "title", F.col("university_name").alias("name")).join(_classes(spark, d), "name")
    pages = reports.nested(a, "category", "name", "article_id", "title")
    items = pages.select("category", "name", F.inline(F.from_json("items", "array<struct<id long, title string>>")))
    return items.groupBy("category", "name").agg(F.min("id").alias("first_id"), F.count("*").alias("articles"), F.max_by("title", "id").alias("last_title"))


@query()
def articles_nested_pages(spark, d):
    a = table(spark, d, "articles").where(F.col("is_ai_related")).select("article_id", "title", F.col("university_name").alias("name")).join(_classes(spark, d), "name")
    return reports.nested(a, "category", "name", "article_id", "title")


_SQL_TOPIC = f"""regexp_replace(regexp_replace({_sql_plain(_SQL_ONE.replace('text', 'k'))}, '{_SQL_SPACE}+', ' ', 'g'), '^{_SQL_SPACE}+|{_SQL_SPACE}+$', '', 'g')"""


@query(f"SELECT topic, count(*) AS articles FROM (SELECT {_SQL_TOPIC} AS topic FROM (SELECT unnest(keywords[1:4]) AS k FROM articles)) WHERE topic <> '' AND length(topic) < 50 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def topic_top20(spark, d):
    return reports.top_topics(table(spark, d, "articles"))


@query(
    """SELECT strftime(published_date, '%Y-%m') AS month, published_date AS day, count(*) AS articles, count(*) * 100.0 / max(count(*)) OVER () AS bar FROM articles
    WHERE published_date IS NOT NULL GROUP BY published_date"""
)
def archive_month_bars(spark, d):
    return reports.month_bars(table(spark, d, "articles"))


@query("SELECT DISTINCT CAST(first_scraped AS DATE) AS day FROM articles")
def report_dates_distinct(spark, d):
    return table(spark, d, "articles").select(F.to_date("first_scraped").alias("day")).distinct()


@query(
    """SELECT article_id, language, position, more FROM (SELECT article_id, language, row_number() OVER (PARTITION BY language ORDER BY published_date DESC NULLS LAST, article_id) AS position,
    greatest(count(*) OVER (PARTITION BY language) - 25, 0) AS more FROM articles WHERE language IS NOT NULL) WHERE position <= 25"""
)
def visible25_overflow(spark, d):
    a = table(spark, d, "articles").where(F.col("language").isNotNull()).select("article_id", "language", "published_date")
    return reports.visible(a, "language", [F.desc_nulls_last("published_date"), F.col("article_id")], 25).select("article_id", "language", F.col("position").cast("long").alias("position"), "more")


@query(
    """SELECT coalesce(title, '') AS title, coalesce(university_name, '') AS university_name, coalesce(CAST(published_date AS VARCHAR), '') AS published_date, coalesce(summary, '') AS summary,
    coalesce(author, '') AS author, coalesce(CAST(word_count AS VARCHAR), '') AS word_count, coalesce(CAST(is_ai_related AS VARCHAR), '') AS is_ai_related,
    coalesce(CAST(ai_confidence_score AS VARCHAR), '') AS ai_confidence_score, coalesce(u.url, '') AS url FROM articles a LEFT JOIN urls u ON u.url_id = a.url_id"""
)
def csv_export_projection(spark, d):
    a = table(spark, d, "articles")
    return sinks.csv_rows(a.join(table(spark, d, "urls").select("url_id", "url"), "url_id", "left"))


@query(
    f"""WITH a AS (SELECT row_number() OVER (ORDER BY published_date DESC NULLS LAST, article_id) AS n, title, university_name, published_date,
    regexp_replace({_sql_plain("coalesce(summary, '')")}, '^\\s+|\\s+$', '', 'g') AS s FROM articles WHERE is_ai_related AND published_date BETWEEN DATE '2025-11-16' AND DATE '{DAY}')
    SELECT n, n || '. ' || coalesce(nullif(title, ''), 'Untitled') || chr(10) || '   ' || coalesce(nullif(university_name, ''), 'Unknown University') || ' | ' || strftime(published_date, '%B %d, %Y')
    || chr(10) || '   ' || CASE WHEN length(s) <= 300 THEN s WHEN contains(substr(s, 1, 300), ' ') THEN regexp_extract(substr(s, 1, 300), '(?s)^(.*) ', 1) || '...' ELSE substr(s, 1, 300) || '...' END AS value FROM a"""
)
def text_report_lines(spark, d):
    a = table(spark, d, "articles").where(F.col("is_ai_related") & F.col("published_date").between(F.lit("2025-11-16").cast("date"), F.lit(DAY).cast("date")))
    return sinks.text_lines(a, [F.desc_nulls_last("published_date"), F.col("article_id")])


@query("SELECT avg(coalesce(ai_confidence_score, 0)) AS mean_confidence, count(*) AS articles FROM articles WHERE is_ai_related")
def average_confidence(spark, d):
    return table(spark, d, "articles").where("is_ai_related").agg(F.avg(F.coalesce("ai_confidence_score", F.lit(0.0))).alias("mean_confidence"), F.count("*").alias("articles"))


# --- audits -----------------------------------------------------------------------------------------------------

_SINCE = "2025-01-01"
_COVERAGE = f"""SELECT h.hostname, CAST(coalesce(c.total, 0) AS BIGINT) AS total, CAST(coalesce(c.recent, 0) AS BIGINT) AS recent, CAST(coalesce(c.recent_ai, 0) AS BIGINT) AS recent_ai, c.newest_published,
CASE WHEN coalesce(c.recent_ai, 0) > 0 THEN 'good' WHEN coalesce(c.recent, 0) > 0 THEN 'stale' WHEN coalesce(c.total, 0) > 0 THEN 'zero' ELSE 'never' END AS status
FROM (SELECT DISTINCT hostname FROM host_crawl_state) h LEFT JOIN (SELECT u.hostname, count(*) AS total, count_if(a.first_scraped >= TIMESTAMP '{_SINCE}') AS recent,
count_if(a.first_scraped >= TIMESTAMP '{_SINCE}' AND a.is_ai_related) AS recent_ai, max(a.published_date) AS newest_published
FROM articles a JOIN urls u ON a.url_id = u.url_id GROUP BY 1) c ON c.hostname = h.hostname"""


def _coverage(spark, d):
    return audit.host_coverage(table(spark, d, "articles"), table(spark, d, "urls"), table(spark, d, "host_crawl_state"), F.lit(_SINCE).cast("timestamp_ntz"))


@query(_COVERAGE)
def host_coverage(spark, d):
    return _coverage(spark, d).drop("newest_scraped")


@query(
    f"""WITH c AS ({_COVERAGE}), h AS (SELECT hostname, row_number() OVER (ORDER BY hostname) AS k FROM host_crawl_state),
    p AS (SELECT c.hostname, CASE k % 4 WHEN 0 THEN 'zero' WHEN 1 THEN 'never' ELSE c.status END AS status, CASE k % 5 WHEN 0 THEN 404 WHEN 1 THEN NULL ELSE 200 END AS http, k % 7 <> 0 AS probed, k % 11 AS links, k % 3 = 0 AS found, k % 6 = 0 AS configured
      FROM c JOIN h ON h.hostname = c.hostname),
    r AS (SELECT hostname, CASE WHEN probed AND (http IS NULL OR http >= 400) AND status IN ('zero', 'never') THEN 'FIX_URL 1' WHEN found AND NOT configured THEN 'ADD_RSS 2'
      WHEN probed AND http = 200 AND links > 5 AND status IN ('zero', 'never') THEN 'INVESTIGATE 2' WHEN probed AND http = 200 AND links < 3 AND status IN ('zero', 'never') THEN 'REVIEW_NEWS_URL 3'
      WHEN status = 'stale' THEN 'CHECK_AI_FILTER 3' WHEN status = 'good' THEN 'OK 4' WHEN NOT probed AND status IN ('zero', 'never') THEN 'INVESTIGATE 2' ELSE 'INVESTIGATE 3' END AS x FROM p)
    SELECT hostname, split_part(x, ' ', 1) AS action, CAST(split_part(x, ' ', 2) AS INTEGER) AS priority, row_number() OVER (ORDER BY CAST(split_part(x, ' ', 2) AS INTEGER), hostname) AS place FROM r"""
)
def audit_decision(spark, d):
    """Every rule of the decision is met: what probes found is written from the host's place in the list."""
    n = numbered(table(spark, d, "host_crawl_state").select("hostname"), [F.col("hostname")], "k")
    rows = _coverage(spark, d).join(n, "hostname").select(
        "hostname", F.when(F.col("k") % 4 == 0, "zero").when(F.col("k") % 4 == 1, "never").otherwise(F.col("status")).alias("status"),
        F.when(F.col("k") % 5 == 0, 404).when(F.col("k") % 5 != 1, 200).alias("http_status"), (F.col("k") % 7 != 0).alias("probed"), (F.col("k") % 11).alias("links"),
        (F.col("k") % 3 == 0).alias("rss_found"), (F.col("k") % 6 == 0).alias("rss_configured"), "recent",
    )
    return numbered(audit.decided(rows).select("hostname", "action", "priority"), [F.col("priority"), F.col("hostname")], "place")


@query(
    """SELECT hostname, count(*) AS urls, CAST(count_if(status = 'crawled') AS BIGINT) AS crawled, CAST(count_if(status = 'failed' OR http_status_code >= 400) AS BIGINT) AS errors,
    count_if(status = 'failed' OR http_status_code >= 400) / count(*) AS share FROM urls GROUP BY 1"""
)
def health_by_domain(spark, d):
    return audit.health(table(spark, d, "urls"))


@query(
    """SELECT host AS hostname, CAST(errors AS BIGINT) AS errors FROM (SELECT hostname || ' ' || strftime(u.first_seen, '%Y-%m') AS host, count_if(status = 'failed') AS errors, count(a.n) AS articles
    FROM urls u LEFT JOIN (SELECT url_id, count(*) AS n FROM articles GROUP BY 1) a USING (url_id) GROUP BY 1) WHERE errors > 0 AND articles = 0 ORDER BY host LIMIT 20"""
)
def failed_domains(spark, d):
    """Domains month by month, because over all time each has an article."""
    found = table(spark, d, "articles").select("url_id", F.lit(1).alias("n")).distinct()
    host = F.concat("hostname", F.lit(" "), F.date_format("first_seen", "yyyy-MM"))
    u = table(spark, d, "urls").select("url_id", host.alias("hostname"), "status").join(found, "url_id", "left")
    domains = u.groupBy("hostname").agg(F.count_if(F.col("status") == "failed").alias("errors"), F.count("n").alias("articles"))
    return audit.failing(domains).select("hostname", "errors")


@query(
    """SELECT outcome, count(*) AS urls FROM (SELECT CASE WHEN http_status_code IS NULL THEN 'connection_error' WHEN http_status_code = 200 THEN 'working'
    WHEN http_status_code IN (301, 302, 303, 307, 308) THEN 'redirect_ok' WHEN http_status_code = 403 THEN 'blocked_403' WHEN http_status_code = 404 THEN 'not_found_404'
    WHEN http_status_code BETWEEN 500 AND 599 THEN 'server_error_5xx' ELSE 'http_' || http_status_code END AS outcome FROM urls) GROUP BY 1"""
)
def http_outcome_category(spark, d):
    return table(spark, d, "urls").groupBy(audit.outcome(F.col("http_status_code"), F.lit(0)).alias("outcome")).agg(F.count("*").alias("urls"))


@query("SELECT status, http_status_code, count(*) AS n FROM urls GROUP BY ROLLUP (status, http_status_code)")
def counts_rollup(spark, d):
    return table(spark, d, "urls").rollup("status", "http_status_code").agg(F.count("*").alias("n"))


@query("SELECT language, is_ai_related, count(*) AS n FROM articles GROUP BY GROUPING SETS ((language), (is_ai_related), ())")
def counts_grouping_sets(spark, d):
    a = table(spark, d, "articles")
    return a.groupingSets([["language"], ["is_ai_related"], []], "language", "is_ai_related").agg(F.count("*").alias("n")).select("language", "is_ai_related", "n")


@query(
    """SELECT http_status_code, url_id, position, more FROM (SELECT http_status_code, url_id, row_number() OVER (PARTITION BY http_status_code ORDER BY url_id) AS position,
    greatest(count(*) OVER (PARTITION BY http_status_code) - 5, 0) AS more FROM urls WHERE status = 'failed' AND http_status_code IS NOT NULL) WHERE position <= 5"""
)
def error_groups_top5(spark, d):
    u = table(spark, d, "urls").where("status = 'failed' AND http_status_code IS NOT NULL").select("http_status_code", "url_id")
    return reports.visible(u, "http_status_code", [F.col("url_id")], 5).select("http_status_code", "url_id", F.col("position").cast("long").alias("position"), "more")


@query("SELECT hostname, count(*) AS failures FROM urls WHERE status = 'failed' GROUP BY 1 HAVING count(*) > 1")
def having_multi_failures(spark, d):
    return table(spark, d, "urls").where("status = 'failed'").groupBy("hostname").agg(F.count("*").alias("failures")).where("failures > 1")


def _documents(spark, d):
    """Documents of institutions with their sources, feeds, platforms, contacts and research, each of them missing somewhere."""
    m = lambda n: F.col("institution_id") % n
    site = F.concat(F.lit("https://"), "domain")
    primary = F.when(m(5) != 0, F.struct(site.alias("url"), F.when(m(2) == 0, F.concat(site, F.lit("/ai"))).alias("ai_tag_url"), (m(3) == 0).alias("verified")))
    feeds = F.transform(F.sequence(F.lit(1), m(5) + 1), lambda i: F.struct(F.concat(F.lit("feed"), i.cast("string")).alias("url"), F.lit(True).alias("active"), (i % 2 == 0).alias("verified")))
    social = F.struct(F.when(m(2) == 0, F.struct(F.lit("t").alias("url"))).alias("twitter"), F.when(m(3) == 0, F.struct(F.lit("l").alias("url"))).alias("linkedin"), F.struct(F.lit("x").alias("url")).alias("mastodon"))
    media = F.when(m(4) == 0, F.struct(F.lit("p").alias("page_url"), F.lit("").alias("email"), F.col("abbreviation").alias("phone")))
    ai = F.struct((m(2) == 1).alias("has_ai_institute"), F.array().cast("array<string>").alias("ai_centers"), F.when(m(7) == 0, F.array(F.lit("f"))).alias("ai_focus_areas"))
    doc = F.struct(
        "name", F.struct("city", F.col("region").alias("state"), "country").alias("location"), F.struct(primary.alias("primary"), feeds.alias("rss_feeds")).alias("news_sources"),
        social.alias("social_media"), media.alias("media_relations"), ai.alias("ai_research"),
    )
    return table(spark, d, "institutions").select(F.col("institution_id").alias("id"), F.to_json(doc).alias("document"), site.alias("url"))


_SCORE = """0.2 * ((coalesce(name, '') <> '')::INT + (coalesce(city, '') <> '')::INT + (coalesce(region, '') <> '')::INT + (coalesce(country, '') <> '')::INT) / 4
  + 0.3 * (CASE WHEN id % 5 <> 0 THEN 1 + 0.5 * (id % 2 = 0)::INT + 0.5 * (id % 3 = 0)::INT ELSE 0 END) / 2 + 0.2 * least(((id % 5 + 1) // 2) / 3, 1)
  + 0.1 * least(((id % 2 = 0)::INT + (id % 3 = 0)::INT) / 3, 1) + 0.1 * (CASE WHEN id % 4 = 0 THEN 1 + (coalesce(abbreviation, '') <> '')::INT ELSE 0 END) / 3 + 0.1 * ((id % 2 = 1)::INT + (id % 7 = 0)::INT) / 3"""
_SCORES = f"(SELECT id, round({_SCORE}, 9) AS s, region, domain FROM (SELECT *, institution_id AS id FROM institutions))"


def _validated(spark, d):
    docs = _documents(spark, d)
    return quality.validated(docs.select("id", "document"), docs.select("url", (F.col("id") % 6 != 1).alias("ok")))


@query(
    f"""SELECT CASE WHEN s < 0.25 THEN '0-25' WHEN s < 0.5 THEN '25-50' WHEN s < 0.75 THEN '50-75' WHEN s < 0.9 THEN '75-90' ELSE '90-100' END AS bin, count(*) AS institutions FROM {_SCORES} GROUP BY 1"""
)
def completeness_histogram(spark, d):
    return _validated(spark, d).groupBy(audit.completeness_bin(F.round("score", 9)).alias("bin")).agg(F.count("*").alias("institutions"))


@query(f"SELECT id, round(s, 6) AS score FROM {_SCORES}")
def completeness_scores(spark, d):
    return _validated(spark, d).select("id", F.round("score", 6).alias("score"))


@query(
    f"""SELECT id, concat_ws('; ', CASE WHEN region IS NULL THEN 'Missing required field: location.state' END, CASE WHEN id % 5 = 0 THEN 'Missing required field: news_sources.primary' END) AS errors,
    concat_ws('; ', CASE WHEN id % 5 <> 0 AND id % 6 = 1 THEN 'Primary URL not accessible' END, 'RSS feed invalid: feed1', CASE WHEN id % 5 >= 2 THEN 'RSS feed invalid: feed3' END, CASE WHEN id % 5 >= 4 THEN 'RSS feed invalid: feed5' END) AS warnings
    FROM {_SCORES}"""
)
def validate_records(spark, d):
    return _validated(spark, d).select("id", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


@query(
    f"""SELECT round(avg(s), 6) AS mean, CAST(sum((region IS NULL)::INT + (id % 5 = 0)::INT) AS BIGINT) AS errors, CAST(sum((id % 5 <> 0 AND id % 6 = 1)::INT + 1 + (id % 5 >= 2)::INT + (id % 5 >= 4)::INT) AS BIGINT) AS warnings FROM {_SCORES}"""
)
def validation_totals(spark, d):
    return _validated(spark, d).agg(F.round(F.avg("score"), 6).alias("mean"), F.sum(F.size("errors")).alias("errors"), F.sum(F.size("warnings")).alias("warnings"))


@query(
    """SELECT url_id, score, CASE WHEN score >= 85 THEN 'VALID' WHEN score >= 60 THEN 'WARNING' ELSE 'INVALID' END AS class FROM (SELECT url_id, (CASE WHEN http_status_code = 200 THEN 30 ELSE 0 END)
    + (CASE WHEN hostname IS NOT NULL THEN 25 ELSE 0 END) + (CASE WHEN etag IS NOT NULL THEN 15 ELSE 0 END) + (CASE WHEN contains(url, '/2025/') THEN 10 ELSE 0 END)
    + (CASE WHEN content_hash IS NOT NULL THEN 10 ELSE 0 END) + (CASE WHEN contains(url, '/news/') OR contains(url, '/articles/') THEN 10 ELSE 0 END) AS score FROM urls)"""
)
def confidence_score_bucket(spark, d):
    score = audit.confidence(
        reachable=F.col("http_status_code") == 200, institution=F.col("hostname").isNotNull(), branding=F.col("etag").isNotNull(), recent=F.contains("url", F.lit("/2025/")),
        structured=F.col("content_hash").isNotNull(), article=F.contains("url", F.lit("/news/")) | F.contains("url", F.lit("/articles/")),
    )
    return table(spark, d, "urls").select("url_id", score.alias("score")).withColumn("class", audit.confidence_class(F.col("score")))


@query("SELECT institution_id, CAST(ntile(5) OVER (ORDER BY institution_id) AS INTEGER) AS part, CAST(floor((row_number() OVER (ORDER BY institution_id) - 1) / 20) + 1 AS BIGINT) AS batch FROM institutions")
def ntile_batches(spark, d):
    return audit.batches(table(spark, d, "institutions").select("institution_id"), [F.col("institution_id")], 5, 20)


@query(
    """SELECT article_id, array_to_string(list_filter([CASE WHEN title IS NULL OR title = '' THEN 'title' END, CASE WHEN content IS NULL OR content = '' THEN 'content' END,
    CASE WHEN published_date > CAST(first_scraped AS DATE) THEN 'date' END, CASE WHEN language IS NULL THEN 'language' END], lambda x: x IS NOT NULL), ' ') AS issues FROM articles"""
)
def record_issues(spark, d):
    empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
    rules = {"title": empty("title"), "content": empty("content"), "date": F.col("published_date") > F.to_date("first_scraped"), "language": F.col("language").isNull()}
    return table(spark, d, "articles").select("article_id", F.array_join(audit.issues(rules), " ").alias("issues"))


# --- reconciliation ---------------------------------------------------------------------------------------------


@query(
    """SELECT normalized_url AS key, count(*) AS entries, min(url) AS best, array_to_string(list_sort(list(DISTINCT url))[2:], ' ') AS others, max(retry_count) AS priority, bool_or(status = 'crawled') AS flag
    FROM urls GROUP BY 1 HAVING count(*) > 1"""
)
def merge_duplicates_sets(spark, d):
    u = table(spark, d, "urls").select(F.col("normalized_url").alias("key"), "url", "retry_count", (F.col("status") == "crawled").alias("ok"))
    return reconcile.merged_sets(u, "key", "url", "retry_count", "ok").where("entries > 1")


@query(
    """SELECT normalized_url AS key, arg_max(url, ((CASE WHEN status = 'crawled' THEN 2 ELSE 0 END) + (CASE WHEN etag IS NOT NULL THEN 1 ELSE 0 END), -url_id)) AS best,
    CAST(max((CASE WHEN status = 'crawled' THEN 2 ELSE 0 END) + (CASE WHEN etag IS NOT NULL THEN 1 ELSE 0 END)) AS BIGINT) AS score FROM urls GROUP BY 1"""
)
def merge_duplicates_best_url(spark, d):
    score = F.when(F.col("status") == "crawled", 2).otherwise(0) + F.when(F.col("etag").isNotNull(), 1).otherwise(0)
    u = table(spark, d, "urls").select(F.col("normalized_url").alias("key"), "url", "url_id", score.alias("s"))
    return reconcile.best_by_score(u, "key", "url", F.col("s"), "url_id")


@query(
    """SELECT p.name, CASE WHEN coalesce(o.ok, false) AND NOT p.ok THEN o.v ELSE p.v END AS domain, p.ok OR coalesce(o.ok, false) AS verified, coalesce(o.ok, false) AND NOT p.ok AS replaced
    FROM (SELECT name, domain AS v, region IS NOT NULL AS ok FROM institutions) p
    LEFT JOIN (SELECT city AS name, arg_max('www.' || domain, CASE WHEN abbreviation IS NOT NULL THEN 1 ELSE 0 END) AS v, bool_or(abbreviation IS NOT NULL) AS ok
      FROM institutions GROUP BY 1 HAVING count(*) = 1) o ON o.name = p.name"""
)
def crossfile_merge(spark, d):
    i = table(spark, d, "institutions")
    single = i.groupBy("city").agg(F.count("*").alias("n")).where("n = 1").select("city")
    other = i.join(single, "city").select(F.col("city").alias("name"), F.concat(F.lit("www."), "domain").alias("domain"), F.col("abbreviation").isNotNull().alias("verified"))
    primary = i.select("name", "domain", F.col("region").isNotNull().alias("verified"))
    return reconcile.cross_file(primary, other, "name", "domain", "verified")


@query("SELECT name FROM institutions EXCEPT SELECT university_name FROM articles")
def except_unmatched(spark, d):
    return table(spark, d, "institutions").select("name").subtract(table(spark, d, "articles").select(F.col("university_name").alias("name")))


@query("SELECT i.institution_id FROM institutions i WHERE NOT EXISTS (SELECT 1 FROM urls u WHERE u.hostname = i.domain OR u.hostname IN ('www.' || i.domain, 'news.' || i.domain))")
def not_in_merged(spark, d):
    hosts = table(spark, d, "urls").select(F.regexp_replace("hostname", r"^(?:www|news)\.", "").alias("domain")).distinct()
    return table(spark, d, "institutions").join(hosts, "domain", "left_anti").select("institution_id")


@query(
    """SELECT url_id, CASE WHEN status = 'crawled' THEN 'verified' WHEN url <> normalized_url THEN 'normal' WHEN starts_with(url, 'http://') THEN 'scheme' ELSE 'review' END AS tier,
    CASE WHEN status = 'crawled' THEN url WHEN url <> normalized_url THEN normalized_url WHEN starts_with(url, 'http://') THEN replace(url, 'http://', 'https://') END AS new_value FROM urls"""
)
def tiered_repair(spark, d):
    tiers = [
        ("verified", F.when(F.col("status") == "crawled", F.col("url"))),
        ("normal", F.when(F.col("url") != F.col("normalized_url"), F.col("normalized_url"))),
        ("scheme", F.when(F.col("url").startswith("http://"), F.replace("url", F.lit("http://"), F.lit("https://")))),
    ]
    return reconcile.repaired(table(spark, d, "urls"), tiers, "url").select("url_id", "tier", "new_value")


@query("SELECT analysis_id, provider, summary FROM (UNPIVOT (SELECT analysis_id, claude_summary, openai_summary, gemini_summary FROM ai_analyses) ON claude_summary, openai_summary, gemini_summary INTO NAME provider VALUE summary)")
def unpivot_summaries(spark, d):
    a = table(spark, d, "ai_analyses")
    return a.unpivot("analysis_id", ["claude_summary", "openai_summary", "gemini_summary"], "provider", "summary").where(F.col("summary").isNotNull())


@query(
    """SELECT u.hostname, coalesce(e.name, b.name, u.hostname) AS canonical FROM (SELECT DISTINCT hostname FROM urls) u LEFT JOIN institutions e ON e.domain = u.hostname
    LEFT JOIN institutions b ON b.domain = regexp_extract(u.hostname, '([^.]+\\.[^.]+)$', 1)"""
)
def canonical_name(spark, d):
    entries = table(spark, d, "institutions").select(F.col("institution_id").alias("seq"), F.col("domain").alias("host"), "name")
    hosts = table(spark, d, "urls").select(F.col("hostname").alias("host"))
    return classify.canonical_names(hosts, classify.host_dim(entries)).select(F.col("host").alias("hostname"), "canonical")


@query(
    """SELECT l.l AS contained, r.r AS holder FROM (SELECT DISTINCT city AS l FROM institutions) l JOIN (SELECT DISTINCT university_name AS r FROM articles) r ON contains(r.r, l.l) AND r.r <> l.l
    WHERE length(l.l) >= 3"""
)
def contained_names(spark, d):
    cities = table(spark, d, "institutions").select(F.col("city").alias("r"))
    names = table(spark, d, "articles").select(F.col("university_name").alias("l"))
    pairs = classify.containing(names, cities).where(F.contains("l", "r") & (F.col("l") != F.col("r")))
    return pairs.select(F.col("r").alias("contained"), F.col("l").alias("holder"))


# --- limits, filters and events ---------------------------------------------------------------------------------


@query(
    f"""SELECT hostname, coalesce(nullif(robots_txt_delay, 0), nullif(crawl_delay, 0), 1.0) AS delay_s, coalesce(blocked_until > TIMESTAMP '{NOW}', false) AS blocked,
    NOT coalesce(blocked_until > TIMESTAMP '{NOW}', false) AND coalesce(epoch(TIMESTAMP '{NOW}') - epoch(last_crawl_time) >= coalesce(nullif(robots_txt_delay, 0), nullif(crawl_delay, 0), 1.0), true) AS allowed
    FROM host_crawl_state"""
)
def host_can_crawl(spark, d):
    return rate.may_crawl(table(spark, d, "host_crawl_state"), now())


@query(
    """SELECT url_id, coalesce(g >= 3600, true) AS allowed FROM (SELECT url_id, (epoch_us(first_seen) - epoch_us(lag(first_seen) OVER (PARTITION BY hostname ORDER BY first_seen, url_id))) / 1e6 AS g FROM urls)"""
)
def rate_limit_replay(spark, d):
    return rate.gaps(table(spark, d, "urls").select("url_id", "hostname", "first_seen"), "hostname", "first_seen", "url_id", 3600).select("url_id", "allowed")


@query(
    """WITH RECURSIVE o AS (SELECT hostname, url_id, epoch_us(first_seen) AS t, row_number() OVER (PARTITION BY hostname ORDER BY first_seen, url_id) AS n FROM urls WHERE first_seen IS NOT NULL),
    b AS (SELECT hostname, url_id, t, n, 4.0::DOUBLE AS tokens, true AS allowed FROM o WHERE n = 1 UNION ALL
    SELECT hostname, url_id, t, n, have - (have >= 1)::INT AS tokens, have >= 1 AS allowed FROM (SELECT o.*, least(5.0::DOUBLE, b.tokens + (o.t - b.t) / 1e6 * (1.0::DOUBLE / 3600)) AS have FROM b JOIN o ON o.hostname = b.hostname AND o.n = b.n + 1))
    SELECT hostname, url_id, round(tokens, 6) AS tokens, allowed FROM b"""
)
def token_bucket_replay(spark, d):
    u = table(spark, d, "urls").where(F.col("first_seen").isNotNull()).select("url_id", "hostname", "first_seen")
    return rate.token_bucket(u, "hostname", "first_seen", "url_id", 1 / 3600, 5.0).withColumn("tokens", F.round("tokens", 6))


# the filter is large enough here that what it lets through is what was added
@query("SELECT DISTINCT url_hash FROM urls WHERE coalesce(status, '') <> 'crawled' AND url_hash IN (SELECT url_hash FROM urls WHERE status = 'crawled')")
def bloom_membership(spark, d):
    new, old = _halves(spark, d)
    return bloom.maybe_seen(new, "url_hash", bloom.built(old, "url_hash"))


@query("SELECT count(*) AS added, pow(1 - exp(-3.0 * count(*) / 1e7), 3) AS rate FROM urls")
def bloom_fpr(spark, d):
    return table(spark, d, "urls").agg(F.count("*").alias("added")).select("added", bloom.false_positive_rate(F.col("added")).alias("rate"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def ext_tumbling(spark, d):
    from newsloom.streaming.incremental import tumbling

    return tumbling(table(spark, d, "events"))


@query("SELECT start, count(*) AS events FROM (SELECT unnest([date_trunc('day', ts) - INTERVAL (i) DAY FOR i IN [0, 1, 2, 3, 4]]) AS start FROM events) GROUP BY 1")
def ext_sliding(spark, d):
    from newsloom.streaming.incremental import sliding

    return sliding(table(spark, d, "events"))


@query(
    """SELECT user_id, min(ts) AS start, count(*) AS events FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s"""
)
def ext_session(spark, d):
    from newsloom.streaming.incremental import sessions

    return sessions(table(spark, d, "events"))


# --- sources: documents written from the tables and read back ------------------------------------------------------


@query()
def similar_institution_names(spark, d):
    names = table(spark, d, "articles").select(F.col("university_name").alias("l"))
    return similar.similar_names(names, table(spark, d, "institutions").select(F.col("name").alias("r")))


@query(
    r"""SELECT analysis_id, trim(regexp_replace(claude_summary, '\s*\n\s*', ' ', 'g')) AS summary, array_to_string(claude_key_points, '; ') AS points, relevance_score AS relevance, gemini_sentiment IS NOT NULL AS is_ai_related,
    CAST(processing_time_ms % 10 + 1 AS DOUBLE) AS scientific, CAST(1 AS DOUBLE) AS financial FROM ai_analyses WHERE claude_summary <> '' AND trim(claude_summary) <> '' AND len(claude_key_points) > 0 AND relevance_score IS NOT NULL AND processing_time_ms IS NOT NULL"""
)
def parse_structured_response(spark, d):
    a = table(spark, d, "ai_analyses").where("claude_summary <> '' AND trim(claude_summary) <> '' AND size(claude_key_points) > 0 AND relevance_score IS NOT NULL AND processing_time_ms IS NOT NULL")
    written = F.concat(
        F.lit("SUMMARY: "), "claude_summary", F.lit("\nKEY_POINTS:\n- "), F.array_join("claude_key_points", "\n- "), F.lit("\nRELEVANCE: "), F.col("relevance_score").cast("string"),
        F.lit("\nAI_RELATED: "), F.when(F.col("gemini_sentiment").isNotNull(), "Yes").otherwise("No"), F.lit("\nSCIENTIFIC_IMPACT: "), (F.col("processing_time_ms") % 10 + 1).cast("string"), F.lit("/10\nFINANCIAL_IMPACT: high"),
    )
    r = a.select("analysis_id", X.response(written).alias("r"))
    return r.select("analysis_id", "r.summary", F.array_join("r.key_points", "; ").alias("points"), "r.relevance", "r.is_ai_related", "r.scientific", "r.financial")


@query(
    """SELECT article_id, trim(title) AS note, CASE WHEN is_ai_related THEN 'Policy' ELSE 'Scientific Breakthrough' END AS category, 2 AS rank FROM articles WHERE trim(title) <> ''"""
)
def parse_picks(spark, d):
    a = table(spark, d, "articles").where("trim(title) <> ''")
    category = F.when(F.col("is_ai_related"), "IMPACT_CATEGORY: Policy\n").otherwise("")
    written = F.concat(F.lit("Picks.\nPICK_1:\nnothing fits\nPICK_2:\nARTICLE_ID: "), F.col("article_id").cast("string"), F.lit("\nEDITORIAL_NOTE: "), F.trim("title"), F.lit("\n"), category)
    return a.select(F.explode(X.picks(written)).alias("p")).select("p.article_id", "p.note", "p.category", "p.rank")


@query(
    """SELECT article_id, CASE WHEN regexp_matches(title, '(?i)AI[- ]related.*?\\b(yes|no)\\b') THEN false ELSE true END AS verdict,
    CASE WHEN contains(lower(title), 'machine learning') THEN 'Machine Learning' WHEN contains(lower(title), 'nlp') THEN 'NLP' WHEN contains(lower(title), 'computer vision') THEN 'Computer Vision'
    WHEN contains(lower(title), 'robotics') THEN 'Robotics' WHEN contains(lower(title), 'ai ethics') THEN 'AI Ethics' ELSE 'Other' END AS subject FROM articles WHERE title IS NOT NULL"""
)
def response_flags(spark, d):
    return table(spark, d, "articles").where(F.col("title").isNotNull()).select("article_id", X.said_yes(F.col("title")).alias("verdict"), X.subject_named(F.col("title")).alias("subject"))


def _written_page():
    return F.concat(
        F.lit("<!doctype html><html lang='en'><head><title> "), "hostname", F.lit(" </title><style>p{}</style></head><body><nav><a href='/menu'>Menu</a></nav><article><p>Address: "),
        "normalized_url", F.lit("</p><p>Status &amp; hash: "), "url_hash", F.lit("</p><a href='"), "normalized_url", F.lit("'>story</a><script>var x = 1;</script></article></body></html>"),
    )


@query(
    """SELECT url_id, hostname AS title, 'en' AS language, 'Address: ' || normalized_url || chr(10) || 'Status & hash: ' || url_hash || chr(10) || 'story' AS text FROM urls"""
)
def html_page(spark, d):
    p = table(spark, d, "urls").select("url_id", html.page(_written_page()).alias("p"))
    return p.select("url_id", "p.title", "p.language", "p.text")


@query("SELECT url_id, hostname AS title, hostname || ' Menu Address: ' || normalized_url || ' Status & hash: ' || url_hash || ' story' AS text, 2 AS links FROM urls")
def html_title_links(spark, d):
    p = table(spark, d, "urls").withColumn("body", _written_page())
    return p.select("url_id", html.title_of(F.col("body")).alias("title"), html.plain_text(F.col("body")).alias("text"), F.size(html.hrefs(F.col("body"))).alias("links"))


@query(
    f"""SELECT DISTINCT normalized_url AS url, normalized_url AS link FROM urls WHERE regexp_matches(lower(normalized_url), '{_SQL_FOLLOW}')
    AND NOT regexp_matches(lower(normalized_url), '{_SQL_LEAVE}') AND NOT regexp_matches(normalized_url, '{_SQL_LISTING}')"""
)
def html_article_links(spark, d):
    p = table(spark, d, "urls").select(F.col("normalized_url").alias("url"), _written_page().alias("body"))
    return html.links(p, "url", "body")


@query("SELECT url_id, 1 AS position, url_hash AS title, normalized_url AS link, true AS feed FROM urls")
def feed_entries(spark, d):
    written = F.concat(
        F.lit("<?xml version='1.0'?><rss><channel><item><title>no link</title></item><item><title><![CDATA["), "url_hash", F.lit("]]></title><link>"), "normalized_url",
        F.lit("</link><pubDate>Mon, 01 Jan 2024</pubDate></item></channel></rss>"),
    )
    u = table(spark, d, "urls").select(F.col("url_id").cast("string").alias("url"), written.alias("body"))
    e = html.feed_entries(u.where(html.is_feed(F.lit(None), F.col("body"))), "url", "body")
    return e.select(F.col("url").cast("long").alias("url_id"), "position", "title", "link", F.lit(True).alias("feed"))


@query(
    """SELECT institution_id AS id, name, CASE institution_id % 4 WHEN 3 THEN 'https://' || domain ELSE 'https://' || domain || '/news' END AS url,
    CASE WHEN institution_id % 4 = 1 THEN city WHEN institution_id % 4 IN (0, 2) THEN concat_ws(', ', city, region) END AS location, CASE institution_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 4 END AS generation FROM institutions"""
)
def normalize_sources(spark, d):
    i = table(spark, d, "institutions")
    site = F.concat(F.lit("https://"), "domain", F.lit("/news"))
    place = F.struct("city", F.col("region").alias("state"), "country")
    third = F.struct(F.array(F.struct("name", place.alias("location"), F.array(F.struct(F.lit("rss").alias("type"), F.lit("https://feed").alias("url")), F.struct(F.lit("primary").alias("type"), site.alias("url"))).alias("news_sources"))).alias("universities"))
    second = F.struct(F.array(F.struct("name", place.alias("location"), F.struct(F.struct(site.alias("url"), F.lit(True).alias("verified")).alias("primary")).alias("news_sources"))).alias("universities"))
    first = F.array(F.struct("name", site.alias("news_url"), F.col("city").alias("location")))
    service = F.struct(F.array(F.struct("name", F.concat(F.lit("https://"), "domain").alias("url"))).alias("news_services"))
    m = F.col("institution_id") % 4
    written = F.when(m == 0, F.to_json(third)).when(m == 1, F.to_json(first)).when(m == 2, F.to_json(second)).otherwise(F.to_json(service))
    docs = i.select(F.col("institution_id").alias("seq"), written.alias("document"))
    return configs.normalised(docs).select(F.shiftright("seq", 32).alias("id"), "name", "url", "location", "generation")


@query(
    """SELECT institution_id, len(s) AS sources, s[1] AS first FROM (SELECT institution_id, list_filter([CASE WHEN region IS NOT NULL THEN 'https://' || domain END, 'https://news.' || domain], lambda x: x IS NOT NULL) AS s FROM institutions)"""
)
def migrate_v2_v3(spark, d):
    url = lambda p: F.struct(F.lit("primary").alias("type"), F.concat(F.lit(p), "domain").alias("url"))
    s = reconcile.migrated(F.when(F.col("region").isNotNull(), url("https://")), F.array(url("https://news.")))
    i = table(spark, d, "institutions").select("institution_id", s.alias("s"))
    return i.select("institution_id", F.size("s").cast("long").alias("sources"), F.col("s")[0]["url"].alias("first"))


@query("SELECT published_date AS day, count(*) AS articles FROM articles WHERE published_date IS NOT NULL GROUP BY 1")
def archive_days(spark, d):
    a = table(spark, d, "articles").where(F.col("published_date").isNotNull()).groupBy("published_date").agg(F.count("*").alias("n"))
    n = F.col("n").cast("string")
    kind = F.dayofmonth("published_date") % 3
    written = F.when(kind == 0, F.concat(F.lit('<main data-total-articles="'), n, F.lit('">'))).when(kind == 1, F.concat(F.lit("<strong>Total Articles:</strong> "), n)).otherwise(F.repeat(F.lit('<div class="article"></div>'), F.col("n").cast("int")))
    pages = a.select(F.concat(F.col("published_date").cast("string"), F.lit(".html")).alias("file"), F.lit(0).alias("folder"), written.alias("html"))
    return archive.archive_days(pages)


@query("SELECT article_id, coalesce(language, '') AS category, sha256(coalesce(title, '')) AS title, array_to_string(keywords, '; ') AS topics FROM articles WHERE len(keywords) > 0")
def archive_articles(spark, d):
    a = table(spark, d, "articles").where(F.size("keywords") > 0)
    written = F.concat(
        F.lit('<div class="article-row open" data-category="'), F.coalesce("language", F.lit("")), F.lit('"><a class="headline-link" href="https://x/"'), F.lit(">"), F.sha2(F.coalesce("title", F.lit("")), 256),
        F.lit('</a><span class="univ-label">u</span><div class="article-detail"><div class="summary">s</div>'), F.array_join(F.transform("keywords", lambda k: F.concat(F.lit('<span class="topic-pill">'), k, F.lit("</span>"))), ""), F.lit("</div> </div>"),
    )
    got = archive.archive_articles(a.select(F.col("article_id").cast("string").alias("file"), written.alias("html")))
    return got.select(F.col("file").cast("long").alias("article_id"), "category", "title", F.array_join("topics", "; ").alias("topics"))


@query("SELECT institution_id, 2 AS number, name, 'https://' || domain || '/news' AS url FROM institutions")
def markdown_reports(spark, d):
    written = F.concat(F.lit("# Report\n### 1. None\n- nothing\n### 2. "), "name", F.lit("\n- **Status**: ok\n- **Verified URL**: https://"), "domain", F.lit("/news\n"))
    got = archive.markdown_report(table(spark, d, "institutions").select(F.col("institution_id").cast("string").alias("file"), written.alias("text")))
    return got.select(F.col("file").cast("long").alias("institution_id"), "number", "name", "url")


@query("SELECT event_id, value * 2 AS doubled FROM events WHERE event_type = 'error'")
def stream_incremental_analysis(spark, d):
    """A stream over files, drained batch by batch into a table that takes each key once, read back."""
    import uuid

    from newsloom.streaming.incremental import drain

    home = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    work = lambda df: df.where("event_type = 'error'").select("event_id", (F.col("value") * 2).alias("doubled"))
    drain(spark, f"{d}/events.parque[t]", schema, work, "event_id", f"{home}/table", f"{home}/checkpoint")
    return spark.read.parquet(f"{home}/table")


@query(
    f"""WITH a AS (SELECT article_id, title, university_name, row_number() OVER (ORDER BY article_id) AS i FROM articles WHERE is_ai_related AND published_date = DATE '{DAY}'),
    s AS (SELECT analysis_id, article_id, consensus_summary, row_number() OVER (ORDER BY analysis_id) AS i FROM ai_analyses WHERE article_id IN (SELECT article_id FROM a)), n AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM s) AS ns)
    SELECT 1 AS n, '{{"date": "{DAY}", "timestamp": "{NOW}", "article_count": ' || na || ', "articles": [' AS value FROM n
    UNION ALL SELECT i + 1, CASE WHEN i > 1 THEN ',' ELSE '' END || CAST(to_json({{'article_id': article_id, 'title': title, 'university_name': university_name}}) AS VARCHAR) FROM a
    UNION ALL SELECT na + 2, '], "ai_analyses": [' FROM n
    UNION ALL SELECT na + 2 + i, CASE WHEN i > 1 THEN ',' ELSE '' END || CAST(to_json({{'analysis_id': analysis_id, 'article_id': article_id, 'consensus_summary': consensus_summary}}) AS VARCHAR) FROM s, n
    UNION ALL SELECT na + ns + 3, '], "metadata": {{"crawler_version": "1.0", "enable_ai_analysis": true, "lookback_days": 1}}}}' FROM n"""
)
def export_json_envelope(spark, d):
    a = table(spark, d, "articles").where(F.col("is_ai_related") & (F.col("published_date") == F.lit(DAY).cast("date"))).select("article_id", "title", "university_name")
    s = table(spark, d, "ai_analyses").join(a.select("article_id"), "article_id", "left_semi").select("analysis_id", "article_id", "consensus_summary")
    return sinks.json_envelope(a, s, DAY, NOW, {"crawler_version": "1.0", "enable_ai_analysis": True, "lookback_days": 1})


@query(
    """WITH a AS (SELECT coalesce(nullif(title, ''), 'Untitled') AS title, row_number() OVER (ORDER BY published_date DESC NULLS LAST, article_id) AS n FROM articles WHERE is_ai_related)
    SELECT n, CAST(to_json({'type': 'section', 'text': title}) AS VARCHAR) AS value FROM a WHERE n <= 10
    UNION ALL SELECT 11, CAST(to_json({'type': 'context', 'text': '...and ' || (count(*) - 10) || ' more'}) AS VARCHAR) FROM a HAVING count(*) > 10"""
)
def export_message_blocks(spark, d):
    a = table(spark, d, "articles").where(F.col("is_ai_related")).select("article_id", "title", "published_date")
    return sinks.message_blocks(a, [F.desc_nulls_last("published_date"), F.col("article_id")])
