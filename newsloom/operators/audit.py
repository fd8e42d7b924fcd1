"""Audits of sources: coverage, decisions, health and quality of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.ordered import even_parts, numbered


def host_coverage(articles: DataFrame, urls: DataFrame, hosts: DataFrame, since: Column) -> DataFrame:
    """Coverage of each host (hostname): counts of articles, newest dates and a status.

    Articles are counted by address before hosts are joined, so a host with very many articles is never
    gathered in one task. Hosts without articles come out with zeros.
    """
    by_url = articles.groupBy("url_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("first_scraped") >= since).alias("recent"),
        F.count_if((F.col("first_scraped") >= since) & F.col("is_ai_related")).alias("recent_ai"),
        F.max("first_scraped").alias("newest_scraped"),
        F.max("published_date").alias("newest_published"),
    )
    by_host = by_url.join(urls.select("url_id", "hostname"), "url_id").groupBy("hostname").agg(
        *(F.sum(c).alias(c) for c in ("total", "recent", "recent_ai")), *(F.max(c).alias(c) for c in ("newest_scraped", "newest_published"))
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = hosts.select("hostname").distinct().join(by_host, "hostname", "left").select("hostname", zero("total"), zero("recent"), zero("recent_ai"), "newest_scraped", "newest_published")
    status = F.when(F.col("recent_ai") > 0, "good").when(F.col("recent") > 0, "stale").when(F.col("total") > 0, "zero").otherwise("never")
    return rows.withColumn("status", status)


def decided(rows: DataFrame) -> DataFrame:
    """Action and priority of each audited source; the first rule that holds decides.

    Columns: status, http_status (null if unreachable), probed, links, rss_found, rss_configured, recent.
    """
    failing = F.col("probed") & (F.col("http_status").isNull() | (F.col("http_status") >= 400))
    empty = F.col("status").isin("zero", "never")
    live = F.col("probed") & (F.col("http_status") == 200)
    rules = [
        (failing & empty, "FIX_URL", 1),
        (F.col("rss_found") & ~F.col("rss_configured"), "ADD_RSS", 2),
        (live & (F.col("links") > 5) & empty, "INVESTIGATE", 2),
        (live & (F.col("links") < 3) & empty, "REVIEW_NEWS_URL", 3),
        (F.col("status") == "stale", "CHECK_AI_FILTER", 3),
        (F.col("status") == "good", "OK", 4),
        (~F.col("probed") & empty, "INVESTIGATE", 2),
    ]
    action, priority = F.lit("INVESTIGATE"), F.lit(3)
    for rule, name, p in reversed(rules):
        held = F.coalesce(rule, F.lit(False))
        action, priority = F.when(held, name).otherwise(action), F.when(held, p).otherwise(priority)
    return rows.withColumn("action", action).withColumn("priority", priority)


def outcome(status: Column, elapsed_ms: Column) -> Column:
    """Outcome of a request from its status and the time it took."""
    return (
        F.when(elapsed_ms > 10_000, "slow")
        .when(status.isNull(), "connection_error")
        .when(status == 200, "working")
        .when(status.isin(301, 302, 303, 307, 308), "redirect_ok")
        .when(status == 403, "blocked_403")
        .when(status == 404, "not_found_404")
        .when(status.between(500, 599), "server_error_5xx")
        .otherwise(F.concat(F.lit("http_"), status.cast("string")))
    )


def health(urls: DataFrame) -> DataFrame:
    """(hostname, urls, crawled, errors, share): how each host answers."""
    return urls.groupBy("hostname").agg(
        F.count("*").alias("urls"),
        F.count_if(F.col("status") == "crawled").alias("crawled"),
        F.count_if((F.col("status") == "failed") | (F.col("http_status_code") >= 400)).alias("errors"),
    ).withColumn("share", F.col("errors") / F.col("urls"))


# What a confidence score is made of.
CONFIDENCE = {"reachable": 30, "institution": 25, "branding": 15, "recent": 10, "structured": 10, "article": 10}


def confidence(**signals: Column) -> Column:
    """Sum of the points of the signals that hold."""
    total = F.lit(0)
    for name, points in CONFIDENCE.items():
        total = total + F.when(F.coalesce(signals[name], F.lit(False)), points).otherwise(0)
    return total


def confidence_class(score: Column) -> Column:
    """VALID from 85 points, WARNING from 60, else INVALID."""
    return F.when(score >= 85, "VALID").when(score >= 60, "WARNING").otherwise("INVALID")


def completeness_bin(score: Column) -> Column:
    """Bin of a completeness score; a score of one belongs to the last bin."""
    return F.when(score < 0.25, "0-25").when(score < 0.5, "25-50").when(score < 0.75, "50-75").when(score < 0.9, "75-90").otherwise("90-100")


def batches(df: DataFrame, order: list[Column], parts: int, size: int) -> DataFrame:
    """Rows with a batch of ``parts`` even ones (the first ones take the remainder) and one of fixed ``size``."""
    rows = numbered(df, order, "_n")
    part = even_parts(F.col("_n"), rows.agg(F.count("*")).scalar(), parts)
    return rows.withColumn("part", part).withColumn("batch", (F.floor((F.col("_n") - 1) / size) + 1).cast("long")).drop("_n")


def issues(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in rules.items())))


def crawl_totals(urls: DataFrame) -> DataFrame:
    """One row of a run's health: addresses, crawled ones, errors, sources asked and sources that gave anything."""
    crawled = F.col("status") == "crawled"
    return urls.agg(
        F.count("*").alias("urls"), F.count_if(crawled).alias("crawled"), F.count_if(F.col("status") == "failed").alias("errors"),
        F.count_distinct("hostname").alias("attempted"), F.count_distinct(F.when(crawled, F.col("hostname"))).alias("succeeded"),
    )


def failing(domains: DataFrame, most: int = 20) -> DataFrame:
    """Domains (hostname, errors, articles) with errors and no article, the first ones by name."""
    return domains.where((F.col("errors") > 0) & (F.col("articles") == 0)).orderBy("hostname").limit(most)


def priority_split(sources: DataFrame, most: int = 20) -> DataFrame:
    """Sources (seq, kind) with ``priority`` (peers and facilities) and whether they are among the first ones of their part to be verified."""
    kind = F.coalesce(F.lower("kind"), F.lit(""))
    parted = sources.withColumn("priority", (kind == "peer") | F.contains(kind, F.lit("facility")))
    first = parted.where("priority").orderBy("seq").limit(most).select("seq", F.lit(True).alias("_first"))
    return parted.join(first, "seq", "left").withColumn("chosen", F.coalesce("_first", F.lit(False))).drop("_first")
