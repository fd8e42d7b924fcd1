"""Archive pages and reports as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.dedup import first_of_each


def archive_files(spark: SparkSession, folders: list[str], pattern: str = "20*.html") -> DataFrame:
    """(file, folder, html): whole archive pages of folders, numbered in the order given."""
    out = None
    for i, f in enumerate(folders):
        d = spark.read.text(f, wholetext=True, pathGlobFilter=pattern).select(F.col("_metadata.file_name").alias("file"), F.lit(i).alias("folder"), F.col("value").alias("html"))
        out = d if out is None else out.unionByName(d)
    return out


def archive_days(pages: DataFrame) -> DataFrame:
    """(day, articles) of archive pages (file, folder, html): the first folder wins; files that name no date fall away.

    The count is the page's own attribute, else its note of the total, else the number of article blocks.
    """
    day = F.try_to_date(F.regexp_extract("file", r"(\d{4}-\d{2}-\d{2})\.html$", 1), "yyyy-MM-dd")
    number = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit("")).try_cast("long")
    count = F.coalesce(number(r'data-total-articles="(\d+)"'), number(r"<strong>Total Articles:</strong>\s*(\d+)"), F.regexp_count("html", F.lit('<div class="article">')).cast("long"))
    return first_of_each(pages.withColumn("day", day).where(F.col("day").isNotNull()), ["day"], [F.col("folder")]).select("day", count.alias("articles"))


def archive_articles(pages: DataFrame) -> DataFrame:
    """(file, position, category, url, title, university, summary, topics): article rows of archive pages of the newer markup."""
    block = F.posexplode(F.regexp_extract_all("html", F.lit(r'(?s)<div class="article-row.*?(?=<div class="article-row|\z)'), F.lit(0)))
    rows = pages.select("file", block.alias("position", "b"))
    pick = lambda p: F.regexp_extract("b", p, 1)
    raw = F.trim(F.regexp_replace(pick(r'(?s)<div class="summary">(.*?)</div>'), "<[^>]+>", ""))
    return rows.select(
        "file", "position", pick(r'data-category="([^"]*)"').alias("category"), pick(r'<a class="headline-link" href="([^"]*)"').alias("url"),
        pick(r'<a class="headline-link"[^>]*>([^<]*)</a>').alias("title"), pick(r'<span class="univ-label">([^<]*)</span>').alias("university"),
        F.when(F.length(raw) > 200, F.concat(F.regexp_extract(F.substring(raw, 1, 200), "(?s)^(.*) ", 1), F.lit("..."))).otherwise(raw).alias("summary"),
        F.regexp_extract_all("b", F.lit(r'<span class="topic-pill">([^<]+)</span>'), F.lit(1)).alias("topics"),
    ).where(F.col("url") != "")


def markdown_report(reports: DataFrame) -> DataFrame:
    """(file, number, name, label, url): entries of Markdown reports (file, text) and the first labelled address of each."""
    part = F.explode(F.regexp_extract_all("text", F.lit(r"(?s)### \d+\. .*?(?=\n### \d+\. |\z)"), F.lit(0)))
    rows = reports.select("file", part.alias("s"))
    pattern = r"(?m)^\s*[-*]\s*\**(Verified URL|Correct URL|Working URL|News URL|URL)\**:?\**\s*<?(https?://[^\s>)]+)"
    return rows.select(
        "file", F.regexp_extract("s", r"### (\d+)\. ", 1).cast("int").alias("number"), F.trim(F.regexp_extract("s", r"### \d+\. ([^\n]*)", 1)).alias("name"),
        F.regexp_extract("s", pattern, 1).alias("label"), F.regexp_extract("s", pattern, 2).alias("url"),
    ).where(F.col("url") != "")


def latest_file(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(file): the last file of a folder by name. Only names are asked for, so no file is opened."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(F.col("path")).agg(F.max("path").alias("file"))


def older_than(spark: SparkSession, folder: str, days: int, now) -> DataFrame:
    """(file): files last changed more than ``days`` before ``now``, for a retention job to delete."""
    files = spark.read.format("binaryFile").load(folder).select(F.col("path").alias("file"), F.col("modificationTime").alias("at"))
    return files.where(F.col("at") < now - F.make_dt_interval(F.lit(days))).select("file")


_HEALTH = "sources_attempted long, sources_succeeded long, stats struct<urls_discovered:long, urls_crawled:long, articles_extracted:long, duplicates_skipped:long, errors:long>, failed_domains array<string>"


def health_reports(documents: DataFrame) -> DataFrame:
    """(file, attempted, succeeded, discovered, crawled, extracted, skipped, errors, failed) of health reports (file, document); a text that is no JSON has nulls."""
    r = documents.select("file", F.when(F.try_parse_json("document").isNotNull(), F.from_json("document", _HEALTH)).alias("r"))
    return r.select(
        "file", F.col("r.sources_attempted").alias("attempted"), F.col("r.sources_succeeded").alias("succeeded"), F.col("r.stats.urls_discovered").alias("discovered"), F.col("r.stats.urls_crawled").alias("crawled"),
        F.col("r.stats.articles_extracted").alias("extracted"), F.col("r.stats.duplicates_skipped").alias("skipped"), F.col("r.stats.errors").alias("errors"), F.col("r.failed_domains").alias("failed"),
    )
