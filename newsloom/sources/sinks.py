"""Exports of a report in its formats, as numbered lines: no report is ever gathered in one row or task."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import escaped, given, long_date, number, plain, shortened
from newsloom.operators.ordered import numbered
from newsloom.operators.reports import ranked

# Columns of the CSV export.
CSV_COLUMNS = ("title", "university_name", "published_date", "url", "summary", "author", "word_count", "is_ai_related", "ai_confidence_score")


def _csv_columns(articles: DataFrame) -> list[Column]:
    have = dict(articles.dtypes)
    text = lambda c: number(F.col(c)) if have[c] == "double" else F.col(c).cast("string")
    return [(F.coalesce(text(c), F.lit("")) if c in have else F.lit("")).alias(c) for c in CSV_COLUMNS]


def csv_rows(articles: DataFrame) -> DataFrame:
    """The columns of the CSV export as text, empty where a value is missing."""
    return articles.select(*_csv_columns(articles))


def document(parts: list[tuple[DataFrame, list[Column]]]) -> DataFrame:
    """(n, value): the lines of a document from its parts (value, and the columns of an order), numbered from 1 one part after the other.

    No part is gathered: each is numbered by ranges of its order, and shifted by the counts of the parts before.
    """
    out = None
    before: Column | None = None
    for rows, order in parts:
        lines = numbered(rows, order, "n") if order else rows.withColumn("n", F.lit(1).cast("long"))
        lines = lines.select((F.col("n") + before if before is not None else F.col("n")).alias("n"), "value")
        count = rows.agg(F.count("*")).scalar() if order else F.lit(1).cast("long")
        before = count if before is None else before + count
        out = lines if out is None else out.unionByName(lines)
    return out


def _line(spark, value: Column) -> tuple[DataFrame, list[Column]]:
    return spark.range(1).select(value.alias("value")), []


def json_envelope(articles: DataFrame, analyses: DataFrame, date: str, stamp: str, metadata: dict | None = None) -> DataFrame:
    """(n, value): the lines of the JSON document of a report: date, count, articles and analyses by id, metadata.

    Each article and analysis is a line of its own, so the document may be as long as it likes. ``metadata``
    tells the version of the crawler, whether analyses were on and the days looked back.
    """
    spark = articles.sparkSession
    text = lambda x: json.dumps(x, ensure_ascii=False)

    def items(df: DataFrame, key: str) -> tuple[DataFrame, list[Column]]:
        # null values are kept, and the first item has no comma before it
        least = df.agg(F.min(key)).scalar()
        body = F.to_json(F.struct(key, *[c for c in df.columns if c != key]), {"ignoreNullFields": "false"})
        return df.select(key, F.concat(F.when(F.col(key) == least, "").otherwise(","), body).alias("value")), [F.col(key)]

    n = articles.agg(F.count("*")).scalar()
    return document([
        _line(spark, F.concat(F.lit(f'{{"date": {text(date)}, "timestamp": {text(stamp)}, "article_count": '), n.cast("string"), F.lit(', "articles": ['))),
        items(articles, "article_id"),
        _line(spark, F.lit('], "ai_analyses": [')),
        items(analyses, "analysis_id"),
        _line(spark, F.lit(f'], "metadata": {text(metadata or {})}}}')),
    ])


def _numbered(articles: DataFrame, order: list[Column]) -> DataFrame:
    return numbered(articles, order, "n")


def _text_item(link: bool = False) -> Column:
    own = F.concat(
        F.col("n").cast("string"), F.lit(". "), given(F.col("title"), "Untitled"), F.lit("\n   "), given(F.col("university_name"), "Unknown University"), F.lit(" | "),
        long_date(F.col("published_date").cast("string")), F.lit("\n   "), shortened(plain(F.col("summary")), 300),
    )
    return F.concat(F.lit("\n"), own, F.lit("\n   Read more: "), F.coalesce("url", F.lit(""))) if link else own


def text_report(articles: DataFrame, order: list[Column], day: str, title: str = "Digest") -> DataFrame:
    """(n, value): a text report with its statistics in front; a single note where there are no articles."""
    spark = articles.sparkSession
    count = articles.agg(F.count("*")).scalar()
    head = F.concat(F.lit(f"{title} - {day}\n" + "=" * 60 + "\n\nFound "), count.cast("string"), F.lit(" AI-related articles\n"))
    first = spark.range(1).select(F.when(count == 0, "No articles found.").otherwise(head).alias("value"))
    rows = _numbered(articles, order).select(F.col("n").alias("_n"), _text_item(link=True).alias("value"))
    return document([(first, []), (rows, [F.col("_n")])])


def multipart(articles: DataFrame, order: list[Column], day: str, sender: str, recipients: list[str], sent: str, title: str = "Digest") -> DataFrame:
    """(n, value): the lines of a mail with a text and an HTML part; sending it is left to the caller."""
    spark = articles.sparkSession
    edge = hashlib.sha256(f"{title}{day}{sender}".encode()).hexdigest()[:24]
    line = lambda x: _line(spark, F.lit(x))
    count = articles.agg(F.count("*")).scalar()
    text, html = text_report(articles, order, day, title), html_rows(articles, order)
    return document([
        _line(spark, F.concat(F.lit(f"Subject: {title} - {day} ("), count.cast("string"), F.lit(" articles)"))),
        line(f"From: {sender}\nTo: {', '.join(recipients)}\nDate: {sent}\nMIME-Version: 1.0\nContent-Type: multipart/alternative; boundary=\"{edge}\"\n"),
        line(f"--{edge}\nContent-Type: text/plain; charset=\"utf-8\"\n"),
        (text.select(F.col("n").alias("_n"), "value"), [F.col("_n")]),
        line(f"--{edge}\nContent-Type: text/html; charset=\"utf-8\"\n"),
        (html.select(F.col("n").alias("_n"), "value"), [F.col("_n")]),
        line(f"--{edge}--"),
    ])


def text_lines(articles: DataFrame, order: list[Column]) -> DataFrame:
    """(n, value): the numbered lines of a text report."""
    return _numbered(articles, order).select("n", _text_item().alias("value"))


def markdown_lines(articles: DataFrame, order: list[Column]) -> DataFrame:
    """(n, value): the sections of a Markdown report."""
    return _numbered(articles, order).select(
        "n", F.concat(F.lit("### "), F.col("n").cast("string"), F.lit(". "), given(F.col("title"), "Untitled"), F.lit("\n\n**"), given(F.col("university_name"), "Unknown University"), F.lit("**\n\n"), shortened(plain(F.col("summary")), 300)).alias("value")
    )


def html_rows(articles: DataFrame, order: list[Column]) -> DataFrame:
    """(n, value): the escaped blocks of an HTML report."""
    return _numbered(articles, order).select(
        "n", F.concat(F.lit('<div class="article"><h2>'), escaped(given(F.col("title"), "Untitled")), F.lit("</h2><p>"), escaped(given(F.col("university_name"), "Unknown University")), F.lit("</p><p>"), escaped(shortened(plain(F.col("summary")), 300)), F.lit("</p></div>")).alias("value")
    )


def message_blocks(articles: DataFrame, order: list[Column], most: int = 10) -> DataFrame:
    """(n, value): the first blocks of a chat message and a footer that says how many more there are."""
    blocks = ranked(articles, order, most, "n").withColumn("n", F.col("n").cast("long")).select("n", F.to_json(F.struct(F.lit("section").alias("type"), given(F.col("title"), "Untitled").alias("text"))).alias("value"))
    more = articles.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("m")).where("m > 0")
    return blocks.unionByName(more.select(F.lit(most + 1).cast("long").alias("n"), F.to_json(F.struct(F.lit("context").alias("type"), F.concat(F.lit("...and "), F.col("m").cast("string"), F.lit(" more")).alias("text"))).alias("value")))


def csv_document(articles: DataFrame, key: str = "article_id") -> DataFrame:
    """(n, value): the lines of the CSV export with its header, in the order of a key."""
    lines = articles.select(F.col(key).alias("_k"), F.to_csv(F.struct(*_csv_columns(articles)), {"escape": '"'}).alias("value"))
    return document([_line(articles.sparkSession, F.lit(",".join(CSV_COLUMNS))), (lines, [F.col("_k")])])


def write_document(lines: DataFrame, path: str) -> None:
    """Write the lines (n, value) of a document; read in the order of their names, the files written are the document."""
    lines.orderBy("n").select("value").write.mode("overwrite").text(path)


def export(articles: DataFrame, analyses: DataFrame, folder: str, date: str, stamp: str, formats: tuple[str, ...] = ("json", "csv", "html", "text")) -> dict[str, str]:
    """Write the chosen formats of a report into a folder; returns format and path of those written. Without articles no CSV is written."""
    order = [F.desc_nulls_last("published_date"), F.col("article_id")]
    make = {
        "json": lambda: json_envelope(articles, analyses, date, stamp), "csv": lambda: csv_document(articles), "html": lambda: html_rows(articles, order), "text": lambda: text_lines(articles, order),
    }
    out: dict[str, str] = {}
    for kind in formats:
        if kind == "csv" and articles.isEmpty():
            continue
        out[kind] = f"{folder}/{kind}/{date}"
        write_document(make[kind](), out[kind])
    return out


def page_files(days: DataFrame, today: Column, folders: list[str]) -> DataFrame:
    """(day, file, archived) where the page of each day (column day) is written: today's as the index and into the archive, others into the archive alone, in every folder."""
    dated = F.concat(F.lit("archive/"), F.date_format("day", "yyyy-MM-dd"), F.lit(".html"))
    own = F.array(F.struct(dated.alias("file"), F.lit(True).alias("archived")))
    index = F.array(F.struct(F.lit("index.html").alias("file"), F.lit(False).alias("archived")))
    each = days.where(F.col("day").isNotNull()).select("day", F.explode(F.when(F.col("day") == today, F.concat(index, own)).otherwise(own)).alias("p"))
    return each.select("day", F.explode(F.array(*map(F.lit, folders))).alias("folder"), "p.*").select("day", F.concat_ws("/", "folder", "file").alias("file"), "archived")


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of a table that :func:`written_back` has written, the oldest first."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))


def written_back(rows: DataFrame, path: str) -> int:
    """Write a table anew as its next version, an empty one too; older versions stay as backups. Returns the version."""
    version = max(versions(rows.sparkSession, path), default=0) + 1
    rows.write.parquet(f"{path}/version={version}")
    return version


def version_of(spark: SparkSession, path: str, version: int) -> DataFrame:
    """A version of a table that :func:`written_back` has written."""
    return spark.read.parquet(f"{path}/version={version}")


def write_daily(pages: DataFrame, path: str, day: str = "report_date") -> None:
    """Write pages by day; days that are written anew replace their old ones, other days stay."""
    pages.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def appended_once(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Append the rows whose key a table does not hold yet, so that a repeated batch adds nothing; returns them."""
    try:
        old = rows.sparkSession.read.parquet(path).select(key)
        rows = rows.join(old, key, "left_anti")
    except AnalysisException:
        pass  # the first batch
    rows.write.mode("append").parquet(path)
    return rows
