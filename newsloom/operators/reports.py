"""Reports: windows of articles, statistics, rankings and page layouts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import given, plain_line
from newsloom.operators.dedup import first_of_each
from newsloom.operators.ordered import numbered
from newsloom.plans.materialize import materialize

#: A daily page shows the articles of so many days.
PAGE_DAYS = 5


def unanalysed(articles: DataFrame, as_of: Column, lookback_days: int, age_days: int, most: int) -> DataFrame:
    """Articles scraped lately, not yet analysed and not too old; a missing publication date passes. The oldest ones first."""
    return (
        articles.where((F.col("first_scraped") >= as_of - F.make_dt_interval(F.lit(lookback_days))) & F.col("last_analyzed").isNull())
        .where(F.col("published_date").isNull() | (F.col("published_date") >= F.date_sub(as_of.cast("date"), age_days)))
        .orderBy("first_scraped", "article_id")
        .limit(most)
    )


def analysed(articles: DataFrame, as_of: Column, lookback_days: int, age_days: int) -> DataFrame:
    """Articles scraped lately and analysed."""
    return articles.where((F.col("first_scraped") >= as_of - F.make_dt_interval(F.lit(lookback_days))) & F.col("last_analyzed").isNotNull()).where(
        F.col("published_date").isNull() | (F.col("published_date") >= F.date_sub(as_of.cast("date"), age_days))
    )


def selected(articles: DataFrame, only_related: bool = False, days: tuple[Column, Column] | None = None, min_confidence: float = 0.0) -> DataFrame:
    """Articles of a report on request: related ones, those of a span of days, those of at least a confidence (which implies related)."""
    out = articles.where("is_ai_related") if only_related or min_confidence > 0 else articles
    if days is not None:
        out = out.where(F.col("published_date").between(*days))
    return out.where(F.col("ai_confidence_score") >= min_confidence) if min_confidence > 0 else out


def daily(articles: DataFrame, analyses: DataFrame, urls: DataFrame, day: str, classed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The articles of a daily page: related ones of its days, one row per address (the newest), with display defaults and class.

    Missing titles, names and addresses take their defaults; of several analyses the latest one stands.
    ``classed`` gives the class (name, category) of names; it is asked for those of the page only.
    """
    window = articles.where(F.col("is_ai_related") & F.col("published_date").between(F.date_sub(F.lit(day).cast("date"), PAGE_DAYS - 1), F.lit(day).cast("date")))
    slim = window.select("article_id", "url_id", "title", "university_name", "published_date", "first_scraped", "summary")
    told = analyses.select("article_id", "analysis_id", "analyzed_at", "relevance_score", "consensus_summary")
    rows = slim.join(told, "article_id", "left").join(urls.select("url_id", "url"), "url_id", "left").withColumn("url", F.coalesce("url", F.lit("")))
    one = first_of_each(
        rows,
        ["url"],
        [F.desc("first_scraped"), F.desc_nulls_last("analyzed_at"), F.desc_nulls_last("analysis_id"), F.col("article_id")],
    )
    shown = one.select(
        "article_id",
        "url",
        given(F.col("title"), "Untitled").alias("title"),
        given(F.col("university_name"), "Unknown University").alias("university"),
        "published_date",
        "relevance_score",
        given(F.coalesce(F.nullif(F.col("consensus_summary"), F.lit("")), F.col("summary")), "").alias("summary"),
    )
    shown = materialize(shown, "shown")
    classes = classed(shown.select(F.col("university").alias("name")).distinct())
    return shown.join(classes.select(F.col("name").alias("university"), "category"), "university", "left").withColumn("category", F.coalesce("category", F.lit("r1")))


def ranked(df: DataFrame, order: list[Column], most: int | None = None, name: str = "rank") -> DataFrame:
    """Rows with their rank in a total order; with a limit only the top rows are ever gathered."""
    if most is None:
        return numbered(df, order, name)
    top = df.orderBy(*order).limit(most)
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def institution_counts(articles: DataFrame) -> DataFrame:
    """(university, articles, first_id): counts in descending order, ties by first appearance."""
    return articles.groupBy(given(F.col("university_name"), "Unknown").alias("university")).agg(F.count("*").alias("articles"), F.min("article_id").alias("first_id"))


def category_counts(rows: DataFrame, categories: list[str]) -> DataFrame:
    """(category, articles) for every category, also those without articles."""
    every = rows.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    return every.join(rows.groupBy("category").agg(F.count("*").alias("n")), "category", "left").select("category", F.coalesce("n", F.lit(0)).cast("long").alias("articles"))


#: A page of a nested layout holds so many items on average.
PAGE_ITEMS = 500


def nested(rows: DataFrame, outer: str, inner: str, key: str, label: str) -> DataFrame:
    """(outer, inner, page, items): JSON arrays of {id, title} for each pair of groups, ordered by id within a page.

    A group larger than a page is dealt to pages by the hash of the key, so no row grows without bound.
    """
    sizes = rows.groupBy(outer, inner).agg(F.ceil(F.count("*") / PAGE_ITEMS).alias("_pages"))
    paged = rows.join(sizes, [outer, inner]).withColumn("page", F.pmod(F.xxhash64(key), F.col("_pages")))
    item = F.struct(F.col(key).alias("id"), F.coalesce(F.col(label), F.lit("")).alias("title"))
    return paged.groupBy(outer, inner, "page").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("items"))


def topics_of(keywords: Column, most: int = 4) -> Column:
    """The first keywords of an article without their markup; empty ones and those of fifty letters or more fall away."""
    return F.filter(F.transform(F.filter(F.slice(keywords, 1, most), lambda k: k != ""), plain_line), lambda k: (k != "") & (F.length(k) < 50))


def top_topics(articles: DataFrame, most: int = 20, per_article: int = 4) -> DataFrame:
    """(topic, articles): the topics named most often among the first ones of each article; ties by name."""
    topics = articles.select(F.explode(topics_of(F.col("keywords"), per_article)).alias("topic"))
    return topics.groupBy("topic").agg(F.count("*").alias("articles")).orderBy(F.desc("articles"), "topic").limit(most)


def month_bars(articles: DataFrame) -> DataFrame:
    """(month, day, articles, bar): articles a day, scaled to the busiest day."""
    days = articles.where(F.col("published_date").isNotNull()).groupBy(F.col("published_date").alias("day")).agg(F.count("*").alias("articles"))
    most = days.agg(F.max("articles")).scalar()
    return days.select(F.date_format("day", "yyyy-MM").alias("month"), "day", "articles", (F.col("articles") * 100.0 / most).alias("bar"))


def visible(rows: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """The first rows of each group, with how many more the group has.

    Rows beyond the limit are pruned before the sort is shared, and group sizes come from a count of their own.
    """
    w = Window.partitionBy(group).orderBy(*order)
    sizes = rows.groupBy(group).agg(F.count("*").alias("_size"))
    first = rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most)
    return first.join(sizes, group).withColumn("more", F.greatest(F.col("_size") - most, F.lit(0)).cast("long")).drop("_size")


def searched(articles: DataFrame, words: str, columns: list[str]) -> DataFrame:
    """Articles of which any of the columns holds the words, whatever the letter case."""
    return articles.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(words.lower())))
