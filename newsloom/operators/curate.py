"""Editorial candidates and picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.consensus import composite
from newsloom.operators.ordered import numbered


def impacts(articles: DataFrame) -> DataFrame:
    """Articles with the impacts of their metadata and the composite of them."""
    shape = "impact_scores struct<scientific:double,financial:double,partnership:double>"
    told = articles.withColumn("_m", F.from_json("article_metadata", shape)["impact_scores"])
    named = told.select("*", *(F.col("_m")[c].alias(c) for c in ("scientific", "financial", "partnership"))).drop("_m")
    return named.withColumn("composite", composite("scientific", "financial", "partnership"))


def pool(articles: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Related and analysed articles published after the moment ``days`` before ``as_of``; the day of that moment itself is out."""
    return articles.where(
        F.col("is_ai_related") & F.col("last_analyzed").isNotNull() & (F.col("published_date").cast("timestamp_ntz") >= as_of.cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))
    )


def candidates(articles: DataFrame, most: int = 50) -> DataFrame:
    """The candidates with the highest composite, ties by article_id."""
    return impacts(articles).orderBy(F.desc("composite"), "article_id").limit(most)


def picked(picks: DataFrame, articles: DataFrame) -> DataFrame:
    """Picks (rank, article_id, note, category) joined to their articles and numbered anew in pick order."""
    joined = picks.join(articles.select("article_id", "title"), "article_id")
    return numbered(joined, [F.col("rank"), F.col("article_id")], "position")
