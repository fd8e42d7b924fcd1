"""Consensus of several providers on an article."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How many providers vote at most; the confidence of a verdict is the share of them that voted.
PROVIDERS = 3


def consensus(articles: DataFrame, votes: DataFrame) -> DataFrame:
    """Verdict per article (article_id, providers, is_ai_related, relevance, confidence, summary).

    ``votes``: (article_id, priority, vote, relevance, summary). More than half of the votes decide, a tie
    is no; the relevance is the mean of those given, 5 if none is; the summary is that of the provider
    first in priority. Without votes the verdict is null and the relevance 0.
    """
    counted = votes.where(F.col("vote").isNotNull()).groupBy("article_id").agg(
        F.count("*").alias("providers"),
        (F.sum(F.col("vote").cast("int")) * 2 > F.count("*")).alias("is_ai_related"),
        F.coalesce(F.avg("relevance"), F.lit(5.0)).alias("relevance"),
        (F.count("*") / F.lit(float(PROVIDERS))).alias("confidence"),
        F.min_by("summary", F.when(F.coalesce(F.col("summary"), F.lit("")) != "", F.col("priority"))).alias("summary"),
    )
    return articles.select("article_id").join(counted, "article_id", "left").select(
        "article_id",
        F.coalesce("providers", F.lit(0)).cast("long").alias("providers"),
        "is_ai_related",
        F.coalesce("relevance", F.lit(0.0)).alias("relevance"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.when(F.col("providers").isNull(), "Analysis unavailable").otherwise(F.col("summary")).alias("summary"),
    )


def composite(scientific: str, financial: str, partnership: str):
    """Mean of three impacts, each 3 where it is missing."""
    three = [F.coalesce(F.col(c).cast("double"), F.lit(3.0)) for c in (scientific, financial, partnership)]
    return (three[0] + three[1] + three[2]) / 3
