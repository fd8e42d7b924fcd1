"""Lines repeated across one site's documents (problem 1).

Lines are counted in two passes. The first makes one mergeable summary per source: a bank of counters
that a line falls into by its hash. Each task fills the banks of its own rows, and banks of one source are
added up counter by counter, so that neither a source nor a line is ever gathered in one place. A counter
bounds the count of each of its lines from above: lines of counters below the limit are ruled out, and
none that reaches the limit is lost. The second pass counts exactly, and only the candidates left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import sitelines
from newsloom.plans.materialize import materialize

#: A line is repeated if it stands in at least so many different articles of its source.
MIN_ARTICLES = 8
#: Counters in the bank of a source; only those in use take room.
COUNTERS = 1 << 22
#: Confirmed lines are broadcast up to this many (16 bytes each); beyond it they are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def repeated_keys(keyed: DataFrame, min_articles: int = MIN_ARTICLES) -> DataFrame:
    """Lines (h, key, articles) that stand in at least ``min_articles`` articles of their source, of rows of :func:`sitelines.keyed`."""
    once = keyed.select("h", "article_id", F.explode(F.array_distinct("keys")).alias("key")).where("key <> 0").withColumn("counter", F.pmod("key", F.lit(COUNTERS)))
    heavy = once.groupBy("h", "counter").agg(F.count("*").alias("bound")).where(F.col("bound") >= min_articles).select("h", "counter")
    candidates = once.join(heavy, ["h", "counter"], "left_semi")
    return candidates.groupBy("h", "key").agg(F.count_distinct("article_id").alias("articles")).where(F.col("articles") >= min_articles)


def repeated_lines(articles: DataFrame, urls: DataFrame, excluded: DataFrame | None = None, min_articles: int = MIN_ARTICLES, keyed: DataFrame | None = None) -> DataFrame:
    """Lines (article_id, line_no, source, key, articles) that repeat within their source.

    Lines are the same if their letters agree, whatever their case, digits, signs and white space;
    lines without letters, articles without content or source, and ``excluded`` ones give no rows.
    Repeated rows of one article_id count once. ``keyed`` is a written table of :func:`sitelines.keyed`, if there is one.
    """
    if keyed is None:
        keyed = materialize(sitelines.keyed(articles, urls), "linekeys")
    if excluded is not None:
        keyed = keyed.join(excluded.select("article_id").distinct(), "article_id", "left_anti")
    confirmed = materialize(repeated_keys(keyed, min_articles), "repeated")
    small = confirmed.count() <= BROADCAST_KEYS
    lines = keyed.select("article_id", "source", "h", F.posexplode("keys").alias("pos", "key")).where("key <> 0")
    return (
        lines.join(F.broadcast(confirmed) if small else confirmed, ["h", "key"])
        .select("article_id", (F.col("pos") + 1).cast("int").alias("line_no"), "source", "key", "articles")
        .dropDuplicates(["article_id", "line_no"])
    )


def without_repeated(articles: DataFrame, found: DataFrame) -> DataFrame:
    """Articles (article_id, content, removed): content without the lines of ``found`` (article_id, line_no).

    Articles without such lines keep their content, null and empty included; ``removed`` counts lines.
    """
    gone = found.groupBy("article_id").agg(F.collect_set("line_no").alias("gone"))
    lines = F.split("content", "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.coalesce(F.array_contains("gone", (i + 1).cast("int")), F.lit(False)))
    return articles.select("article_id", "content").join(gone, "article_id", "left").select(
        "article_id",
        F.when(F.col("gone").isNull(), F.col("content")).otherwise(F.array_join(kept, "\n")).alias("content"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("int").alias("removed"),
    )
