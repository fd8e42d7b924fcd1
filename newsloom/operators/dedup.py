"""Deduplication of addresses and contents: first of each key, seen checks, upserts and groups of duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of_each(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in a total order; Spark prunes each partition to its first row before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def unseen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been seen; rows with a null key count as unseen."""
    return df.join(seen.select(key).distinct(), key, "left_anti")


def already_seen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key has been seen."""
    return df.join(seen.select(key).distinct(), key, "left_semi")


def upserted(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Existing rows, replaced by incoming rows of the same key, and the incoming rows of new keys."""
    return existing.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def duplicate_groups(df: DataFrame, key: str, member: str) -> DataFrame:
    """Keys that stand more than once: (key, copies, first member); counts are summed before the shuffle."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("copies"), F.min(member).alias("first_member")).where(F.col("copies") > 1)


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Delete by key; apply it to each table that holds the key to cascade."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def flagged(df: DataFrame, marked: DataFrame, key: str, column: str, value: str) -> DataFrame:
    """Rows whose key is marked take a new value in a column; the others, null keys included, stay as they are."""
    hit = marked.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_hit", F.lit(True))
    return df.join(hit, key, "left").withColumn(column, F.when(F.col("_hit"), value).otherwise(F.col(column))).select(*df.columns)


def merged_maps(existing: DataFrame, incoming: DataFrame, key: str, column: str) -> DataFrame:
    """(key, column): maps of both tables put together by key; where both have an entry the incoming one stands, and a missing map adds nothing.

    Of several rows of a key in one table the entries of all count, the greatest value of an entry standing.
    """

    def entries(df: DataFrame, rank: int) -> DataFrame:
        return df.select(key, F.lit(rank).alias("_r"), F.explode_outer(column).alias("_k", "_v"))

    each = entries(existing, 0).unionByName(entries(incoming, 1))
    best = each.groupBy(key, "_k").agg(F.max(F.struct("_r", "_v")).alias("_b"))
    pairs = F.collect_list(F.when(F.col("_k").isNotNull(), F.struct("_k", F.col("_b._v").alias("_v"))))
    return best.groupBy(key).agg(F.map_from_entries(pairs).alias(column))
