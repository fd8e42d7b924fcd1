"""Reconciliation of configuration records: duplicates, corrections, repairs and migrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merged_sets(df: DataFrame, key: str, value: str, priority: str, flag: str) -> DataFrame:
    """(key, entries, best, others, priority, flag): the values of each key as a sorted set, the first one apart."""
    return df.groupBy(key).agg(
        F.count("*").alias("entries"), F.sort_array(F.collect_set(value)).alias("_v"), F.max(priority).alias("priority"), F.bool_or(flag).alias("flag")
    ).select(key, "entries", F.try_element_at("_v", F.lit(1)).alias("best"), F.array_join(F.slice("_v", F.lit(2), F.greatest(F.size("_v"), F.lit(1))), " ").alias("others"), "priority", "flag")


def best_by_score(df: DataFrame, key: str, value: str, score: Column, seq: str) -> DataFrame:
    """(key, best, score): the value with the highest score, the first one of equals."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(score, -F.col(seq))).alias("best"), F.max(score).cast("long").alias("score"))


def cross_file(primary: DataFrame, other: DataFrame, key: str, value: str, verified: str) -> DataFrame:
    """Primary rows whose value is replaced by the other file's where only that one is verified."""
    o = other.groupBy(key).agg(F.max_by(value, F.col(verified).cast("int")).alias("_v"), F.bool_or(verified).alias("_ok"))
    joined = primary.join(o, key, "left")
    take = F.coalesce("_ok", F.lit(False)) & ~F.coalesce(verified, F.lit(False))
    return joined.select(key, F.when(take, F.col("_v")).otherwise(F.col(value)).alias(value), (F.coalesce(verified, F.lit(False)) | take).alias(verified), take.alias("replaced"))


def repaired(rows: DataFrame, tiers: list[tuple[str, Column]], current: str) -> DataFrame:
    """Rows with the value and the name of the first tier that gives one, and whether it changes the current value."""
    value = F.coalesce(*(v for _, v in tiers))
    tier = F.coalesce(*(F.when(v.isNotNull(), name) for name, v in tiers), F.lit("review"))
    return rows.withColumn("new_value", value).withColumn("tier", tier).withColumn("changed", F.coalesce(value != F.col(current), F.lit(False)))


def applied(rows: DataFrame, current: str, dry_run: bool) -> DataFrame:
    """Repaired rows with their changes applied, or left as they were in a dry run."""
    return rows if dry_run else rows.withColumn(current, F.when(F.col("changed"), F.col("new_value")).otherwise(F.col(current)))


def primary_source(sources: Column) -> Column:
    """The first source of type primary, else the first source, else null."""
    return F.coalesce(F.try_element_at(F.filter(sources, lambda x: x["type"] == "primary"), F.lit(1)), F.try_element_at(sources, F.lit(1)))


def migrated(primary: Column, extra: Column) -> Column:
    """One array of sources from a primary object and further ones; a missing primary adds nothing."""
    return F.concat(F.when(primary.isNotNull(), F.array(primary)).otherwise(F.slice(extra, 1, 0)), extra)


def change_log(repairs: DataFrame, key: str, current: str, dry_run: bool) -> DataFrame:
    """(key, old, new, tier, applied): what :func:`repaired` would change, written down whether or not it is applied."""
    return repairs.where("changed").select(key, F.col(current).alias("old"), F.col("new_value").alias("new"), "tier", F.lit(not dry_run).alias("applied"))


def changes_by(log: DataFrame, by: str) -> DataFrame:
    """(by, changes, values, sample): how many changes each tier or old name has, to how many new values, and the least of them."""
    return log.groupBy(by).agg(F.count("*").alias("changes"), F.count_distinct("new").alias("values"), F.min("new").alias("sample"))


def migration_stats(sources: DataFrame, column: str) -> DataFrame:
    """(entries, sources, several): entries, their sources in all, and the entries with more than one."""
    n = F.coalesce(F.size(column), F.lit(0))
    return sources.agg(F.count("*").alias("entries"), F.coalesce(F.sum(n), F.lit(0)).alias("sources"), F.count_if(n > 1).alias("several"))
