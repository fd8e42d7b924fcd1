"""Latest row per key, also as of a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.ordered import carried


def latest_per(df: DataFrame, key: str, at: str, tie: str, as_of: Column | None = None) -> DataFrame:
    """The row of each key with the largest (at, tie), not later than ``as_of``; rows without a time fall away.

    One aggregate carries the whole row, so no sort is needed and a key with very many rows is reduced
    before the shuffle.
    """
    rows = df.where(F.col(at).isNotNull())
    if as_of is not None:
        rows = rows.where(F.col(at) <= as_of)
    others = [c for c in df.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(at, tie)).alias("_row"))
    return best.select(key, *(F.col("_row")[c].alias(c) for c in others))


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, tie: str, columns: list[str]) -> DataFrame:
    """Each left row with the latest right row of its key that is not later; nulls where there is none.

    Both sides are put in one stream per key and the last right row is carried forward, slice of time by
    slice of time, so no pair of rows is formed and no key is gathered in one task. Left rows without a
    time match nothing.
    """
    fields = [c for c in left.columns if c != key]
    l = left.select(key, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_tie"), F.struct(*fields).alias("_l"), F.lit(None).alias("_r"))  # noqa: E741
    r = right.where(F.col(right_at).isNotNull()).select(key, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.col(tie).cast("long").alias("_tie"), F.lit(None).alias("_l"), F.struct(*columns).alias("_r"))
    both = carried(l.unionByName(r), key, "_at", ["_side", "_tie"], "_r").where(F.col("_side") == 1)
    return both.select(key, *(F.col("_l")[c].alias(c) for c in fields), *(F.col("carried")[c].alias(c) for c in columns))
