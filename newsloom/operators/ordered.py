"""Order over whole tables and along keys without gathering a table or a hot key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.plans.materialize import materialize


def numbered(df: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """Rows numbered from 1 in a total order.

    Rows are dealt to ranges of the order, numbered inside each range, and shifted by the sizes of the
    ranges before; only one row per range is ever put in one place.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_p", before.alias("_o"))
    inner = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.join(F.broadcast(offsets), "_p").withColumn(name, (inner + F.col("_o")).cast("long")).drop("_p", "_o")


def even_parts(n: Column, total: Column, parts: int) -> Column:
    """Part of row ``n`` of ``total`` among ``parts`` even ones; the first parts take the remainder."""
    size, more = F.floor(total / parts), total % parts
    ahead = more * (size + 1)
    return F.when(n <= ahead, F.ceil(n / (size + 1))).otherwise(more + F.ceil((n - ahead) / F.greatest(size, F.lit(1)))).cast("int")


def _slices(df: DataFrame, at: str, seconds: int) -> DataFrame:
    return df.withColumn("_s", F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (seconds * 1_000_000)))


def previous(df: DataFrame, key: str, at: str, tie: str, seconds: int = 86_400) -> DataFrame:
    """Rows with the time of the row before theirs (column previous) along (at, tie) of their key; null for a key's first row.

    Keys are cut into slices of time, so a key with very many rows is spread over tasks: inside a slice
    the row before is found by a window, and the first row of a slice takes the last one of the slices
    before, of which there is one each. Rows without a time have no row before them.
    """
    rows = _slices(df, at, seconds)
    inner = F.lag(at).over(Window.partitionBy(key, "_s").orderBy(at, tie))
    last = rows.where(F.col("_s").isNotNull()).groupBy(key, "_s").agg(F.max(at).alias("_last"))
    earlier = last.select(key, "_s", F.lag("_last").over(Window.partitionBy(key).orderBy("_s")).alias("_earlier"))
    joined = rows.withColumn("_in", inner).join(earlier, [key, "_s"], "left")
    return joined.withColumn("previous", F.when(F.col("_s").isNotNull(), F.coalesce("_in", "_earlier"))).drop("_s", "_in", "_earlier")


def carried(df: DataFrame, key: str, at: str, tie: list[str], value: str, seconds: int = 30 * 86_400) -> DataFrame:
    """Rows with the last value that is not null at or before theirs along (at, tie) of their key (column carried).

    Cut into slices of time like :func:`previous`.
    """
    rows = _slices(df, at, seconds)
    inner = F.last(value, ignorenulls=True).over(Window.partitionBy(key, "_s").orderBy(at, *tie).rowsBetween(Window.unboundedPreceding, 0))
    last = rows.where(F.col(value).isNotNull() & F.col("_s").isNotNull()).groupBy(key, "_s").agg(F.max_by(value, F.struct(at, *tie)).alias("_last"))
    slices = rows.where(F.col("_s").isNotNull()).select(key, "_s").distinct().join(last, [key, "_s"], "left")
    w = Window.partitionBy(key).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    earlier = slices.select(key, "_s", F.last("_last", ignorenulls=True).over(w).alias("_earlier"))
    joined = rows.withColumn("_in", inner).join(earlier, [key, "_s"], "left")
    return joined.withColumn("carried", F.when(F.col("_s").isNotNull(), F.coalesce("_in", "_earlier"))).drop("_s", "_in", "_earlier")
