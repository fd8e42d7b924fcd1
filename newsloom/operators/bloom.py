"""Bloom filter over text keys, bit for bit reproducible and built in parallel.

An item's k places are SHA-256 of the item with the number of the hash, modulo the size of the filter. The
filter is a table of set places in blocks, so it can be of any size and is never gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, HASHES = 10_000_000, 3
#: Bits of a block.
BLOCK = 1 << 15


def _modulo(hex_text: Column, size: int) -> Column:
    """A hash of 64 hex digits modulo ``size``, in chunks of eight digits so that no step overflows."""
    rest = F.lit(0).cast("long")
    for i in range(8):
        chunk = F.conv(F.substring(hex_text, 1 + 8 * i, 8), 16, 10).cast("long")
        rest = (rest * F.lit((1 << 32) % size) + chunk) % F.lit(size)
    return rest


def places(item: Column, size: int = SIZE, hashes: int = HASHES) -> Column:
    """The places of an item in the filter."""
    return F.array(*(_modulo(F.sha2(F.concat(item, F.lit(str(i))), 256), size) for i in range(hashes)))


def built(items: DataFrame, key: str, size: int = SIZE, hashes: int = HASHES) -> DataFrame:
    """The filter (block, bits) of the keys; null keys set nothing."""
    at = items.where(F.col(key).isNotNull()).select(F.explode(places(F.col(key), size, hashes)).alias("p"))
    return at.select((F.col("p") / BLOCK).cast("long").alias("block"), (F.col("p") % BLOCK).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def maybe_seen(items: DataFrame, key: str, bloom: DataFrame, size: int = SIZE, hashes: int = HASHES) -> DataFrame:
    """Keys (key) of items that the filter may hold: none that was added is missing, some others may come."""
    asked = items.where(F.col(key).isNotNull()).select(key).distinct().withColumn("p", F.explode(places(F.col(key), size, hashes)))
    set_bit = F.conv(F.hex(F.substring("bits", (F.floor((F.col("p") % BLOCK) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = asked.withColumn("block", (F.col("p") / BLOCK).cast("long")).join(bloom, "block", "left")
    on = F.coalesce(F.floor(set_bit / F.pow(F.lit(2.0), F.col("p") % 8)) % 2 == 1, F.lit(False))
    return hit.groupBy(key).agg(F.bool_and(on).alias("all_set")).where("all_set").select(key)


def false_positive_rate(added: Column, size: int = SIZE, hashes: int = HASHES) -> Column:
    """Expected share of false positives after so many additions, repeats counted; 0 when nothing was added."""
    return F.when(added == 0, 0.0).otherwise(F.pow(1 - F.exp(-hashes * added / F.lit(float(size))), hashes))
