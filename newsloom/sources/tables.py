"""Readers of the engine's tables: one Parquet file or folder for each table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read ``name`` from ``folder``; columns and filters are pushed into the scan by Catalyst."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def described(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """(name, columns, rows) of tables: how many columns each has, and how many rows, which Parquet tells from its footers alone."""
    out = None
    for n in names:
        df = table(spark, folder, n)
        row = df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), F.lit(len(df.columns)).cast("long").alias("columns"), "rows")
        out = row if out is None else out.unionByName(row)
    return out
