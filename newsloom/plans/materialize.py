"""Cutting lineage with tables in the shared folder of the cluster.

A materialised table survives the loss of an executor, because it lies in the folder named by
``spark.checkpoint.dir`` and not on an executor's disk. Only where that setting is missing and the master
is local (tests on one machine) a local folder is made; a cluster without the setting is refused.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: str | None = None
_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only if the session names none."""
    global _local
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _local is None:
        _local = "file://" + tempfile.mkdtemp(prefix="newsloom-")
    return _local


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:
        pass  # the session is already gone


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table.

    The table keeps the schema of ``df`` and is removed by :func:`release` or when the driver ends. Reading it again prunes
    columns and costs no recomputation, and its true size is known to the planner.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def release() -> int:
    """Remove every table written so far; call it in a long session once the results that rest on them are used. Returns their number."""
    n = len(_made)
    while _made:
        path, spark = _made.popitem()
        _remove(spark, path)
    return n


atexit.register(release)
