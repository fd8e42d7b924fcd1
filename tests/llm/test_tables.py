"""The queries on empty tables, and on tables with nulls, repeated rows and columns of clashing names."""

import os

import pytest
from pyspark.sql import functions as F

from newsloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")
#: Names that the operators use themselves.
CLASH = ("h", "key", "keys", "source", "shared", "rep", "copy", "words", "bands", "look", "exact", "shard", "near", "terms", "leaf", "salt", "line", "name", "form", "n", "ending", "hostname", "doc", "pos", "counter")


def written(spark, out, change):
    for f in os.listdir(FOLDER):
        df = spark.read.parquet(f"{FOLDER}/{f}")
        change(f[:-8], df).coalesce(1).write.parquet(f"{out}/{f}")
    return str(out)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("empty"), lambda name, df: df if name == "pack_specs" else df.limit(0))


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """Each table with every clashing column that it lacks; articles, analyses and documents once more as they are, and a row of nulls but for its id."""
    ids = {"articles": "article_id", "ai_analyses": "analysis_id", "documents": "doc_id"}

    def change(name, df):
        if name in ids:
            nothing = df.limit(1).select(*((F.lit(-1) if c == ids[name] else F.lit(None)).cast(t).alias(c) for c, t in df.dtypes))
            df = df.unionByName(df.limit(20) if name != "documents" else df.limit(0)).unionByName(nothing)
        return df.select("*", *(F.lit("clash").alias(c) for c in CLASH if c not in df.columns))

    return written(spark, tmp_path_factory.mktemp("crowded"), change)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_found", "p7_ids", "p9_found"])
def test_crowded_tables(spark, crowded, name):
    plain = {tuple(map(str, r)) for r in QUERIES[name](spark, FOLDER).collect()}
    got = {tuple(map(str, r)) for r in QUERIES[name](spark, crowded).collect()}
    assert got - plain <= {("-1", "[]")} and plain <= got


def test_crowded_containers(spark, crowded):
    tokens = lambda d: {(r.spec_id, r.doc_id): r.t for r in QUERIES["p8_containers"](spark, d).groupBy("spec_id", "doc_id").agg(F.sum("tokens").alias("t")).collect()}
    assert tokens(crowded) == tokens(FOLDER)
