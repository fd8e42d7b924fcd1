"""The queries over the smallest tables, and the one that SQL can express."""

import os

import pytest

from newsloom.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")

COLUMNS = {
    "p1_found": [("article_id", "bigint"), ("line_no", "int")], "p2_found": [("analysis_id", "bigint"), ("field", "string")], "p3_found": [("article_id", "bigint"), ("line_no", "int")],
    "p4_found": [("article_id", "bigint")], "p5_found": [("article_id_a", "bigint"), ("article_id_b", "bigint")], "p6_found": [("article_id", "bigint"), ("institution_id", "bigint")],
    "p7_ids": [("doc_id", "bigint"), ("ids", "array<int>")], "p9_found": [("doc_id_a", "bigint"), ("doc_id_b", "bigint")],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    rows = [tuple(map(str, r)) for r in df.collect()]
    assert len(rows) == len(set(rows))
    if name in COLUMNS:
        assert df.dtypes == COLUMNS[name] and rows


def test_sql_of_texts_that_look_the_same(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = set(con.execute(queries.ORACLE_SQL["p9_found"]).fetchall())
    assert {tuple(r) for r in queries.p9_found(spark, FOLDER).collect()} == want
