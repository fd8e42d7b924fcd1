"""Every query of the core on empty tables: it ends, and gives no rows but those that are always there."""

import os

import pytest

import __spark_entry__  # noqa: F401  registers all queries
from newsloom.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")

#: Totals, fixed lists and the lines that a document has in any case.
ALWAYS = {
    "example_analysis_success": 1, "category_counts": 5, "average_confidence": 1, "validation_totals": 1, "bloom_fpr": 1, "export_json_envelope": 3, "source_sets": 5, "table_catalogue": 16, "health_report_scan": 1,
    "corrections_by_category": 3, "migration_totals": 1, "text_report": 1, "mail_message": 6, "crawl_totals": 1, "recommendation_counts": 1, "status_counts": 1, "file_listing": 1, "display_name_shapes": 11,
}


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("empty")
    for f in os.listdir(FOLDER):
        spark.read.parquet(f"{FOLDER}/{f}").limit(0).coalesce(1).write.parquet(f"{out}/{f}")
    return str(out)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert len(QUERIES[name](spark, empty).collect()) == ALWAYS.get(name, 0)
