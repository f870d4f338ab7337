"""Queries that read rows of their own before: they read a given table, and their work grows with it."""

import os

import pytest

from quillmap.plans import catalogue

SF = os.environ.get("QUILLMAP_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
TABLES = {
    "auth_class": "events",
    "body_classes": "documents",
    "bulk_data": "documents",
    "cache_header_status": "events",
    "capture_ledger": "events",
    "challenge_pages": "documents",
    "content_start_cases": "documents",
    "dependency_gate": "orders",
    "discovery_scopes": "pages",
    "fences": "documents",
    "html_directive_position": "pages",
    "links": "documents",
}


@pytest.mark.parametrize("name", sorted(TABLES))
def test_reads_its_table(spark, name):
    df = catalogue.queries()[name](spark, SF)
    assert [os.path.basename(x) for x in df.inputFiles()] == [f"{TABLES[name]}.parquet"]
