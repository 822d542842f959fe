"""Queries of the package against their SQL twins."""

import os
import sys

import pytest
from llm import registry

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import assert_same, duck  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, SF), duck(SF), registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_covers_the_table(spark, name):
    out = registry.QUERIES[name](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    if name == "op2_mixing":
        assert out.join(docs, "doc_id", "left_anti").count() == 0
    else:
        assert out.count() == docs.count()
