"""Queries of this package that SQL can express, against DuckDB."""

from __future__ import annotations

import pytest
from check import connect, difference

from rostrum import llm

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.oracles()))
def test_query_equals_sql(spark, name):
    found = llm.queries()[name](spark, SF)
    assert difference(found.toPandas(), connect(SF).execute(llm.oracles()[name]).df()) is None


@pytest.mark.parametrize("name", ["op2_quality", "op3_toxicity", "op5_order_minhash", "op7_language_id"])
def test_queries_give_a_row_per_document(spark, name):
    found = llm.queries()[name](spark, SF)
    assert found.select("doc_id").distinct().count() == found.count() == 200
