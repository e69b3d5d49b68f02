"""Small tables for the tests of the training-data operators."""

from __future__ import annotations

import pytest


@pytest.fixture
def documents(spark):
    """A table of documents from ``(doc_id, text)`` pairs, with clashing extra columns."""

    def make(rows, **extra):
        full = [(i, t, "en", "src0", len(t or ""), "x", "y") for i, t in rows]
        schema = (
            "doc_id long, text string, lang string, source string, n_chars long, "
            "score string, hits string"
        )
        return spark.createDataFrame(full, schema).repartition(3)

    return make
