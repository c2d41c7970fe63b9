from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """Documents of (doc_id, text) pairs, with the table's other columns."""
    def make(rows):
        return spark.createDataFrame([(i, t, None, "src0", None if t is None else len(t)) for i, t in rows], DOCS)

    return make
