from __future__ import annotations

import pytest


@pytest.fixture
def frame(spark):
    """Documents from (doc_id, text, source) rows, with extra columns whose names clash."""

    def make(rows):
        full = [(i, t, s, "en", 1, "x", 2, "y", 3) for i, t, s in rows]
        return spark.createDataFrame(full, "doc_id long, text string, source string, lang string, n_chars long, digest string, size long, row string, fp int")

    return make
