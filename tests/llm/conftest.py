from __future__ import annotations

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    """docs_of(texts or (id, text) pairs) -> documents table."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS).repartition(3)

    return make


#: Nulls, empty, white space, repeated rows, repeated and null ids, very long.
HARD = [(0, None), (1, ""), (2, " \n\t "), (3, "word"), (4, "same text here"), (4, "same text here"), (None, "no id " * 30), (None, None), (5, "long line of words " * 60_000)]
