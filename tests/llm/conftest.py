from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs; the other columns may clash with names the operators use."""

    def make(rows, more=""):
        data = [(i, t, "en", None if k % 3 == 0 else f"s{k % 3}", len(t or ""), *(["x"] * len(more.split(",")) if more else [])) for k, (i, t) in enumerate(rows)]
        schema = SCHEMA + "".join(f", `{c.strip()}` string" for c in more.split(",") if c)
        return spark.createDataFrame(data, schema)

    return make
