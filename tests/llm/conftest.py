from __future__ import annotations

import pytest
from llm_cases import TEXTS


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with the texts above, repeated rows, a null id, and columns whose names operators use inside."""
    rows = [(k, t, "en" if k % 2 else "de", None, len(t or ""), 1.5, "keep", 7) for k, t in enumerate(TEXTS)]
    rows += [rows[5], rows[11], (None, "no id here", None, None, 10, 1.5, "keep", 7)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, print string, row long"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
