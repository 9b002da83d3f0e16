import pytest


@pytest.fixture
def docs(spark):
    """documents with columns whose names the operators use inside."""

    def make(rows):
        schema = "doc_id long, text string, row_id string, w string, key string, places string, score string, lang string, n_chars long"
        return spark.createDataFrame([(d, t, "r", "w", "k", "p", "s", "en", None if t is None else len(t)) for d, t in rows], schema).coalesce(2)

    return make
