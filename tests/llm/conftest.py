import pytest


@pytest.fixture()
def documents(spark):
    """(rows) -> documents with an extra column whose name clashes with results."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, score double")

    return make
