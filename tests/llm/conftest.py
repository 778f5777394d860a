import pytest


@pytest.fixture
def docs(spark):
    """Rows of (doc_id, text) with a column whose name clashes with a result, and one with an inner name."""

    def make(rows):
        return spark.createDataFrame(
            [(i, t, "en", "src0", len(t or ""), 0.5, 1) for i, t in rows],
            "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, id int")

    return make
