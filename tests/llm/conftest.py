import pytest


@pytest.fixture
def frame(spark):
    """A DataFrame of documents from tuples (doc_id, text), with the other columns of the table."""

    def make(rows, extra=""):
        full = [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint")

    return make
