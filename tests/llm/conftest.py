import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def make(spark):
    """A documents table from texts, or from (doc_id, text) pairs."""

    def of(rows, extra=None):
        rows = [r if isinstance(r, tuple) else (k, r) for k, r in enumerate(rows)]
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
        return df.withColumns(extra) if extra else df

    return of
