import pytest


@pytest.fixture
def docs(spark):
    """A table of documents from texts, ids from 0; a pair gives the id too."""

    def make(*texts, extra=False):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        if extra:
            df = df.selectExpr("doc_id", "text", "'x' AS row", "1 AS n", "2 AS part", "'y' AS k", "3L AS n_chars")
        return df

    return make
