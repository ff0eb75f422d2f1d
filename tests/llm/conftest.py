import pytest


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with columns of their own whose names operators use inside."""

    def make(texts, ids=None):
        rows = [(i if ids is None else ids[i], t, "en", "s", 0, "x", 1, "d") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, n long, row string")

    return make
