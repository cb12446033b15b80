import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, part int, kind int, digest string, n long, id long, keys string, _id string"


def rows_of(texts):
    """Rows with columns whose names clash with those that the operators use."""
    return [(i, t, None, "s", None, "x", 1, 2, "d", 3, 4, "k", "z") for i, t in texts]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts):
        return spark.createDataFrame(rows_of(texts), SCHEMA)

    return make


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
