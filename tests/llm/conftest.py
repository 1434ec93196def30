import pytest

#: doc_id, text, lang, source, and columns whose names the operators use within.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th long, h string, pos long, n long, label string, sid long, kept boolean, name string, url string"


def rows(texts):
    """(id, text) pairs as rows of SCHEMA."""
    return [(i, t, "en", "src0", 1, 1, "h", 1, 1, "label", 1, True, "name", "url") for i, t in texts]


@pytest.fixture(scope="session")
def frame(spark):
    return lambda texts: spark.createDataFrame(rows(texts), SCHEMA)


@pytest.fixture(scope="session")
def empty(frame):
    return frame([])
