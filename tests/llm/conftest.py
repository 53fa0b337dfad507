import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, k1 string, spans string"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents with nulls, empties, repeats, ties, and extra columns whose names operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "clash", "clash") for i, t, s in rows], COLUMNS)

    return make
