import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, sig string, n long, pos int, line int, _row int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents with extra columns whose names clash with names the operators use themselves"""
    def make(rows):
        full = [(d, t, g, s, None if t is None else len(t), 7, "x", 1, 2, 3, 4) for d, t, g, s in rows]
        return spark.createDataFrame(full, DOCS)
    return make
