import pytest
from corpus_rows import corpus

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, batch string, kept string, n_words string, bucket int, component string"


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus with columns whose names clash with those used inside the operators; some rows are repeated."""
    full = [(i, t, "en", f"s{(i or 0) % 3}" if i != 5 else None, len(t or ""), "x", "no", "7", 1, "c") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
