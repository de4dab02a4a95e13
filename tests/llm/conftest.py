import pytest


@pytest.fixture()
def docs_of(spark):
    """Documents with clashing extra columns, from (doc_id, text) pairs."""

    def make(rows):
        full = [(i, t, "en", "src", len(t) if t is not None else None, 1, "x") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, slot int, _text string").repartition(3)

    return make
