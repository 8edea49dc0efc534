import pytest

from pairforge.llm.common import ship

# Columns of the operators' own, to see that they do not clash with those of a table.
CLASHING = "score double, row long, term string, node long, kept boolean, start int, place string, digest string, n long"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture
def documents(spark):
    """A table of documents from (doc_id, text) pairs, with clashing columns beside them."""

    def make(rows, lang=None, parts=3):
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING
        full = [
            (i, t, (lang or {}).get(i), "s", None if t is None else len(t), 0.5, 1, "x", 2, True, 3, "p", "d", 4)
            for i, t in rows
        ]
        return spark.createDataFrame(full, schema).repartition(parts)

    return make
