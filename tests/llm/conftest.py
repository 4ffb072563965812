import pytest


@pytest.fixture
def docs_of(spark):
    """A table of documents from texts, with clashing and null-ridden extra columns."""

    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, None, "s", None, 7, "x") for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(
            rows,
            "doc_id long, text string, lang string, source string, n_chars long, id int, h string",
        )

    return make


@pytest.fixture(scope="session")
def tables(spark):
    from pathlib import Path

    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no test tables")
    return str(folder)

