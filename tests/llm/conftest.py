import pytest

CLASHES = "key row_id fp row_hash id no_id hash word bits terms term told id0 id1 id2 __id __null __hash __row_id __row_hash __terms".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


@pytest.fixture
def docs(spark):
    """Documents from texts (ids count from 0) or (id, text), with further columns whose names clash with ours."""

    def make(texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, None, "s", None, *CLASHES) for i, t in rows], DOCS)

    return make
