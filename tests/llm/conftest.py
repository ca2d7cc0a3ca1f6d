import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows, with columns whose names operators use themselves."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 1, "x", 2, *range(9)) for r in rows]
        return spark.createDataFrame(full, DOCS + ", shard int, spans string, n int, " + ", ".join(f"{c} int" for c in "row at pos slot parts cdf key node component".split()))
    return make
