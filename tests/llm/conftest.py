import pytest


@pytest.fixture(scope="session")
def texts():
    """A small table of awkward documents: (doc_id, text)."""
    return [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today."),
        (2, "The quick  brown fox\njumps over the lazy dog near the river bank today."),
        (3, None), (4, ""), (5, " \t\n"), (6, "one"), (7, "12345 !!! 67890"),
        (8, "größer Straße über naïve façade — ünïcödé 😀 text"),
        (9, "x" * 70000), (10, "word " * 20000),
        (11, "The quick brown fox jumps over the lazy dog near the river bank today."),
        (11, "The quick brown fox jumps over the lazy dog near the river bank today."),
        (None, "a row without an id"), (None, None),
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The same with columns whose names clash with the operators' own."""
    extra = ("lang string, kept boolean, keep_id long, shard int, slot int, _k1 long, h long, x long, t string, "
             "w string, pos int, n long, sig string, score double, spans string, pieces binary, _row string, cut string")
    n = len(extra.split(", "))
    return spark.createDataFrame([(i, t, *[None] * n) for i, t in texts], f"doc_id long, text string, {extra}")


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
