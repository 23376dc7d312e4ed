import pytest

#: Rows with nulls, empty and repeated texts, ties, and extra columns whose names operators use themselves.
ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, row string, node string, score int"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with odd extra columns."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or ""), "x", None, "n", 1) for r in rows]
        return spark.createDataFrame(full, ODD)

    return make


@pytest.fixture
def odd(docs):
    long = " ".join(f"word{i * 7919 % 3001}" for i in range(30_000))
    return docs([
        (None, None, None), (None, "no id but a text", None), (1, None, "a"), (2, "", "b"), (3, "one two", None),
        (4, "one two", "a"), (4, "one two", "a"), (5, long, "b"), (6, "éé café \U0001f600 \t\n x", "c"), (7, long + " more", "b"),
    ])
