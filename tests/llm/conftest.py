import pytest

#: Rows with nulls, empty and long texts, ties and repeated rows.
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from here now"),
    (2, "the quick brown fox jumps over the lazy dog and runs far away from here now"),
    (2, "the quick brown fox jumps over the lazy dog and runs far away from here now"),
    (3, None),
    (4, ""),
    (5, "!!! ..."),
    (6, "one"),
    (7, "one"),
    (8, "ünïcödé wörds and ASCII " * 40),
    (9, "a " * 3000 + "tail@example.org"),
    (10, "x" * 5000),
    (11, "mail me.at+home@mail.example.com or 10.0.0.300 or 192.168.1.255; card 4111 1111 1111 1111, no card 4111 1111 1111 1112"),
    (12, "+1 (212) 555-0100 and +1 23 and a@b.c_d@e.f and 1.2.3.4.5"),
    (None, "a row without an id"),
]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en", "src0", len(t or ""), "clash") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string").withColumnsRenamed({}).selectExpr("*", "'x' as key", "1 as row", "'y' as words")


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
