import pytest

#: Documents that hold the awkward cases: nulls, empty and blank texts, ties, copies, repeated rows, a long text, other scripts.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog", "a"),
    (2, "The  quick brown\tfox jumps over the lazy dog ", "a"),
    (3, "the quick brown fox jumps over the lazy dog", "b"),
    (4, None, None),
    (5, "", "b"),
    (6, " \n\t", "a"),
    (7, "one", "c"),
    (8, "one two", "c"),
    (9, "éüß 中文 😀 <|endoftext|> it's  a b\r\n", None),
    (10, "word " * 30000, "b"),
    (11, "The quick brown fox jumps over the lazy dog", "a"),
    (None, "a row without an id", "b"),
    (None, None, "a"),
    (7, "one", "c"),
    (14, "\n".join(f"line {i} of a longer text, with words {i * 7} and {i * 13}." for i in range(60)), "a"),
    (15, "\n".join(f"line {i} of a longer text, with words {i * 7} and {i * 13}." for i in range(61)), "b"),
]


@pytest.fixture(scope="session")
def docs(spark):
    # columns whose names clash with those that operators make
    rows = [(i, t, s, "x", 3, "k", 1.5, True) for i, t, s in ROWS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, copies string, size int, key string, score double, kept boolean")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, source string, lang string")
