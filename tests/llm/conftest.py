import pytest

SF = "/root/testdata/sf0.001"

#: Texts for edge cases: null, empty, spaces, ties, repeats, long, many scripts.
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two"), (6, "a b c a b c a b c"), (7, "Same line\nsame LINE \n\nother"), (8, "Same line\nsame LINE \n\nother"),
    (9, "Été \U0001f600 中文 naïve café " * 40), (10, "x" * 300), (11, "word " * 5000), (11, "word " * 5000), (None, "no id at all here"), (None, None), (12, "tail\x1cof\x0bodd\x85spaces here"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts in a table whose other columns clash with names that operators use."""
    rows = [(i, t, "en", "s", 7, 8, "t", 3) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept_text string, rule int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")
