import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty and blank texts, repeated rows, ties, a long text, and columns whose names the operators use themselves."""
    long = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
    token = 'the reader of the page said token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" and went on'
    rows = [
        (1, None, None, None), (2, "", "en", "s"), (3, " \t\n", "en", "s"), (4, "one two", "en", "s"), (5, "one two", "fr", "s"), (5, "one two", "fr", "s"),
        (6, long, "en", "s"), (7, long + " tail", "en", "s"), (8, token, "de", None), (9, "ÄÖ ▁ 日本語 😀 \x00 end", None, "s"), (None, "no id at all here for this row", "es", "s"), (10, "12345 ... !!!", "de", "s"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, "k", 2.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, id int, key string, label double")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
