import pytest

#: Texts of every awkward kind: null, empty, white space, ties, repeats, long, other alphabets.
ODD = [None, "", "   \n\t ", "one", "a b c d", "Same Words here and Here again now", "same words HERE and here again now", "x" * 4000, "w " * 3000, "é ü 漢字 👍🏽 İ ſ", "tab\tand\x0bmore\x0cws"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Awkward documents, with a repeated row, a repeated id, a null id and columns that clash by name."""
    rows = [(i, t, "en", None if i % 3 == 0 else f"s{i % 2}", i, "x", 1) for i, t in enumerate(ODD)]
    rows += [rows[5], (5, "another text of the same id with several words", "en", "s1", 1, "x", 2), (None, "a text without an id but words", "en", "s0", 1, "x", 3), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, size int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
