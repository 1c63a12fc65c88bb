"""Fixtures of the training-data tests; test modules import them by name."""

import pytest

#: A text with many words, long enough to cross the operators' blocks of text.
LONG = " ".join(f"word{i % 5000}x{i % 7} the" for i in range(200_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns named like results."""
    rows = [
        (1, None, "en"), (2, "", None), (3, "   \n\t ", "en"), (None, "a text without an id but with words", "en"),
        (4, LONG, "en"), (5, "the same text twice in two rows", "fr"), (5, "the same text twice in two rows", "fr"),
        (6, "the same text twice in two rows", None), (7, "漢字 ▁ \u0000 😀 <|endoftext|> a  b", "xx"),
    ]
    extra = ("n_words", "score", "kept", "spans", "items", "cls", "part", "row", "id", "n", "labels", "band_lang")
    schema = "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in extra)
    return spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
