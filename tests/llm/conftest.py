import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text, lang, source) as a documents table, with columns that clash with the operators' own."""

    def make(rows):
        df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)
        extra = {"size": "1", "rate": "2", "kept": "3", "id": "4", "a": "5", "key": "6", "word": "7", "score": "8", "host": "9", "component_id": "0"}
        return df.selectExpr("*", *[f"'{v}' AS {k}" for k, v in extra.items()])

    return make


@pytest.fixture
def odd_rows():
    """Nulls in every column, empty and blank texts, ties, repeated rows, one very long text."""
    long = " ".join(f"word{i % 977} is here" for i in range(30_000))
    return [
        (1, "The cat sat on the mat and looked at the dog for a while before it left the room again.", "en", "a"),
        (1, "The cat sat on the mat and looked at the dog for a while before it left the room again.", "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, "b"),
        (4, " \t\n \x0b", "fr", None),
        (None, "no identifier at all but some words that make a line", "en", "a"),
        (None, None, None, None),
        (5, "1234 5678 !!! ###", "de", "b"),
        (6, long, "en", "b"),
        (7, "one", "en", None),
        (8, "über größe naïve Ça été — „quotes“ 漢字   nbsp", "de", "b"),
    ]
