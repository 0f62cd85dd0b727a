import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    long = " ".join(f"wort{i % 977} and" for i in range(6000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "s", 5), (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "s", 5), (2, None, None, None, None), (3, "", "en", "s", 0),
        (4, long, "en", "s", 1), (5, "the quick brown fox jumps over the lazy dog and runs away", "en", "s", 5), (None, "no id here at all", "en", None, 3), (6, "  \n\t ", None, "s", 1), (7, "día 日本語 😀 <|im_end|>\x00", "es", "s", 9), (8, "12 34 !!", "en", "s", 2),
        (9, "langeswort" * 5000, None, "s", 50000),
    ]
    return spark.createDataFrame([(*r, 0.5, "x", "y") for r in rows], DOCS + ", score double, lang_pred string, _text string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


def pytest_collection_modifyitems(items):
    pytest.importorskip("strandlake.llm")
