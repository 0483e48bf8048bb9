import pytest
from conftest import SF_DIR

# Null and empty texts, no id, repeated rows, blanks only, one very long text and one very long word.
ODD = [
    (1, None, None, "a"),
    (2, "", "en", None),
    (3, " \t\n ", "en", "a"),
    (3, " \t\n ", "en", "a"),
    (None, "no id here, call +1 (264) 555-5961 now", "en", "b"),
    (None, None, None, None),
    (5, "the same text twice", "en", "b"),
    (6, "the same text twice", "en", "b"),
    (7, "word and other words " * 20_000, "en", "c"),
    (8, "x" * 50_000, None, "c"),
    (9, "é漢字🙂 ▁ <s> 12.34.56.78 a@b.cd", "fr", "c"),
]
CLASHES = ["score", "output", "ids", "mix", "fp", "at", "n_tokens", "sketch", "kept", "chosen", "range", "of", "a.b", "slot", "group", "length", "terms"]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with columns named like those the operators make."""
    names = ", ".join(f"`{c}` string" for c in CLASHES)
    rows = [(*r, None if r[1] is None else len(r[1]), *["mine"] * len(CLASHES)) for r in ODD]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {names}")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}
