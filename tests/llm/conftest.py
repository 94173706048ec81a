import pytest

#: Columns that clash with names that operators use inside.
EXTRA = {"kept": "'k'", "size": "7", "n": "8", "block": "'b'", "words": "array('w')", "rank": "1", "lines": "'l'", "kind": "'x'", "start": "0", "pos": "1", "key": "'y'"}

ODD_TEXTS = [
    None,
    "",
    " \t\n",
    "one",
    "two words",
    "The quick brown fox jumps over the lazy dog and runs away.\nAgain it runs.\nAnd again.\nAnd once more.",
    "The quick brown fox jumps over the lazy dog and runs away.\nAgain it runs.\nAnd again.\nAnd once more.",
    "The quick brown fox jumps over the lazy dog and runs away.\nAgain it runs.\nAnd again.\nAnd once less.",
    "é\u0301 ß 日本語 \U0001f600 \u0085 \u3000 x",
    "a" * 700 + " " + "ab" * 600,
    "line\n" * 40,
    "123 !! ??",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts with null and repeated ids, repeated rows, null sources and languages, and clashing columns."""
    langs, sources = ["en", None, "fr", "en"], ["s1", None, "", "s2", "s1"]
    rows = [(i, t, langs[i % 4], sources[i % 5]) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], rows[5], (5, "another text under the same id", "en", "s1"), (None, "a text without an id, in English", "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "length(text) AS n_chars", *[f"{v} AS {k}" for k, v in EXTRA.items()]).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
