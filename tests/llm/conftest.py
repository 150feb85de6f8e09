import pytest

LONG = "alpha beta gamma delta epsilon " * 4000
ODD = [
    (0, None), (1, ""), (2, "   \n\t\n"), (3, "one"), (4, "one two"), (5, LONG), (6, "same text here, twice"), (6, "same text here, twice"), (7, "same text here, twice"),
    (8, "x" * 30_000), (9, "mail me at a.b@c.org or +49 (30) 123456-78\nsecond line é漢字 🙂"), (10, "\n\n\nline\nline\nline"), (None, "no id"), (None, None), (-5, "negative id\nwith lines"), (11, "<|endoftext|> inside <|endoftext|>"),
]
#: Names that operators use inside.
CLASHES = ("size", "shard", "slot", "h", "n", "score", "rank", "comp", "tkey", "_id", "gone", "spans", "k", "t", "words", "key", "term")


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table of documents from (doc_id, text) pairs."""

    def make(rows, clashes=False):
        df = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        if clashes:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit("x") for c in CLASHES})
        return df

    return make


@pytest.fixture(scope="session")
def odd(documents):
    return documents(ODD, clashes=True)


@pytest.fixture(scope="session")
def empty(documents):
    return documents([])
