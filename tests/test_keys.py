import pytest
from pyspark.sql import functions as F

from matchloom.functions import keys as K


@pytest.fixture
def keys(profiles):
    def run(make, attributes):
        p = profiles({0: (0, attributes)})
        return p.select(make(F.col("attributes")).alias("k")).first()["k"]

    return run


NAMES = {"name": ["Tommy", "Joel"]}


@pytest.mark.parametrize(
    ("make", "expected"),
    [
        (K.tokens, ["tommy", "joel"]),
        (K.ngrams, ["tom", "omm", "mmy", "joe", "oel"]),
        (K.suffixes, ["tommy", "ommy", "mmy", "my", "joel", "oel", "el"]),
        (K.substrings, [t[i:j] for t in ("tommy", "joel") for n in range(2, len(t) + 1) for i, j in ((i, i + n) for i in range(len(t) - n + 1))]),
        (K.extended_qgrams, ["tomommmmy", "ommmmy", "tomomm", "tommmy", "joeoel", "joe", "oel"]),
    ],
)
def test_key_functions(keys, make, expected):
    assert sorted(keys(make, NAMES)) == sorted(expected)


def test_keyed_ngrams_take_whole_values(keys):
    assert sorted(keys(K.keyed_ngrams, {"name": "apple"})) == ["name_app", "name_ple", "name_ppl"]
    assert keys(K.keyed_ngrams, {"n": "a b"}) == ["n_a_b"]


def test_short_tokens_and_blank_values(keys):
    assert keys(K.ngrams, {"a": "xy", "b": " "}) == ["xy"]
    assert keys(K.suffixes, {"a": "x"}) == ["x"]
    assert keys(K.substrings, {"a": "x"}) == ["x"]
    assert keys(K.tokens, {"a": "--_-"}) == []


def test_good_words(spark):
    df = spark.createDataFrame([("A",), ("0",), ("花",), ("a1",), ("the",)], "t string")
    assert [r["t"] for r in df.where(K.is_good_word(F.col("t"))).collect()] == ["A", "0"]


def test_excluded_keys(profiles):
    p = profiles({0: (0, {"a": "x", "b": "y"})})
    assert p.select(K.tokens(F.col("attributes"), ["a"]).alias("k")).first()["k"] == ["y"]


def test_word_and_character_ngrams(profiles):
    p = profiles({0: (0, {"a": "ab cd", "b": "ab"})})
    row = p.select(K.word_ngrams(K.tokens(F.col("attributes")), 2).alias("w"), K.character_ngrams(F.col("attributes"), 2).alias("c")).first()
    assert row["w"] == ["ab cd", "cd ab"]
    assert row["c"] == ["ab", "bc", "cd"]
