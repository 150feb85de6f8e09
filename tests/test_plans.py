"""Queries against their own SQL, on small tables with odd rows."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from matchloom.functions import keys as K
from matchloom.plans.queries import six


@pytest.fixture
def same_as_sql(spark, tmp_path):
    """Holds a query against its SQL, rows counted, over tables given as {name: (rows, schema)}."""

    def check(name, **tables):
        con = duckdb.connect()
        for table, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        got = entry.queries()[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
        rows = [tuple(r) for r in got.collect()]
        assert sorted(rows) == sorted(want)
        return rows

    return check


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(*texts):
    return [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCUMENTS


def test_token_sets_leave_out_documents_without_tokens(same_as_sql):
    rows = same_as_sql("profile_token_sets", documents=documents("a b a", "", None, " .,! \n", "x"))
    assert sorted(rows) == [(0, 2), (4, 1)]


def test_halves_are_rounded_as_sql_does(spark):
    """Millionths that end in a half: doubles lie above or below it, and SQL's round goes by their product with a million."""
    values = [k / n for n in (64, 128, 320, 640, 1280, 3200, 6400) for k in range(1, 200)] + [-41 / 640, float("inf"), 1e12 + 0.5]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(six(F.col("x"))).collect()
    assert [r[0] for r in got] == [r[0] for r in duckdb.execute("SELECT round(unnest(?::DOUBLE[]), 6)", [values]).fetchall()]


def test_emission_ties_at_halves(same_as_sql):
    """A weight of 82 in 1280, which is 0.0640625: 40 tokens in common, 1282 apart."""
    texts = [" ".join([f"s{i:03d}" for i in range(40)] + [f"a{x}{i:03d}" for i in range(641)]) for x in (0, 1)]
    rows = same_as_sql("progressive_emission", documents=documents(*texts, "p q", "q r", ""))
    assert (0, 1, 0.064062) in {r[1:] for r in rows}


@pytest.mark.parametrize("method", ["unique_mapping", "center"])
def test_greedy_clusters_of_all_pairs_of_documents(same_as_sql, method):
    """Copies in ones, twos, threes and fours beside texts that are near some of them: what a representative alone would miss."""
    r = random.Random(6)
    texts = []
    for k in range(12):
        base = [f"k{k}w{i}" for i in range(12)]
        near = [" ".join(base[: 12 - r.randint(1, 5)] + [f"x{k}{j}{i}" for i in range(r.randint(0, 2))]) for j in range(4)]
        texts += [" ".join(base)] * (k % 4 + 1) + near + near[: k % 3] + near[:1] * (k % 2)
    r.shuffle(texts)
    rows = same_as_sql(f"cluster_{method}", documents=documents("a b c", "a b c", "a b c", "a b c d", *texts))
    if method == "unique_mapping":
        assert {(0, 0), (0, 1), (2, 2), (2, 3)} <= set(rows)  # the third copy and the text near it


@pytest.mark.parametrize("name, make", [("keys_ngrams", "windows"), ("keys_suffixes", "token_suffixes"), ("keys_substrings", "token_substrings"), ("keys_extended_qgrams", "token_extended_qgrams")])
def test_keys_are_made_once_a_token(same_as_sql, monkeypatch, name, make):
    """Keys are made of a column of different tokens, not inside the texts."""
    made = []
    own = getattr(K, make)
    monkeypatch.setattr(K, make, lambda t, *a: made.append(t._jc.toString()) or own(t, *a))
    texts = ["alpha beta alpha", "beta-beta ab a", None, "", "alphabetical order of abcabcabc"]
    same_as_sql(name, documents=documents(*texts * 3))
    assert "t" in made


def test_ground_truth_and_sources_shuffle_no_text(spark, tmp_path):
    """Equal texts meet by digest, texts without a value as one, as in SQL's partitions; a text has its source beside it without a join."""
    from matchloom.plans import queries as Q

    rows = [(1, "a b", "src0"), (2, None, "src1"), (3, "a b", "src1"), (4, None, "src0"), (5, "", "src0"), (6, "c", "src1")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in Q.copies(spark, str(tmp_path)).collect()} == {(1, 3), (2, 4)}
    texts = Q.source_texts(spark, str(tmp_path))
    assert {tuple(r) for r in texts.select("id", "source_id", "text").collect()} == {(1, 0, "a b"), (3, 1, "a b"), (6, 1, "c")}
    assert "Join" not in texts._jdf.queryExecution().optimizedPlan().toString()


def test_block_quality_counts_the_pairs_of_documents(same_as_sql):
    """candidates are pairs of documents in what purging leaves, those of equal ones too, not links of classes."""
    texts = [f"k{i % 9} m{i % 7} n{i} o{i // 2}" for i in range(40)] + ["copy of one", "copy of one", "copy of four", "copy of four", "copy of four", "copy of four", None, ""]
    rows = same_as_sql("block_quality", documents=documents(*texts))
    assert rows == same_as_sql("block_quality_documents", documents=documents(*texts))
    assert rows[0][2] != same_as_sql("block_quality_classes", documents=documents(*texts))[0][2]


def test_join_on_two_attributes_has_all_pairs_of_rows(same_as_sql):
    """F16: equal rows are pairs, and each of them is one with what is near; a row with a null is in none."""
    r = random.Random(16)
    rows = [(i, r.choice(["red ring", "red rind", "old bolt", None]), r.choice(["Brand#1", "brand#12", "Brand#34", None])) for i in range(60)]
    part = (rows, "p_partkey long, p_name string, p_brand string")
    found = same_as_sql("join_on_two_attributes", part=part)
    assert {(a, b) for a, b in found} > set(same_as_sql("join_on_two_attributes_classes", part=part))
    assert any(rows[a][1:] == rows[b][1:] for a, b in found)
    same_as_sql("join_on_two_attributes_members", part=part)


def test_emission_looks_up_no_numbers_and_keeps_no_windows(same_as_sql, spark, monkeypatch, tmp_path):
    """pairs bring their profiles' numbers of positions along, rows are dealt out by their own columns, and windows go once pairs are written."""
    from matchloom.operators import progressive, ranking
    from matchloom.plans import queries as Q

    plans = {}
    for module in (ranking, Q):
        monkeypatch.setattr(module, "cut", lambda df, tag="cut", *how, cut=module.cut: plans.setdefault(tag, [df, cut(df, tag, *how)])[1])
    r = random.Random(12)
    same_as_sql("progressive_emission", documents=documents(*[" ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 6))) for _ in range(40)], None))
    assert not any("Join" in line and "id1" in line for line in plans["ranking"][0]._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert plans["positions"][0].columns == ["id1", "id2", "weight", "_place"]
    assert "_o0" not in plans["positions"][0]._jdf.queryExecution().optimizedPlan().toString()
    assert not os.path.exists(plans["windows"][1]._matchloom_path.removeprefix("file:"))
    assert not hasattr(progressive, "_counts")
