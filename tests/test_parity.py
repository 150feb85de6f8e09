import random

import numpy as np
import pandas as pd
import pytest
from conftest import pairs_of
from pyspark.sql import functions as F

from matchloom.operators import parity, simjoin


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def uneven():
    """Sets of 1 to 3,000 words, from few words that stand in many of them, with near copies of each size."""
    r = random.Random(11)
    out = []
    for n in [1, 2, 3, 5, 8, 20, 21, 60, 200, 700, 3000]:
        for _ in range(4):
            base = {f"w{int(r.paretovariate(0.6)) % (4 * n)}" for _ in range(2 * n)}
            out.append(base)
            for cut in (0.1, 0.3, 0.5):
                out.append({w if r.random() > cut else w + "x" for w in base})
    return [s for i, s in enumerate(out) if s not in out[:i]]


@pytest.mark.parametrize("t", [0.3, 0.5, 0.8, 1.0])
def test_blocks_of_any_size_find_all_pairs(spark, uneven, t):
    sets = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(uneven)], "id long, tokens array<string>")
    expected = {(i, j) for i, a in enumerate(uneven) for j, b in enumerate(uneven) if i < j and jaccard(a, b) >= t}
    rows = parity.candidates(sets, t, block=7).collect()
    made = [(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in rows]
    assert len(made) == len(set(made))
    assert expected <= set(made)
    found = {(r["id1"], r["id2"]): r["similarity"] for r in simjoin.set_join(sets, t).collect()}
    assert found == {(i, j): jaccard(uneven[i], uneven[j]) for i, j in expected}


def test_frequent_words_make_no_rows(spark):
    """Documents of the same frequent words in other choices: what goes on is what is similar, not what shares a word."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(r.sample(words, 60)) for _ in range(300)]
    texts += [t + " more" for t in texts[:10]]
    sets = simjoin.token_sets(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    assert parity.candidates(sets, 0.8).count() == 10
    assert parity.candidates(sets, 0.5).count() < 100
    assert pairs_of(simjoin.set_join(sets, 0.8)) == {(i, 300 + i) for i in range(10)}


def test_sketches_fold(spark):
    hashes = np.random.default_rng(1).integers(-(2**63), 2**63, 1000)
    wide, narrow = parity.sketch(hashes, 4), parity.sketch(hashes[:250], 4)
    assert (len(wide), len(narrow)) == (4096 // 8, 1024 // 8)
    differ = np.bitwise_count(parity.folded([wide], 16) ^ parity.folded([narrow], 16)).sum()
    assert 300 < differ <= 750
    assert (parity.folded([wide], 16) == parity.folded([parity.sketch(hashes, 1)], 16)).all()


def test_blocks_stay_as_many_while_the_table_grows(spark, monkeypatch):
    """How often a sketch is shuffled goes with the number of blocks, so more parts make larger blocks, until their sketches have ``BYTES``."""
    monkeypatch.setattr(parity, "PART", 64)

    def blocks(rows):
        table = spark.range(rows).select(F.col("id").alias("position"), "id", (10 + F.col("id") * 1000 / rows).cast("int").alias("n"), F.unhex(F.repeat(F.lit("0"), 64)).alias("sketch"))
        found = parity.dealt(table, 0.5).groupBy("block").agg(F.count("*").alias("c"), F.min("position").alias("p"), F.first("first").alias("first"), F.first("last").alias("last")).sort("block").collect()
        assert [r["block"] for r in found] == list(range(len(found)))
        assert sum(r["c"] for r in found) == rows and [r["p"] for r in found] == sorted(r["p"] for r in found)
        assert all(r["first"] <= r["block"] <= r["last"] < len(found) for r in found)
        return [r["c"] for r in found]

    assert len(blocks(16_384)) <= 17 and len(blocks(65_536)) <= 17
    monkeypatch.setattr(parity, "BYTES", (32 + parity.ROW) * 512)
    assert max(blocks(65_536)) <= 512 + 64


def test_no_set_is_shuffled_before_its_pairs_are_known(spark, monkeypatch):
    """With copies, and joins that shuffle: candidates read sketches only, and full sets go on packed."""
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghij") for _ in range(8)) for _ in range(300)]
    texts = [" ".join(r.sample(words, 40)) for _ in range(60)]
    texts += [t + " more" for t in texts[:20]] + texts[:30] + ["", None, "...", "a", "A"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    written, cut = {}, simjoin.cut
    try:
        monkeypatch.setattr(simjoin, "cut", lambda df, tag="cut": written.setdefault(tag, (df, cut(df, tag)))[1])
        pairs, members = simjoin.jaccard_join(docs, 0.8, expanded=False)
        assert "packed" not in written["candidates"][0]._jdf.queryExecution().optimizedPlan().toString()
        assert not any("tokens" in df._jdf.queryExecution().optimizedPlan().toString() for tag, (df, _) in [*written.items(), ("pairs", (pairs, None)), ("members", (members, None))] if tag != "sets")
        assert pairs_of(pairs) == {(i, 60 + i) for i in range(20)}
        assert pairs_of(members, "id", "rep") == {(i, i) for i in range(80)} | {(80 + i, i) for i in range(30)} | {(113, 113), (114, 113)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("t", [0.2, 0.5, 0.8])
def test_few_words_of_a_sketch_rule_out_most_pairs(monkeypatch, t):
    """What is found is what whole sketches allow, and whole sketches are looked at for few of the pairs where sets are unlike."""
    rng, rows = np.random.default_rng(2), []
    for i in range(700):
        n = int(rng.integers(3, 900)) if i % 3 else 200
        base = rng.integers(0, 2**62, n)
        if i % 7 == 0 and rows:
            base = np.concatenate([rows[-1][1][: len(rows[-1][1]) * 9 // 10], base[: n // 20]])
        rows.append((len(base), base))
    rows.sort(key=lambda x: x[0])
    table = pd.DataFrame({"position": range(700), "id": range(700), "n": [n for n, _ in rows], "sketch": [parity.sketch(h, parity.bits_an_item(t)) for _, h in rows]})
    looked, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x, **k: (k or looked.append(len(x))) and None or count(x, **k))
    found = {(x.a, x.b) for x in parity.near(table, table, t).itertuples()}
    want = set()
    for i in range(700):
        for j in range(i + 1, 700):
            n, m, x, y = table["n"][i], table["n"][j], table["sketch"][i], table["sketch"][j]
            words = min(len(x), len(y)) // 8
            if m <= n / t + 1e-6 and count(parity.folded([x], words) ^ parity.folded([y], words)).sum() <= (n + m) * (1 - t) / (1 + t) + 1e-6:
                want.add((i, j))
    assert found == want
    if t > 0.2:
        assert sum(looked) < len(want) + 700 * 700 / 2 / 20
