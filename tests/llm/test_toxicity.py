import math
import random
import zlib
from collections import Counter

import numpy as np

from matchloom.llm import toxicity as T


def corpus(n=300, seed=4):
    r = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(r.randint(5, 200))]
        toxic = i % 4 == 0
        if toxic:
            words[r.randrange(len(words))] = r.choice(["zunt", "krabb", "foxul"]) + r.choice(["", "er", "on"])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy_and_folds(spark, documents):
    rows = corpus(1500)
    docs = documents([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in T.classify(docs, labels).collect()}
    truth = {i: y for i, _, y in rows}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in truth)
    held = [i for i in truth if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == truth[i] for i in held) / len(held) >= 0.9
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got.values())
    # labels of the held-out third don't matter
    flipped = spark.createDataFrame([(i, 1 - y if got[i]["held_out"] else y) for i, _, y in rows], "doc_id long, toxic int")
    again = {r["doc_id"]: r["score"] for r in T.classify(docs, flipped).collect()}
    assert again == {i: r["score"] for i, r in got.items()}
    kept = {r["doc_id"] for r in T.drop_toxic(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if not r["predicted"]}


def plain_fit(texts, labels, share, alpha=1.0, l2=1.0, least=1.0, rounds=120):
    """The same model with a dictionary a text and a weight a column, one number at a time."""
    rows = [set(T.Features()(t).tolist()) for t in texts]
    counts = {y: Counter(c for r, z in zip(rows, labels, strict=True) if z == y for c in r) for y in (0, 1)}
    total = {y: alpha * 2**T.BITS + sum(counts[y].values()) for y in (0, 1)}
    ratio = {}
    for c in set().union(*rows):
        q, p = counts[0][c] + alpha, counts[1][c] + alpha
        x = math.log(p / total[1]) - math.log(q / total[0])
        if p + q >= 2 * alpha + 2 and abs(x) > least:
            ratio[c] = x
    w, m, s = ({c: 0.0 for c in ratio} for _ in range(3))
    b = mb = sb = 0.0
    n = len(rows)
    for t in range(1, rounds + 1):
        e = []
        for r, y in zip(rows, labels, strict=True):
            z = b + sum(w[c] * ratio[c] for c in r if c in ratio)
            e.append((1 / (1 + math.exp(-z)) - y) / n)
        g = {c: l2 * w[c] / n for c in ratio}
        for r, x in zip(rows, e, strict=True):
            for c in r:
                if c in ratio:
                    g[c] += x * ratio[c]
        for c in ratio:
            m[c], s[c] = 0.9 * m[c] + 0.1 * g[c], 0.999 * s[c] + 0.001 * g[c] ** 2
            w[c] -= 0.02 * (m[c] / (1 - 0.9**t)) / (math.sqrt(s[c] / (1 - 0.999**t)) + 1e-8)
        gb = sum(e)
        mb, sb = 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb**2
        b -= 0.02 * (mb / (1 - 0.9**t)) / (math.sqrt(sb / (1 - 0.999**t)) + 1e-8)
    drawn = sum(labels) / n
    return {c: w[c] * ratio[c] for c in ratio}, b + math.log(share / (1 - share)) - math.log(drawn / (1 - drawn))


def test_the_fit_is_the_plain_one():
    rows = corpus(80)
    texts, labels = [t for _, t, _ in rows], [y for _, _, y in rows]
    model = T.fit([T._packed(T.Features()(t)) for t in texts], np.array(labels), 0.1)
    weights, bias = plain_fit(texts, labels, 0.1)
    assert abs(model.bias - bias) < 1e-6
    assert set(np.flatnonzero(model.weights).tolist()) <= set(weights)
    assert max(abs(model.weights[c] - x) for c, x in weights.items()) < 1e-5


def test_the_sample_does_not_depend_on_order_or_repeats(spark, documents):
    rows = corpus(200)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    once = documents([(i, t) for i, t, _ in rows])
    again = documents([(i, t) for i, t, _ in reversed(rows)] + [(i, t) for i, t, _ in rows[:50]] * 3).repartition(7)
    a, b = T.train(once, labels, 40), T.train(again, labels, 40)
    assert a.bias == b.bias
    assert np.array_equal(a.weights, b.weights)


def test_ngrams_are_of_characters():
    f = T.Features()
    assert len(f("é")) == 1  # " é " is one run of three
    assert len(f("漢字")) == len({" 漢字", "漢字 ", " 漢字 "})


def test_odd_input(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    rows = T.classify(odd, labels).collect()
    assert len(rows) == odd.count()
    assert len({r["score"] for r in rows if r["doc_id"] == 6}) == 1
    assert T.classify(empty, labels).count() == 0
    none = T.classify(odd, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0}
    assert T.drop_toxic(odd, labels.limit(0)).columns == odd.columns


def test_features_are_the_distinct_ngrams():
    f = T.Features()
    assert len(f("ab")) == len({" ab", "ab ", " ab "})
    assert np.array_equal(f("A  b\nc"), f("a b c"))
    assert np.array_equal(T._unpacked(T._packed(f("some text"))), f("some text"))
    assert len(f("")) == len(f(None)) == 0
