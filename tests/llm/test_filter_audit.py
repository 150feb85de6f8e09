"""The audit against filters that are applied one after the other, order by order."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from matchloom.llm import filter_audit

from .conftest import ODD


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 100, 10_001])
def test_carry_save_counts(n):
    words = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    words[: n // 3] = 0xFFFFFFFF
    assert filter_audit.positional_counts(words).tolist() == [int(((words >> b) & 1).sum()) for b in range(32)]


def brute(rows, labels):
    """rows: (doc_id, text, source); labels: doc_id -> (good, toxic)."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = []
    for i, t, _ in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        fails.append({x for x in f if f[x]})
    out, shapley = {}, Counter()
    for order in permutations("ABCDE"):
        alive = list(range(len(rows)))
        for step, x in enumerate(order, 1):
            gone = {k for k in alive if x in fails[k]}
            alive = [k for k in alive if k not in gone]
            for part in {r[2] or "" for r in rows}:
                mine = {k for k in range(len(rows)) if (rows[k][2] or "") == part}
                lost = gone & mine
                mark = lambda j: sum(labels.get(rows[k][0], (0, 0))[j] for k in lost)  # noqa: B023, E731
                redundant = sum(x in fails[k] for k in mine) - len(lost) - sum(x in fails[k] for k in mine & set(alive))
                out[part, "".join(order), step] = [sum(k in mine for k in alive), len(lost), redundant, sum(fails[k] == {x} for k in mine), mark(0), mark(1)]
                shapley[part, x] += len(lost)
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def frame(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, source string, part string, fails string")
    return docs, spark.createDataFrame([(i, *v, "c") for i, v in labels], "doc_id long, quality int, toxic int, good string")


def audited(spark, rows, labels):
    return {tuple(r) for r in filter_audit.audit(*frame(spark, rows, labels)).collect()}


def test_all_orders(spark):
    rng = random.Random(1)
    base = ["word " * 250, " ".join(f"w{i}" for i in range(250)), " ".join(f"W{i}" for i in range(220)), "short", "short # one", "", "A B C", " ".join(f"u{i}" for i in range(300)) + " 100%"]
    rows = [(i, rng.choice(base), rng.choice(["x", "x", "y", "", None])) for i in range(120)]
    labels = [(i, (rng.randint(0, 1), rng.randint(0, 1))) for i in range(0, 120, 2)]
    assert audited(spark, rows, labels) == brute(rows, dict(labels))


def test_odd_input(spark, odd, empty):
    rows = [(i, t, "src1") for i, t in ODD]
    labels = [(6, (1, 0)), (6, (0, 1)), (None, (1, 1)), (10, (None, 1)), (99, (1, 1))]
    assert audited(spark, rows, labels) == brute(rows, {6: (1, 1), 10: (0, 1)})
    _, marks = frame(spark, rows, labels)
    assert {tuple(r) for r in filter_audit.audit(odd, marks).collect()} == brute(rows, {6: (1, 1), 10: (0, 1)})
    assert filter_audit.audit(empty, marks).count() == 0 and filter_audit.audit(odd, marks.limit(0)).count() == 600


def test_many_parts_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "GROUPS", 3)
    rows = [(i, "a text", f"s{i % 11}") for i in range(60)]
    assert audited(spark, rows, []) == brute(rows, {})
