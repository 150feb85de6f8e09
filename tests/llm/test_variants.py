"""Spelling variants against brute force."""

import random
import re
from collections import Counter
from zlib import crc32

import pytest

from matchloom.llm import variants

from .conftest import ODD


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            total[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in total.items() if len(w) >= 5 and c >= 3}
    form, near = {}, {}
    for w in n:
        others = [x for x in n if one_edit(w, x)]
        near[w] = len(others)
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], near[w], n.get(form[w])) for w in n}


def found(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def texts(seed):
    """Words of few letters, so many are near each other and many share a chunk; some are long, and some stand in a chain of forms."""
    rng = random.Random(seed)
    stems = ["".join(rng.choices("abé÷", k=rng.randint(4, 7))) for _ in range(40)] + ["prefix" + x + y for x in "abcdefg" for y in "abcdefg"] + ["x" * 3000, "x" * 2999 + "y", "x" * 2999]
    chain = [("aaaaaaaa"[:i] + "b" * (8 - i), 3 << i) for i in range(6)]
    words = [w for w, k in chain for _ in range(k)] + rng.choices(stems, k=3000) + stems * 3
    rng.shuffle(words)
    return [(i, " ".join(w.upper() if rng.random() < 0.1 and "é" not in w else w for w in words[i::50])) for i in range(50)]


@pytest.mark.parametrize("crowd", [0, 3, 64])
def test_words_forms_and_roots(spark, documents, monkeypatch, crowd):
    monkeypatch.setattr(variants, "CROWD", crowd)
    rows = texts(crowd)
    assert found(variants.spelling_variants(documents(rows))) == brute(rows)


@pytest.mark.parametrize("crowd", [0, 64])
def test_every_single_edit_meets(spark, monkeypatch, crowd):
    """Each place of a word, each kind of edit, short and long words, repeated letters."""
    monkeypatch.setattr(variants, "CROWD", crowd)
    stems = ["abcde", "aaaaa", "abcdefghij", "abababab", "àéîõüç", "zzzzzzzzzzzzz"]
    words = {s for w in stems for i in range(len(w) + 1) for s in (w, w[:i] + "a" + w[i:], w[:i] + "q" + w[i:], w[:i] + w[i + 1 :], w[:i] + "q" + w[i + 1 :])}
    words = sorted(words)
    pairs = variants.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    assert {frozenset(p) for p in pairs} == {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}
    assert len(pairs) == len({frozenset(p) for p in pairs})


def test_crowds_make_few_candidates(spark, monkeypatch):
    """A third and more of the words share a chunk: what meets grows with them, not with their square."""
    rng = random.Random(5)
    words = sorted({"aaaaaa" + "".join(rng.choices("bcdefghij", k=6)) for _ in range(4000)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    pairs = {frozenset(p) for p in variants.near_pairs(df).collect()}
    by = {}
    for w in words:
        for i in range(6, 12):
            by.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
    assert pairs == {frozenset((a, b)) for ws in by.values() for a in ws for b in ws if a < b}


def test_odd_input(spark, odd, empty):
    got = found(variants.spelling_variants(odd))
    assert got == brute(ODD)
    assert variants.spelling_variants(empty).count() == 0


def test_runs_lose_a_code_point_by_checksum():
    runs = [f"{'wörd' * 3}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(600)]
    hit = [r for r in runs if crc32(f"7:{r}".encode()) % 97 == 0]
    assert hit
    for r in runs:
        assert len(variants.damaged(7, r)) == len(r) - (r in hit)
