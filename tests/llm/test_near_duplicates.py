import random

from .conftest import ODD

from matchloom.llm import near_duplicates as N


def sets(t, k):
    w = (t or "").encode().lower().split()
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, percent):
    rows = [(i, sets(t, k)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in enumerate(rows):
        for y in rows[:a]:
            if x[1] and y[1] and 100 * len(x[1] & y[1]) >= percent * len(x[1] | y[1]):
                p, q = find(x[0]), find(y[0])
                root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in rows}


def corpus(groups=6, seed=8):
    """Groups around a text, from near to at and beyond the threshold, so that links form chains."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows = []
    for g in range(groups):
        origin = [word() for _ in range(r.randint(40, 150))]
        for _ in range(60 if g == 0 else 8):
            words = list(origin)
            for _ in range(r.randint(0, len(words) // 12)):
                words[r.randrange(len(words))] = word()
            rows.append(" ".join(words))
    rows += [" ".join(word() for _ in range(60)) for _ in range(30)] + rows[:5]
    r.shuffle(rows)
    return list(enumerate(rows))


def results(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_components_are_whole(documents, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)  # so that buckets have several blocks
    rows = corpus()
    got = N.near_duplicates(documents(rows), k=3, percent=85)
    assert results(got) == brute(rows, 3, 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_stage_keeps_one_of_each_component(documents):
    rows = corpus(3)
    expected = brute(rows, 5, 80)
    docs = documents(rows, clashes=True)
    out = N.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == {i for i, (_, c) in expected.items() if c == i}


def test_stage_finds_a_pair_at_the_threshold_that_25_bands_miss(documents):
    words = [f"w15807x{i}" for i in range(54)]  # 40 of 50 shingles; found by trial
    docs = documents([(1, " ".join(words[:44])), (2, " ".join(words))])
    assert all(r["kept"] for r in N.near_duplicates(docs, k=5, percent=80).collect())
    assert [r["doc_id"] for r in N.drop_near_duplicates(docs).collect()] == [1]


def test_stage_keeps_rows_repeated_with_one_id_once(documents):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "another text under one id"), (2, None), (2, None), (3, "g h i j k l m"), (None, "no id"), (None, "no id")]
    docs = documents(rows, clashes=True)
    out = N.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted([*set(rows), (None, "no id")], key=str)


def test_odd_input(odd, empty):
    got = N.near_duplicates(odd, k=3, percent=85).collect()
    assert len(got) == len(ODD)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[0] == by[1] == by[2] or [x[0][0] for x in (by[0], by[1], by[2])] == [0, 0, 0]
    assert [by[i][0][1:] for i in (0, 1, 2, 3)] == [(i, True) for i in (0, 1, 2, 3)]
    assert by[6] == [(2, 6, True)] * 2
    assert by[7] == [(2, 6, False)]
    assert all(c is None and kept for _, c, kept in by[None])
    assert by[5][0][0] == 5
    assert N.near_duplicates(empty).count() == 0


def test_estimates_and_sets():
    a, b = N.shingle_set("a b c d", 3), N.shingle_set("A b C D", 3)
    assert len(a) == 2
    assert a.tolist() == b.tolist()
    assert len(N.shingle_set("a b", 3)) == 1
    assert N.shingle_set("a b", 3).tolist() != N.shingle_set("b a", 3).tolist()
    assert len(N.shingle_set(" \n", 3)) == len(N.shingle_set(None, 3)) == 0
    assert N._linked(N.shingle_set("a b c", 3), N.shingle_set("a b c", 3), 100)
