import random

import pytest
from conftest import pairs_of
from pyspark.sql import functions as F

from matchloom.operators import lsh, matching, progressive, simjoin
from matchloom.operators.ranking import neighbours, top_k, with_position


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def strings():
    r = random.Random(5)
    out = ["".join(r.choice("ab") for _ in range(r.randint(1, 7))) for _ in range(40)]
    out += ["".join(r.choice("abc") for _ in range(r.randint(10, 15))) for _ in range(30)]
    return out + [s[:3] + "x" + s[4:] for s in out[40:60]] + out[:5] + out[45:48]


@pytest.mark.parametrize("d", [1, 2])
def test_edit_joins_find_all_pairs(spark, strings, d):
    docs = spark.createDataFrame(list(enumerate(strings)), "id long, text string")
    expected = {(i, j) for i, a in enumerate(strings) for j, b in enumerate(strings) if i < j and distance(a, b) <= d}
    assert pairs_of(simjoin.edit_join(docs, 2, d)) == expected
    assert pairs_of(simjoin.deletion_join(docs, d)) == expected
    assert pairs_of(simjoin.segment_join(docs, d)) == expected


def test_grams_out_of_place_spare_distances(spark):
    """Texts of the same pieces in another order share their grams, but not at their places: fewer distances are computed, none too few."""
    r = random.Random(2)
    pieces = ["".join(r.choice("abcd") for _ in range(4)) for _ in range(5)]
    texts = sorted({"".join(r.sample(pieces, 5)) for _ in range(60)} | {"".join(pieces[:4]) + x for x in ("q", "qq", "abcd")})
    reps = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    plain, placed = (pairs_of(simjoin.edit_candidates(reps, 2, 2, by_place=p)) for p in (False, True))
    near = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and distance(a, b) <= 2}
    assert near <= placed <= plain
    assert len(placed) < len(plain) / 2


@pytest.mark.parametrize("d", [0, 1, 3])
def test_segments_of_long_and_short_strings(spark, d):
    """Strings of 200 characters with edits at their ends and in their middle, beside very short and empty ones; keys stay few."""
    r = random.Random(d)
    texts = ["", "a", "b", "ab", "ba", "abc", None, "é漢", "é漢🙂"]
    for _ in range(12):
        base = [r.choice("abcdé") for _ in range(200)]
        texts.append("".join(base))
        for k in range(1, 6):
            t = list(base)
            for _ in range(k):
                i = r.choice([0, len(t) - 1, r.randrange(len(t))])
                t[i : i + 1] = r.choice([[], ["x"], [t[i], "y"]])
            texts.append("".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    expected = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and a is not None and b is not None and abs(len(a) - len(b)) <= d and distance(a, b) <= d}
    assert pairs_of(simjoin.segment_join(docs, d)) == expected
    sizes = docs.where("text is not null").select(F.size(simjoin.segment_keys(F.col("text"), d)).alias("a"), F.size(simjoin.probe_keys(F.col("text"), d)).alias("b")).agg(F.max("a"), F.max("b")).first()
    assert sizes[0] == d + 1 and sizes[1] <= (d + 1) ** 2 * (2 * d + 1)


def test_conjunction_takes_candidates_from_the_rarer_column(spark, monkeypatch):
    r = random.Random(3)
    names = ["".join(r.choice("ab") for _ in range(r.randint(6, 9))) for _ in range(60)]
    rows = [(i, r.choice(names), r.choice(["red", "rad", "blue", None])) for i in range(160)]
    docs = spark.createDataFrame(rows, "id long, name string, brand string")
    near = lambda x, y: None not in (*x[1:], *y[1:]) and distance(x[1], y[1]) <= 1 and distance(x[2], y[2]) <= 1
    expected = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and near(x, y)}
    used = []
    probe = simjoin.probe_keys
    monkeypatch.setattr(simjoin, "probe_keys", lambda c, d: used.append(c._jc.toString()) or probe(c, d))
    pairs, members = simjoin.conjunction_join(docs, {"brand": 1, "name": 1})
    assert used[-1] == "name"
    least = {}
    for i, n, b in rows:
        least.setdefault((n, b), i)
    reps = {i for i in least.values()}
    found = [(x["id1"], x["id2"]) for x in pairs.collect()]
    assert len(found) == len(set(found))  # a pair is made once
    assert set(found) == {(a, b) for a, b in expected if a in reps and b in reps}
    assert {(x["id"], x["rep"]) for x in members.collect()} == {(i, least[n, b]) for i, n, b in rows}


@pytest.mark.parametrize("t", [0.3, 0.5, 0.8, 1.0])
def test_jaccard_join(spark, t):
    r = random.Random(7)
    texts = [" ".join(r.choice("abcdefghij") for _ in range(r.randint(1, 9))) for _ in range(70)] + ["", "a b", "b a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = [set(x.split()) for x in texts]
    expected = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a and b and len(a & b) / len(a | b) >= t}
    assert pairs_of(simjoin.jaccard_join(docs, t)) == expected
    pairs, members = simjoin.jaccard_join(docs, t, expanded=False)
    assert pairs_of(simjoin.expand(pairs.select("id1", "id2"), members)) == expected


def test_join_of_sources(spark):
    docs = spark.createDataFrame([(0, 0, "a b"), (1, 0, "a b"), (2, 1, "a b c")], "id long, source_id int, text string")
    assert pairs_of(simjoin.jaccard_join_sources(docs, 0.6)) == {(0, 2), (1, 2)}


def test_on_all(spark):
    a = spark.createDataFrame([(0, 1), (0, 2)], "id1 long, id2 long")
    assert pairs_of(simjoin.on_all(a, a.limit(0).union(a.where("id2 = 2")))) == {(0, 2)}


def test_scores(spark, profiles):
    p = profiles({0: (0, {"a": "x x y"}), 1: (1, {"b": "x z"}), 2: (1, {"b": ""})})
    pairs = spark.createDataFrame([(0, 1)], "id1 long, id2 long")
    s = {how: matching.score(pairs, p, how).first()["score"] for how in matching.SCORES}
    assert s["jaccard"] == pytest.approx(1 / 3)
    assert s["enhanced_jaccard"] == pytest.approx(1 / 3)
    assert s["generalised_jaccard"] == pytest.approx(0.5 / 1.5)
    assert s["cosine"] == pytest.approx(2 / (5**0.5 * 2**0.5))
    assert s["character_cosine"] == pytest.approx(0.0)
    assert matching.score(spark.createDataFrame([(0, 2)], "id1 long, id2 long"), p).count() == 0
    assert matching.score(spark.createDataFrame([(0, 2)], "id1 long, id2 long"), p, "character_cosine").count() == 0
    assert matching.match(pairs, p, min_weight=0.5).count() == 0


def test_group_linkage(spark, profiles):
    p = profiles({0: (0, {"a": "x y", "b": "z"}), 1: (1, {"c": "x y", "d": "q"}), 2: (1, {"c": "nothing"})})
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "id1 long, id2 long")
    assert {r["id2"]: r["score"] for r in matching.group_linkage(pairs, p).collect()} == {1: pytest.approx(1 / 3), 2: -1.0}


def test_group_linkage_against_a_plain_loop(spark, profiles):
    r = random.Random(9)
    values = lambda: {f"k{i}": " ".join(r.choice("abcdef") for _ in range(r.randint(0, 4))) for i in range(r.randint(1, 5))}
    rows = {i: (0, values()) for i in range(14)}
    pairs = spark.createDataFrame([(a, b) for a in rows for b in rows if a < b], "id1 long, id2 long")
    got = {(x["id1"], x["id2"]): x["score"] for x in matching.group_linkage(pairs, profiles(rows), 0.3).collect()}
    for (a, b), score in got.items():
        x, y = (list(rows[i][1].items()) for i in (a, b))
        edges = []
        for i, (k, v) in enumerate(x):
            for j, (m, w) in enumerate(y):
                s, t = set(v.split()), set(w.split())
                if s and t and len(s & t) / len(s | t) > 0.3:
                    edges.append((-len(s & t) / len(s | t), k, m, i, j))
        used1, used2, total = set(), set(), 0.0
        for e in sorted(edges):
            if e[3] not in used1 and e[4] not in used2:
                used1.add(e[3])
                used2.add(e[4])
                total -= e[0]
        assert score == pytest.approx(total / (len(x) + len(y) - len(used1)) if used1 else -1.0)


def test_positions(spark):
    r = random.Random(1)
    rows = [(r.randint(0, 5), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, id long").repartition(7)
    got = {x["id"]: x["position"] for x in with_position(df, ["k", "id"]).collect()}
    assert got == {i: n for n, (_, i) in enumerate(sorted(rows))}
    assert with_position(df.limit(0), ["k", "id"]).count() == 0
    assert {x["id"] for x in top_k(df, 3, ["k", "id"]).collect()} == {i for _, i in sorted(rows)[:3]}


def test_progressive(profiles):
    p = profiles({0: (0, {"n": "a b"}), 1: (1, {"n": "a b"}), 2: (1, {"n": "c"})})
    # order: a0 a1 b0 b1 c2
    local = {(r["w"], r["id1"], r["id2"]): r["weight"] for r in progressive.local_ranking(p, 2).collect()}
    assert local == {(1, 0, 1): pytest.approx(3 / 1), (1, 1, 2): pytest.approx(1 / 2), (2, 0, 2): pytest.approx(1 / 2)}
    ranked = progressive.global_ranking(p, 1)
    assert list(progressive.comparisons(ranked)) == [(0, 1, 3.0), (1, 2, 0.5)]
    assert {(r["id1"], r["id2"]) for r in progressive.global_ranking(p, 2, clean=True).collect()} == {(0, 1), (0, 2)}


@pytest.mark.parametrize("clean", [False, True])
def test_steps_are_handed_out_lazily_and_resumed(profiles, clean):
    r = random.Random(6)
    p = profiles({i: (i % 2, {"n": " ".join(r.choice("abcdefgh") for _ in range(4))}) for i in range(12)})
    whole = sorted((x["w"], -x["weight"], x["id1"], x["id2"]) for x in progressive.local_ranking(p, 3, clean).collect())
    steps = progressive.Steps(p, 3, clean)
    got, at = [], iter(steps())
    for _ in range(3):
        got.append(next(at))
    assert steps.ranked == [1]  # nothing was computed for distance 2
    as_row = lambda c: (c.w, -c.weight, c.id1, c.id2)
    assert [as_row(c) for c in got] == whole[:3]
    for k in (0, 2, len(whole) // 2, len(whole) - 1):
        w, weight, a, b = whole[k]
        later = progressive.Steps(p, 3, clean)
        assert [as_row(c) for c in later(progressive.Cursor(w, -weight, a, b))] == whole[k + 1 :]
        assert min(later.ranked) == w


def test_bands_are_tuned_to_pairs(spark):
    rows = {x["bands"]: x for x in lsh.tuned_bands(spark.createDataFrame([(0.5,), (0.9,), (0.9,)], "similarity double"), 12, 0.9).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 6, 12] and all(b * x["rows"] == 12 and x["n_pairs"] == 3 for b, x in rows.items())
    for b, x in rows.items():
        assert x["recall"] == pytest.approx(sum(1 - (1 - s ** (12 // b)) ** b for s in (0.5, 0.9, 0.9)) / 3)
    assert [b for b, x in rows.items() if x["chosen"]] == [min(b for b, x in rows.items() if x["recall"] >= 0.9)]


def test_numbered_names_meet_without_characters(spark, monkeypatch):
    """Names that differ in a number have no rare q-gram: no candidate is made on one. Few names of rare q-grams still are."""
    used = []
    by_grams = simjoin.edit_candidates
    monkeypatch.setattr(simjoin, "edit_candidates", lambda *a, **k: used.append(a) or by_grams(*a, **k))
    names = [f"supplier#{i:06d}" for i in range(0, 6000, 3)] + ["", "s", "supplier#000000"]
    docs = spark.createDataFrame(list(enumerate(names)), "id long, text string")
    keys = {}
    for i, x in enumerate(names):
        for k in range(len(x)):
            keys.setdefault((len(x), k, x[:k] + x[k + 1 :]), []).append(i)
    replaced = {(i, j) for v in keys.values() for i in v for j in v if i < j}
    copies = {(0, 2002), (2000, 2001)}
    found = pairs_of(simjoin.edit_join(docs, 2, 1))
    assert not used
    assert found == replaced | copies
    few = spark.createDataFrame([(0, "abcdefghijklmnop"), (1, "abcdefgxijklmnop"), (2, "0123456789")], "id long, text string")
    assert pairs_of(simjoin.edit_join(few, 2, 1)) == {(0, 1)}
    assert used


@pytest.mark.parametrize("n", [1, 2, 4])
@pytest.mark.parametrize("rows", [0, 3, 40])
def test_neighbours_go_on_in_the_next_ranges(spark, n, rows):
    """Ranges of few rows, shorter than a window, and one task's batches shorter than it, too."""
    data = [(f"k{i * 7 % 11:02}", i, i % 2) for i in range(rows)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for k, v in zip(old, ("16", "false", "2"), strict=True):
            spark.conf.set(k, v)
        got = {r["position"]: r for r in neighbours(spark.createDataFrame(data, "k string, id long, s int"), ["k", "id"], ["id", "s"], n).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = sorted(data)
    assert sorted(got) == list(range(rows))
    for p, r in got.items():
        near = [want[p + k][1:] if p + k < rows else (None, None) for k in range(n)]
        assert [(r[f"id_{k}"], r[f"s_{k}"]) for k in range(n)] == near


def test_character_cosine_makes_no_row_for_a_term(profiles):
    """Held against brute force; a pair is one row, whatever its profiles have in common."""
    from collections import Counter

    texts = {0: "abc abd abc", 1: "bca dab", 2: "x", 3: "x", 4: "zz9 zz9 zzz"}
    p = profiles({i: (0, {"a": t}) for i, t in texts.items()})
    joined = {i: "".join(dict.fromkeys(t.split())) for i, t in texts.items()}
    bag = {i: Counter([t[k : k + 2] for k in range(len(t) - 1)] or [t]) for i, t in joined.items()}
    size = lambda c: sum(n * n for n in c.values())
    pairs = p.sparkSession.createDataFrame([(i, j) for i in texts for j in texts if i < j], "id1 long, id2 long")
    scored = matching.score(pairs, p, "character_cosine")
    got = {(r["id1"], r["id2"]): r["score"] for r in scored.collect()}
    assert len(got) == 10
    for (i, j), x in got.items():
        assert x == pytest.approx(sum(bag[i][t] * bag[j][t] for t in bag[i]) / (size(bag[i]) * size(bag[j])) ** 0.5)
    assert "Generate" not in scored._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["jaccard", "enhanced_jaccard", "generalised_jaccard", "cosine"])
def test_scores_make_no_row_for_a_term(profiles, how):
    """Held against brute force; a pair is one row, whatever its profiles have in common."""
    from collections import Counter

    texts = {0: "a b b c", 1: "b b a d d d", 2: "x", 3: "x x", 4: "A-b_c c c " + "w" * 40, 5: "\u00e4 ...", 6: "w" * 40 + " b"}
    words = {i: Counter(w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split()) for i, t in texts.items()}
    p = profiles({i: (0, {"a": t}) for i, t in texts.items()})
    pairs = p.sparkSession.createDataFrame([(i, j) for i in texts for j in texts if i < j], "id1 long, id2 long")
    scored = matching.score(pairs, p, how)
    got = {(r["id1"], r["id2"]): r["score"] for r in scored.collect()}
    assert set(got) == {(i, j) for i in texts for j in texts if i < j and 5 not in (i, j)}
    for (i, j), x in got.items():
        a, b = words[i], words[j]
        both, low, t, u = len(a.keys() & b.keys()), (a & b).total(), a.total(), b.total()
        shares = sum(min(a[w] / t, b[w] / u) for w in a)
        squares = sum(n * n for n in a.values()) * sum(n * n for n in b.values())
        want = {"jaccard": both / (len(a) + len(b) - both), "enhanced_jaccard": low / (len(a) + len(b) - low), "generalised_jaccard": shares / (2 - shares), "cosine": sum(a[w] * b[w] for w in a) / squares**0.5}
        assert x == pytest.approx(want[how])
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "array_intersect" not in plan


@pytest.mark.parametrize("clean", [False, True])
def test_packed_pairs_are_those_of_rows(spark, profiles, monkeypatch, clean):
    """the global ranking against counts over the order, with parts of few pairs, large and negative ids, and profiles without tokens."""
    monkeypatch.setattr(progressive, "PAIRS", 16)
    r = random.Random(5)
    ids = [-(2**62), -7, 0, 3, 2**62, 2**62 + 1, *range(100, 130)]
    p = profiles({i: (k % 2, {"n": " ".join(r.choice("abcdefghij") for _ in range(k % 9))}) for k, i in enumerate(ids)})
    words = {row["id"]: (row["source_id"], {t for a in row["attributes"] for t in a["value"].split()}) for row in p.collect()}
    order = [i for _, i in sorted((t, i) for i, (_, ts) in words.items() for t in ts)]
    freq = {}
    for w in (1, 2, 3):
        for a, b in zip(order, order[w:], strict=False):
            if a != b and not (clean and words[a][0] == words[b][0]):
                freq[min(a, b), max(a, b)] = freq.get((min(a, b), max(a, b)), 0) + 1
    want = {(a, b): f / (len(words[a][1]) + len(words[b][1]) - f) if len(words[a][1]) + len(words[b][1]) != f else None for (a, b), f in freq.items()}
    rows = progressive.global_ranking(p, 3, clean).collect()
    assert len(rows) == len(want)
    assert {(x["id1"], x["id2"]): x["weight"] for x in rows} == want
