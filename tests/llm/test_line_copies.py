"""Line dedup before near-duplicates: near copies reach the stage that drops them, passages go all the same."""

import random

from pyspark.sql import functions as F

from matchloom.llm import line_dedup, near_duplicates
from matchloom.storage import cut


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))}


def similar(a, b):
    x, y = shingles(a), shingles(b)
    return 100 * len(x & y) >= 80 * len(x | y)


def corpus(seed, originals=30, per_line=14):
    """Originals of many lines, near copies with a few words changed, exact copies, and passages that unrelated texts share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 8)))
    line = lambda: " ".join(word() for _ in range(rng.randint(per_line // 2, per_line)))
    texts, copies = {}, {}
    passages = [[line() for _ in range(7)] for _ in range(4)]
    for i in range(originals):
        lines = [line() for _ in range(rng.randint(12, 30))]
        if i % 5 == 0:
            at = rng.randint(0, len(lines))
            lines[at:at] = passages[i // 5 % 4]
        texts[10 * i] = "\n".join(lines)
        for k in range(1, 1 + i % 4):
            words = [ln.split() for ln in lines]
            for _ in range(rng.randint(0, sum(map(len, words)) // 60)):
                rng.choice(words)[0] = word()
            texts[10 * i + k] = "\n".join(map(" ".join, words))
            copies[10 * i + k] = 10 * i
    return texts, copies, ["\n".join(p) for p in passages]


def test_near_copies_reach_the_next_stage(documents):
    texts, copies, passages = corpus(3)
    near = {i for i, o in copies.items() if similar(texts[i], texts[o])}
    assert len(near) > 30
    lined = cut(line_dedup.drop_repeated_lines(documents(sorted(texts.items())), drop_emptied=True, copies=True), "test")
    after = {r["doc_id"]: r["text"] for r in lined.collect()}
    assert near <= set(after)
    kept = {r["doc_id"] for r in near_duplicates.drop_near_duplicates(lined).collect()}
    assert len(near & kept) <= len(near) // 20
    assert {i for i in texts if i % 10 == 0} <= kept  # clean documents stay
    held = [sum(p in after[i] for i in kept) for p in passages]
    assert held == [1] * len(passages)  # a passage stays where it stands first


def test_groups_are_those_of_brute_force(documents):
    texts, copies, _ = corpus(4)
    texts[9990] = texts[0] + "\n" + texts[10]  # holds another text, and is no copy of it
    texts[9991] = "a b c"
    texts[9992] = "a b c"
    docs = documents([*sorted(texts.items()), (0, texts[0]), (None, texts[0]), (3, None)])
    groups = {r["doc_id"]: (r["group"], r["spare"]) for r in line_dedup.copy_groups(docs, cut(line_dedup._chunks(docs, True).drop("chunk"), "chunks")).collect()}
    want = {i: (o, True) for i, o in copies.items() if similar(texts[i], texts[o])}
    want |= {o: (o, False) for o, _ in want.values()} | {9991: (9991, False), 9992: (9991, True)}
    assert groups == want


def test_shingles_are_those_of_words(documents):
    rows = [(0, None), (1, ""), (2, "One"), (3, "one two\tthree four FIVE six\nÉ é"), (4, " ".join("abcdefgh" * 40))]
    sets = {r["doc_id"]: r["s"] for r in documents(rows).where("text is not null").select("doc_id", line_dedup.shingles(F.col("text"), 5).alias("s")).collect()}
    assert {i: len(s) for i, s in sets.items()} == {1: 1, 2: 1, 3: 4, 4: 8}


def test_copies_on_odd_input(odd, empty):
    line_dedup.drop_repeated_lines(odd, copies=True).collect()
    assert line_dedup.drop_repeated_lines(empty, copies=True).count() == 0
