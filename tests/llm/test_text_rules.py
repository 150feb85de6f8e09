"""PII, line dedup and the quality ledger."""

import hashlib
import random
import re
from collections import Counter

import pytest

from matchloom.llm import line_dedup, pii, quality

from .conftest import ODD

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TEXTS = [
    "x@y z@w.com", "a@b@c.com", "a@b.co_x@y.zz", "abc@x d@e.f.g", "1.2.3.4.5.6.7.8", "999.1.2.3 1.02.003.255", "4111 1111-1111 1111 and 4111111111111111 5500 0000 0000 0004 1", "+1 (415) 555-2671 +49 30 1234567.",
    "+1((((((((((((5", "é漢🙂 a@b.cd 漢", "a" * 50_000, "1" * 30_000, "1 " * 20_000, "+1" * 5000, "a@" * 5000, "." * 30_000 + "@", "4111111111111111 4111111111111111", "12.12.12.12.12", "x.@-.-", "10.0.0.1:80 +12.34.56.78.90",
]


def luhn(d):
    return sum((lambda v: v - 9 if v > 9 else v)(int(c) * (1 + i % 2)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(t):
    out = []
    for k, (name, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t or ""):
            v, d = m.group(), re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": name == "ip" and all(int(x) <= 255 for x in v.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[name]:
                out.append((m.start(), k, m.end(), name))
    return ",".join(f"{n}:{s}:{e}" for s, _, e, n in sorted(out))


def test_base_spans(documents, odd, empty):
    rows = [*ODD, *enumerate(TEXTS, 100)]
    got = Counter((r["doc_id"], r["base_sha256"]) for r in pii.digest(odd.select("doc_id", "text").union(documents(TEXTS_ROWS).select("doc_id", "text"))).collect())
    assert got == Counter((i, hashlib.sha256(base(t).encode()).hexdigest()) for i, t in rows)
    assert pii.digest(empty).count() == 0


TEXTS_ROWS = list(enumerate(TEXTS, 100))


def test_terms_that_disclose_an_entity(documents):
    away = [(i, f"plain words number {chr(97 + i % 26) * 5} and common stuff") for i in range(200)]
    near = [(1000 + i, f"common stuff from {'abcdef'[i] * 4} Zanzibar: ann@corp.org and {'uvwxyz'[i] * 5} common") for i in range(6)]
    alone = [(2000, "we met in zanzibar once, zanzibars don't count")]
    docs = documents([*away, *near, *alone])
    rows = {r["doc_id"]: r["spans"] for r in pii.digest(docs).collect()}
    t = dict([*away, *near, *alone])
    assert all("email:" in rows[i] and "term:" in rows[i] for i, _ in near)
    assert rows[2000] == "term:10:18"
    assert all(rows[i] == "" for i, _ in away)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[2000] == "we met in <TERM> once, zanzibars don't count"
    assert "Zanzibar" not in clean[1000]
    assert "ann@corp.org" not in clean[1000]
    assert "<EMAIL>" in clean[1000]
    assert all(clean[i] == t[i] for i, _ in away)


@pytest.mark.parametrize("few_terms", [0, 64])
def test_planted_terms_are_found_and_no_others(documents, monkeypatch, few_terms):
    """Each entity is named in five texts, beside a name that stands nowhere else or in one other text; words that are used elsewhere, or beside it once, don't give it away."""
    monkeypatch.setattr(pii, "FEW_TERMS", few_terms)
    r = random.Random(8)
    words = ["".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows, planted = [(i, " ".join(words)) for i in (5000, 5001)], set()
    for i in range(400):
        if i % 8 < 3:
            rows.append((i, prose(60)))
            continue
        k = i // 8
        name = "".join(chr(97 + int(d)) for d in f"{k:04d}") + "q"
        planted.add((i, name))
        once = "".join(chr(107 + int(d)) for d in f"{i:04d}") + "z"
        rows.append((i, f"{prose(20)} {name} {prose(2)} user{k}@site{k}.org {once} {prose(30)}"))
    rows.append((6000, f"away from it {rows[5][1].split()[20]} stands here"))
    planted.add((6000, rows[5][1].split()[20]))
    found = set()
    texts = dict(rows)
    for x in pii.digest(documents(rows)).collect():
        for span in filter(None, x["spans"].split(",")):
            kind, start, end = span.split(":")
            if kind == "term":
                found.add((x["doc_id"], texts[x["doc_id"]][int(start) : int(end)]))
    assert found == planted


def test_a_word_seen_once_proves_nothing(documents):
    """However large the corpus and however rare the word: each of 400 entities stands beside a word of its own."""
    name = lambda i: "".join(chr(97 + int(d)) for d in f"{i:05d}")
    rows = [(i, f"see {name(i)} at user{i}@site{i}.org") for i in range(400)] + [(1000, "\n".join(f"see {name(5000 + i)} at other{i}@site.org" for i in range(50)))]
    assert all("term" not in r["spans"] for r in pii.digest(documents(rows)).collect())


def test_many_spans_in_one_text_cost_as_much_each(documents):
    """One text of 16,000 addresses, on one line, with names that give them away: twice as many take no more than about twice as long."""
    import time

    def text(n):
        return " ".join(f"w{i} user{i}@site.org" for i in range(n)) + " ann@corp.org Zanzibar"

    near = [(1000 + i, f"common stuff from {'abcdef'[i] * 4} Zanzibar: ann@corp.org and {'uvwxyz'[i] * 5} common") for i in range(6)]
    away = [(i, f"plain words number {i}") for i in range(200)]
    took = {}
    for n in (100, 8_000, 16_000):
        docs = documents([(1, text(n)), *near, *away[2:]])
        began = time.perf_counter()
        clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}[1]
        took[n] = time.perf_counter() - began
        assert clean == " ".join(f"w{i} <EMAIL>" for i in range(n)) + " <EMAIL> "
        got = next(r for r in pii.digest(docs).collect() if r["doc_id"] == 1)
        assert got["n_email"] == n + 1 and got["n_spans"] == n + 2
    assert took[16_000] - took[100] < 3 * max(took[8_000] - took[100], 1), took


def test_sums_by_blocks(spark):
    from pyspark.sql import functions as F

    r = random.Random(4)
    rows = [([r.randint(0, 50) for _ in range(n)],) for n in (0, 1, 2, 3, 4, 5, 9, 10, 99, 1000)]
    df = spark.createDataFrame(rows, "v array<int>").select("v", pii._before(F.col("v"), lambda a, x: a + x, 0).alias("s"), pii._before(F.col("v"), lambda a, x: F.greatest(a, x), 0).alias("m"))
    for x in df.collect():
        assert x["s"] == [sum(x["v"][:i]) for i in range(len(x["v"]))]
        assert x["m"] == [max([0, *x["v"][:i]]) for i in range(len(x["v"]))]


def test_repeated_rows_count_once_for_terms(documents):
    away = [(i, f"plain words number {chr(97 + i % 26) * 5} and common stuff") for i in range(200)]
    near = [(1000 + i, f"common stuff from {'abcdef'[i] * 4} Zanzibar: ann@corp.org and {'uvwxyz'[i] * 5} common") for i in range(6)]
    alone = [(2000, "we met in zanzibar once")] * 30
    rows = [r for r in pii.digest(documents([*away, *near, *alone])).collect() if r["doc_id"] >= 1000]
    assert [r["spans"] for r in rows if r["doc_id"] == 2000] == ["term:10:18"] * 30
    assert all(len(set(x)) == len(x) for x in (r["spans"].split(",") for r in rows))


def test_terms_that_disclose_all_are_removed(documents):
    away = [(i, f"plain words number {chr(97 + i % 26) * 5} and common stuff") for i in range(200)]
    near = [(1000 + i, f"common stuff {'abcdef'[i] * 4} Zanzibar Lisboa: ann@corp.org and {'uvwxyz'[i] * 5} common") for i in range(6)]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(documents([*away, *near, (2000, "we met in lisboa once")])).collect()}
    assert clean[1000] == "common stuff aaaa  <TERM>: <EMAIL> and uuuuu common"
    assert clean[2000] == "we met in <TERM> once"


def test_sanitise_keeps_rows_and_columns(odd, empty):
    out = pii.sanitise(odd)
    assert out.columns == odd.columns
    rows = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert rows == Counter((i, "mail me at <EMAIL> or <PHONE>\nsecond line é漢字 🙂" if i == 9 else t) for i, t in ODD)
    assert pii.sanitise(empty).count() == 0


LINE = " ".join(f"word{i}" for i in range(60))


def test_repeated_passages_go_and_the_first_stays(documents):
    passage = "\n".join(f"passage line {i} says this and that" for i in range(12))
    docs = documents([(1, f"own a\nown b\n{passage}\nown c"), (2, f"other\n{passage}\nmore\nand more"), (3, f"{LINE}\nx"), (4, f"y\n{LINE}"), (5, "other"), (6, "short\nown tail of six")])
    out = {r["doc_id"]: r for r in line_dedup.drop_repeated_lines(docs, counts=True).collect()}
    t = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert out[1]["text"] == t[1]
    assert out[3]["text"] == t[3]
    assert out[2]["n_removed"] >= 8
    assert all(x in out[2]["text"].split("\n") for x in ("other", "more", "and more"))
    assert out[4]["text"] == "y"
    assert [out[i]["text"] for i in (5, 6)] == [t[5], t[6]]


def test_short_passages_go_whatever_is_around_them(documents):
    rows = []
    for n in (2, 3, 6):
        for i in range(12):
            passage = [f"passage {n} {i} line {j} with some words of its own" for j in range(n)]
            rows += [(len(rows), "\n".join([f"before {n} {i}", *passage, f"after {n} {i}"])), (len(rows) + 1, "\n".join([f"other {n} {i}", *passage, "", f"end {n} {i}"]))]
    # no chunk ends inside 902 and 903, so pairs alone decide
    rows += [(900, "one\ntwo"), (901, "two\none\nthree"), (902, "d d\nd d\nd d"), (903, "j j\nj j\nj j\nj j"), (904, "one\n\ntwo")]
    out = {r["doc_id"]: r for r in line_dedup.drop_repeated_lines(documents(rows), counts=True).collect()}
    for i, t in rows:
        first = i % 2 == 0 if i < 900 else i != 903
        want = t if first else "j j\nj j" if i == 903 else "\n".join([t.split("\n")[0], "", t.split("\n")[-1]])
        assert (out[i]["text"], out[i]["n_removed"]) == (want, t.count("\n") - want.count("\n"))


def test_line_dedup_of_odd_input(odd, empty):
    out = line_dedup.drop_repeated_lines(odd)
    assert out.columns == odd.columns
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert sum(got.values()) == len(ODD)
    same = {(i, t) for i, t in ODD if i not in (7,)}
    assert same - {(10, "\n\n\nline\nline\nline")} <= set(got)
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def test_hash_clashes_are_told_apart_by_their_bytes(documents, monkeypatch):
    from pyspark.sql import functions as F

    real = F.xxhash64

    def coarse(*columns):
        return F.lit(7).cast("long") if [c for c in columns if isinstance(c, str)] == ["chunk"] else real(*columns)

    monkeypatch.setattr(line_dedup.F, "xxhash64", coarse)
    docs = documents([(1, LINE), (2, LINE), (3, LINE.upper()), (4, "a b c")])
    assert {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(docs).collect()} == {1: LINE, 2: "", 3: LINE.upper(), 4: "a b c"}


def measures(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_ledger(documents, odd, empty):
    texts = ["a b c d e f g h " * 3, "x y " + "1 2 3 4 5 6 7 8 9 " * 2 + "z", "# * $ %% &| <>", "l\nl\n \n \nm", " ".join(map(str, range(100))), "a " * 8, "a " * 9, "α β γ \x0b δ"]
    rows = [*ODD, *enumerate(texts, 200)]
    docs = odd.select("doc_id", "text").union(documents(list(enumerate(texts, 200))).select("doc_id", "text"))
    led = quality.ledger(docs)
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in led.collect())
    assert got == Counter((i, *measures(t)) for i, t in rows)
    for r in quality.apply_policy(led, "base/1").collect():
        assert r["kept"] == (r["n_words"] >= 20 and 100 * r["n_repeat_words"] <= 30 * r["n_words"])
    whole = led.collect()
    m = quality.mask("prose/1")
    for r in quality.ablations(led, "prose/1").collect():
        bit = 1 << [n for n, _ in quality.RULES].index(r["rule"])
        bits = [x["failure_bits"] & m for x in whole]
        assert (r["n_fail"], r["n_fail_alone"], r["n_kept_without"]) == (sum(b & bit > 0 for b in bits), bits.count(bit), sum(b & ~bit == 0 for b in bits))
    assert quality.ledger(empty).count() == 0


def test_stored_ledger_serves_every_policy(spark, odd, empty, tmp_path):
    led = quality.write_ledger(odd, str(tmp_path / "ledger"))
    assert led.count() == odd.count()
    rows = led.collect()
    for policy in quality.POLICIES:
        kept = Counter(r["doc_id"] for r in quality.apply_policy(led, policy).where("kept").collect())
        assert kept == Counter(r["doc_id"] for r in rows if not r["failure_bits"] & quality.mask(policy))
        got = {r["rule"]: (r["n_fail"], r["n_fail_alone"], r["n_kept_without"]) for r in quality.ablations(led, policy).collect()}
        for i, (name, _) in enumerate(quality.RULES):
            if name in quality.POLICIES[policy]:
                bits = [r["failure_bits"] & quality.mask(policy) for r in rows]
                assert got[name] == (sum(b >> i & 1 for b in bits), sum(b == 1 << i for b in bits), sum(b & ~(1 << i) == 0 for b in bits))
    none = quality.write_ledger(empty, str(tmp_path / "none"))
    assert quality.apply_policy(none, "base/1").count() == 0
    assert quality.ablations(none, "strict/1").count() == 0


def test_long_texts_take_linear_time(documents):
    words = " ".join(f"w{i}" for i in range(200_000))
    r = quality.ledger(documents([(1, words + " " + words)])).first()
    assert r["n_words"] == 400_000
    assert r["n_repeat_words"] == 400_000
    lines = "\n".join(f"line {i}" for i in range(100_000))
    rows = line_dedup.drop_repeated_lines(documents([(1, lines), (2, "x\n" + lines)]), counts=True).collect()
    assert {r["doc_id"]: r["n_removed"] for r in rows} == {1: 0, 2: 100_000}


def test_groups_of_copies_are_left_whole(spark, documents):
    own = [f"line {i} that stands in this text and its copies only" for i in range(8)]
    passage = [f"shared line {i} of a passage that many texts have" for i in range(6)]
    docs = documents([(1, "\n".join(passage)), (2, "\n".join(["spare first", *own[:3]])), (3, "\n".join(own[:4] + passage + own[4:])), (4, "\n".join(["changed", *own[1:4], *passage, *own[4:]])), (5, "\n".join(["other", *own[2:6]])), (6, "\n".join(own[:2] * 2))])
    groups = spark.createDataFrame([(2, 3, True), (3, 3, False), (4, 3, True)], "doc_id long, group long, spare boolean")
    got = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.drop_repeated_lines(docs, groups=groups).collect()}
    assert got[1] == passage  # the first of all
    assert got[2] == ["spare first", *own[:3]]  # of the group
    assert got[3] == own  # the passage goes, and what 2 has doesn't count as earlier, since 2 will be dropped
    assert got[4] == ["changed", *own[1:]]  # cut as 3 is
    assert got[5] == ["other"]
    assert got[6] == [""]
    alone = documents([(3, "\n".join(own + own)), (4, "x")])
    assert line_dedup.drop_repeated_lines(alone, groups=groups).where("doc_id = 3").first()["text"].split("\n") == own
