import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from .conftest import ODD
from tokenizers import Tokenizer

from matchloom.llm import bpe, packing, token_counts

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def random_texts(n=3000):
    r, vocabulary = random.Random(3), list(bpe.codec(RANKS).ranks)
    out = [b"".join(r.choice(vocabulary) for _ in range(r.randint(1, 7))).decode("utf-8", "replace") for _ in range(n)]
    return out + ["".join(r.choice("aeinrst .,\n'0é漢🙂́") for _ in range(r.randint(0, 80))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_codec_is_exact(name):
    c = bpe.codec(public_tokenizers.path(name))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    for t in [*random_texts(), "a" * 50_000, "the" * 20_000, " " * 3000, "=-" * 9999, "ab" * 3 + "\x00\x7f"]:
        ids = c.encode(t)
        assert ids == enc.encode_ordinary(t)
        assert c.decode(ids) == t.encode()


def test_all_characters_split_alike(library):
    """The libraries and the pattern here agree on every character."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}b {chr(c)} 1{chr(c)}" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    c, e = bpe.codec(RANKS), packing.encoder(JSON)
    for t, x in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert x.ids == e.encode(t) == c.encode(t)


def test_counts_are_the_library_s(library):
    c = token_counts.counter(JSON)
    texts = [*random_texts(), "<|endoftext|>", "a <|endoftext|><|endoftext|> b", "<|endoftext", "a" * 20_000]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert c.count(t) == len(e.ids)
    assert "the" in c.proved


def test_odd_input(odd, empty, library):
    rows = {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(odd, JSON).collect()}
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in ODD}
    assert {x for x in rows if x[0] is not None} == {(i, len((t or "").encode()), len(ids[i]), len(ids[i]) > 1024) for i, t in ODD if i is not None}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.codec(RANKS).ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = sorted(map(str, bpe.round_trip_digests(odd, RANKS).collect()))
    expected = [(i, x) for i, t in ODD for x in [enc.encode_ordinary(t or "")]]
    from pyspark.sql import Row

    want = [Row(doc_id=i, n_tokens=len(x), ids_sha256=sha(np.array(x, "<u4").tobytes()), decoded_sha256=sha((t or "").encode())) for (i, x), (_, t) in zip(expected, ODD, strict=True)]
    assert got == sorted(map(str, want))
    assert token_counts.count_tokens(empty, JSON).count() == bpe.round_trip_digests(empty, RANKS).count() == 0
    encoded = bpe.encode_documents(odd, RANKS)
    assert {(r["doc_id"], bytes(r["bytes"])) for r in bpe.decode_ids(encoded, RANKS).collect()} == {(i, (t or "").encode()) for i, t in ODD}


@pytest.mark.parametrize("capacity", [10, 50, 1024])
def test_plans_place_every_piece(capacity):
    r = random.Random(capacity)
    for _ in range(60):
        histogram = {r.randint(1, capacity): r.randint(1, 2000) for _ in range(r.randint(1, 200))}
        fill, seen = {}, {}
        for n, first, ranks, each, base, offset in packing.plan(histogram, capacity):
            assert first == seen.get(n, 0)
            seen[n] = first + ranks
            for s in range(ranks // each):
                fill.setdefault(base + s, []).append((offset, n * each))
        assert seen == histogram
        for parts in fill.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= capacity
        # each sequence but those with large pieces is mostly full
        assert len(fill) <= 1.25 * sum(n * c for n, c in histogram.items()) / capacity + sum(c for n, c in histogram.items() if 3 * n > capacity) + 1


def test_packing_of_odd_input(odd, empty, library):
    rows = packing.pack_documents(odd, JSON, with_ids=True).collect()
    sequences, docs = {}, {}
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        assert len(r["ids"]) == r["length"] <= 1024
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        docs.setdefault(r["doc_id"], []).append((r["piece"], r["start"], list(r["ids"])))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    for i, t in ODD:
        if i is None or i == 6:
            continue
        whole = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        parts = sorted(docs[i])
        assert [x for _, _, ids in parts for x in ids] == whole
        assert [s for _, s, _ in parts] == [sum(len(p[2]) for p in parts[:k]) for k in range(len(parts))]
        assert all(len(p[2]) == 1024 for p in parts[1:])
    assert packing.pack_documents(empty, JSON).count() == 0


def test_much_repeated_rows_are_packed_each(documents, monkeypatch):
    monkeypatch.setattr(packing, "COPIES", 20)
    rows = packing.pack_documents(documents([(1, "the same words")] * 300 + [(None, "no id")] * 50 + [(2, "other")]), JSON).collect()
    assert len(rows) == 351 and "_salt" not in rows[0].asDict()
    taken = {}
    for r in rows:
        taken.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in taken.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024


def test_packing_takes_very_long_runs(library, documents):
    e = packing.encoder(JSON)
    for t in [" " * 2_000_000, "x" + " \n\t" * 50_000 + "y<|endoftext|> z" + " " * 20_000 + "<|endoftext|>", " " * 9_999 + "x", "\n" * 20_000]:
        assert e.encode(t) == library.encode(t, add_special_tokens=False).ids
    assert len(e.encode("ab" * 1_000_000)) == len(bpe.codec(RANKS).encode("ab" * 1_000_000))
    assert len(e.encode("#$" * 1_000_000)) == len(bpe.codec(RANKS).encode("#$" * 1_000_000))
    rows = packing.pack_documents(documents([(1, " " * 2_000_000), (2, "short")]), JSON).collect()
    assert sum(r["length"] for r in rows) == len(e.encode(" " * 2_000_000)) + len(e.encode("short")) + 2


def brute_force_packing(lengths, capacity):
    """The same rules one piece at a time: large ones matched in pairs, small ones where the least room is left."""
    large, bins = sorted((n for n in lengths if 3 * n > capacity), reverse=True), []
    while large:
        n = large.pop(0)
        mate = next((i for i, m in enumerate(large) if n + m <= capacity), None)
        bins.append([n] if mate is None else [n, large.pop(mate)])
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        best = min((b for b in bins if sum(b) + n <= capacity), key=lambda b: capacity - sum(b), default=None)
        if best is None:
            bins.append([n])
        else:
            best.append(n)
    return bins


@pytest.mark.parametrize("capacity", [7, 12, 30])
def test_plans_are_the_brute_force_packing(capacity):
    r = random.Random(capacity)
    for _ in range(200):
        lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 60))]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        fill = {}
        for n, _, ranks, each, start, _ in packing.plan(histogram, capacity):
            for s in range(ranks // each):
                fill.setdefault(start + s, []).extend([n] * each)
        expected = brute_force_packing(lengths, capacity)
        assert len(fill) == len(expected)
        assert sorted(sum(b) for b in fill.values()) == sorted(sum(b) for b in expected)


def test_large_ids_next_to_nulls_stay_exact(documents):
    docs = documents([(2**60 + 1, "a"), (None, "b"), (2**60 + 3, "c")])
    assert {r["doc_id"] for r in token_counts.count_tokens(docs, JSON).collect()} == {2**60 + 1, None, 2**60 + 3}
