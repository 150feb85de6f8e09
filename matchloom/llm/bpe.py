"""Byte-level BPE, encoded by backtracking over longest matches, and decoded.

A piece of text is covered from left to right by the longest vocabulary string at each place, found for
all places in one pass of an Aho-Corasick automaton over the bytes (as Latin-1 characters, since the
automaton takes characters). A token is accepted if it is compatible with the one before it: no merge
across their border would have come before the merges that made the two. Compatibility of adjacent
tokens is memoised. If no shorter prefix is compatible either, the last token is taken back, and the
place that it reached is never reached again; so the work is linear in the piece. A greedy cover whose
adjacent tokens are all compatible is exactly what the merges by rank give.

Results for odd input, all tested: a null or empty text has no tokens and decodes to no bytes; very long
texts and pieces cost linear time; repeated rows all appear; an empty table gives an empty table; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import io
from functools import cache

import ahocorasick
import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from .tables import map_rows, read

#: Pieces that a worker remembers, and adjacent pairs; both are forgotten when full.
PIECES, PAIRS = 300_000, 1_000_000


class Codec:
    """Exact merges by rank of one vocabulary; ``ranks`` maps byte strings to ids, lower ids merge first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.prefix: dict[int, int | None] = {}
        self.pieces: dict[str, list[int]] = {}
        self.automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()

    def _parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made ``token``; None for a single byte."""
        if token not in self.parts:
            b, ranks = self.bytes_of[token], self.ranks
            at = [b[i : i + 1] for i in range(len(b))]
            while len(at) > 2:
                rank, i = min((r, i) for i in range(len(at) - 1) if (r := ranks.get(at[i] + at[i + 1], token)) < token)
                at[i : i + 2] = [at[i] + at[i + 1]]
            self.parts[token] = (ranks[at[0]], ranks[at[1]]) if len(at) == 2 else None
        return self.parts[token]

    def _fits(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` stay apart when both stand side by side."""
        key = (left, right)
        if (known := self.pairs.get(key)) is not None:
            return known
        ranks, bytes_of, ceiling = self.ranks, self.bytes_of, float("inf")
        while True:
            joined = ranks.get(bytes_of[left] + bytes_of[right])
            if joined is not None and joined < ceiling:  # merged before either side was complete
                out = False
                break
            # take back the younger of the two border tokens, unless it is a byte
            for side in ("left", "right") if left > right else ("right", "left"):
                parts = self._parts(left if side == "left" else right)
                if parts:
                    break
            if not parts:
                out = True
                break
            # a merge at the same rank goes to the leftmost place first
            ceiling = left if side == "left" else right + 1
            left, right = (parts[1], right) if side == "left" else (left, parts[0])
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[key] = out
        return out

    def _shorter(self, token: int) -> int | None:
        """The longest vocabulary string that ``token`` begins with, short of itself."""
        if token not in self.prefix:
            b = self.bytes_of[token]
            self.prefix[token] = next((self.ranks[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in self.ranks), None)
        return self.prefix[token]

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece by merges alone."""
        n = len(piece)
        longest: list[int] = [-1] * (n + 1)
        reach = [0] * n
        for end, (size, token) in self.automaton.iter(piece.decode("latin-1")):
            start = end - size + 1
            if size > reach[start]:
                reach[start], longest[start] = size, token
        out: list[int] = []
        shut = bytearray(n + 1)  # places that no cover reaches
        at, token, bytes_of = 0, longest[0], self.bytes_of
        while at < n:
            while token is not None:
                end = at + len(bytes_of[token])
                if not shut[end] and (not out or self._fits(out[-1], token)):
                    break
                token = self._shorter(token)
            if token is not None:
                out.append(token)
                at, token = end, longest[end]
            else:
                shut[at] = 1
                last = out.pop()
                at -= len(bytes_of[last])
                token = self._shorter(last)
        return out

    def piece(self, piece: str) -> list[int]:
        """The ids of one match of the splitting pattern; a vocabulary string is itself."""
        ids = self.pieces.get(piece)
        if ids is None:
            b = piece.encode()
            ids = [self.ranks[b]] if b in self.ranks else self.merge(b)
            if len(self.pieces) >= PIECES:
                self.pieces.clear()
            if len(b) < 200:
                self.pieces[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        known, piece, out = self.pieces, self.piece, []
        for p in SPLIT.findall(text or ""):
            ids = known.get(p)
            out += piece(p) if ids is None else ids
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


SPLIT = regex.compile(public_tokenizers.PATTERN)


def load_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(b): int(i) for b, i in map(bytes.split, io.BytesIO(data))}


@cache
def codec(path: str) -> Codec:
    """One codec a worker process; the vocabulary file is installed on every machine."""
    with open(path, "rb") as f:
        return Codec(load_ranks(f.read()))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and the ids of each text."""

    def run(rows):
        c = codec(path)
        for doc_id, text in rows:
            yield doc_id, np.array(c.encode(text), dtype="int32")

    return map_rows(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and the bytes that each list of ids stands for."""

    def run(rows):
        c = codec(path)
        for doc_id, ids in rows:
            yield doc_id, c.decode(() if ids is None else ids)

    return map_rows(encoded.select("doc_id", "ids"), run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, bytes binary")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode in one pass, so that the ids needn't leave the worker."""

    def run(rows):
        c = codec(path)
        for doc_id, text in rows:
            ids = np.array(c.encode(text), dtype="<u4")
            yield doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(c.decode(ids.tolist())).hexdigest()

    return map_rows(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def token_texts(path: str) -> dict[int, bytes]:
    """The vocabulary, for readers of encoded tables."""
    return codec(path).bytes_of


