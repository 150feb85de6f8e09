"""Token counts of whole texts without encoding them.

Offline, once a worker, every vocabulary string is encoded by the library itself; those that come back as
their own id alone are proved to be one token wherever they are a whole piece of a split text. Counting is
then a look-up for such pieces, and only the rest are merged (and remembered).

Results for odd input, all tested: a null text counts as an empty one, with no bytes and no tokens; special
strings inside a text are the one token that the library makes of them; very long texts and pieces cost
linear time; repeated rows all appear; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import json
import re
from functools import cache

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe import PIECES, SPLIT, Codec
from .tables import map_rows, read


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that vocabularies of this kind use for bytes: a byte that is printable in Latin-1 is itself, the others follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Counter(dict):
    """Tokens of a piece; proved pieces are there from the start, others are merged when first asked for."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        if model["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["normalizer"]:
            raise ValueError(f"{path} is no byte-level BPE without a normalizer")
        special = {t["content"] for t in spec["added_tokens"]}
        self.vocabulary = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        order = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if order != sorted(order):
            raise ValueError(f"{path}: merges don't follow the ids")
        self.codec = Codec(self.vocabulary)
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)")
        strings = {}
        for b, i in self.vocabulary.items():
            try:
                strings[b.decode()] = i
            except UnicodeDecodeError:
                continue  # a part of a character is no whole piece
        proofs = Tokenizer.from_file(path).encode_batch(list(strings), add_special_tokens=False)
        self.proved = {s: 1 for (s, i), e in zip(strings.items(), proofs, strict=True) if e.ids == [i]}
        super().__init__(self.proved)

    def __missing__(self, piece: str) -> int:
        n = len(self.codec.merge(piece.encode()))
        if len(piece) < 200:
            if len(self) >= PIECES + len(self.proved):
                self.clear()
                self.update(self.proved)
            self[piece] = n
        return n

    def count(self, text: str | None) -> int:
        parts = self.special.split(text or "")
        return len(parts) - 1 + sum(sum(map(self.__getitem__, SPLIT.findall(p))) for p in parts)


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """Bytes and tokens of each text, and whether it has more than ``limit`` tokens."""

    def run(rows):
        c = counter(path)
        for doc_id, text in rows:
            n = c.count(text)
            yield doc_id, len((text or "").encode()), n, n > limit

    return map_rows(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
