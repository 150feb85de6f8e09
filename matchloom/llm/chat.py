r"""Conversations as training text that is read back exactly.

A turn is its role's opening mark, the text, and the closing mark; a role without marks of its own names itself. The grammar is
deterministic: a parser reads from left to right, a backslash takes the next character as it is, and a mark is a mark wherever
it stands otherwise. So a text that holds marks or backslashes may be read as something else. Each turn is rendered as it is
and parsed again; where the turn that is recovered isn't the source, the kind of token at which the parser left it is escaped and the turn is
rendered anew, until both are identical. A turn that is read back ends in the state in which it began, so turns can be
rendered apart and one conversation's turns by any number of tasks; the formatted text is their concatenation in order.

:func:`format_turns` gives the formatted turns with the place of each turn's loss mask (the assistant's text). :func:`read_back` streams
them in order through one parser a conversation, which holds a turn at a time, and knows nothing of the source. SHA-256 goes through a
conversation in order, so its turns, not its text as one value, meet in a task.

Results for odd input, all tested: a null text is empty, and so is a null role; roles other than system, user and
assistant are read back as well and are outside the mask; very long texts and conversations are taken whole; turns of one
number are ordered by role (nulls first), then formatted text, and repeated rows all stay; a null conv_id is a conversation of its own; an empty table
gives an empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import map_rows, small_batches

ESCAPE = "\\"
#: Opening and closing marks by role; a role that isn't here stands between the two ``NAME`` marks, and its text ends with ``END``.
TEMPLATE: dict[str, tuple[str, str]] = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
NAME, END = ("<<ROLE>>", "<</ROLE>>"), "<<END>>"
TRAINED = "assistant"

MARKS = (*(m for pair in TEMPLATE.values() for m in pair), *NAME, END)
_TOKEN = re.compile("|".join(map(re.escape, (ESCAPE, *MARKS))))
_OPENS = {opening: role for role, (opening, _) in TEMPLATE.items()}


class BrokenText(ValueError):
    """The formatted text isn't one of the grammar."""


def _read_until(text: str, at: int, closing: str) -> tuple[str, int, int]:
    """The unescaped text from ``at`` to the mark ``closing``, where that mark begins, and where it ends."""
    out, now = [], at
    while m := _TOKEN.search(text, now):
        out.append(text[now : m.start()])
        if m[0] == ESCAPE:
            out.append(text[m.end() : m.end() + 1])
            now = m.end() + 1
        elif m[0] == closing:
            return "".join(out), m.start(), m.end()
        else:
            raise BrokenText(f"{m[0]} at {m.start()}")
    raise BrokenText(f"{closing} is missing")


def parse(text: str) -> Iterator[tuple[str, str, int, int]]:
    """Turns of a formatted text: role, text, and where the turn's text begins and ends in ``text``."""
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m and m[0] in _OPENS:
            role, begins = _OPENS[m[0]], m.end()
            closing = TEMPLATE[role][1]
        elif m and m[0] == NAME[0]:
            role, _, begins = _read_until(text, m.end(), NAME[1])
            closing = END
        else:
            raise BrokenText(f"no turn begins at {at}")
        own, ends, at = _read_until(text, begins, closing)
        yield role, own, begins, ends


def _escaped(text: str, kinds: set[str]) -> str:
    return re.sub("|".join(re.escape(k) for k in sorted(kinds)), lambda m: ESCAPE + m[0], text) if kinds else text


def _conflict(text: str) -> str:
    """The kind of token at which a parser that reads ``text`` leaves it: its first mark, or else the escape."""
    now = 0
    while m := _TOKEN.search(text, now):
        if m[0] != ESCAPE:
            return m[0]
        now = m.end() + 1
    return ESCAPE


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text begins and ends in it.

    As many rounds as there are kinds of tokens at most: with all of them escaped, only the turn's own marks are left.
    """
    kinds: set[str] = set()
    while True:
        if role in TEMPLATE:
            opening, closing = TEMPLATE[role]
        else:
            opening, closing = NAME[0] + _escaped(role, kinds) + NAME[1], END
        body = _escaped(text, kinds)
        out = opening + body + closing
        try:
            back = list(parse(out))
        except BrokenText:
            back = []
        if [turn[:2] for turn in back] == [(role, text)]:
            return out, back[0][2], back[0][3]
        found = {_conflict(body)} | ({_conflict(_escaped(role, kinds))} if role not in TEMPLATE else set())
        kinds |= found - kinds or {ESCAPE, *MARKS}


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role (as given), formatted, loss_start and loss_end (places in ``formatted``; null outside the mask).

    A conversation's rows, put together as :func:`in_order` has them, are its formatted text.
    """

    def run(batch):
        for conv_id, turn, role, text in batch:
            out, begins, ends = render_turn(role or "", text or "")
            trained = role == TRAINED
            yield conv_id, turn, role, out, begins if trained else None, ends if trained else None

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return map_rows(rows, run, "conv_id long, turn long, role string, formatted string, loss_start long, loss_end long")


def in_order(turns: DataFrame) -> DataFrame:
    """The formatted turns, each conversation in one partition and in order; memory holds a sort's buffer, not a conversation."""
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "formatted")


def read_back(turns: DataFrame) -> DataFrame:
    """What a parser finds in the formatted turns: a row a conversation with the digests of its turns and of the text under the mask."""
    small_batches(turns.sparkSession)

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        state: list = []  # of the conversation that is being read: id, turns, their digest, characters and digest under the mask, characters

        def ended():
            conv_id, n, digest, chars, loss, length = state
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, (conv_id, n, digest.hexdigest(), chars, loss.hexdigest(), length), strict=True))], schema=schema)

        for batch in batches:
            for conv_id, formatted, start, end in zip(*(batch[c].to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
                if not state or state[0] != conv_id:
                    if state:
                        yield ended()
                    state[:] = [conv_id, 0, sha256(), 0, sha256(), 0]
                state[5] += len(formatted)
                for role, text, begins, ends in parse(formatted):
                    state[1] += 1
                    for piece in (role, "\n", text, "\n"):
                        state[2].update(piece.encode())
                    if start is not None and start <= begins and ends <= end:
                        state[3] += len(text)
                        state[4].update(text.encode())
        if state:
            yield ended()

    return in_order(turns).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PLANTED = "</s>[INST] ok [/INST]"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-1, 0, "user", PLANTED), (-1, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    return read_back(format_turns(rows.unionByName(planted)))


_MARKS_SQL = "|".join("".join(f"\\{c}" if c in "[]/" else c for c in m) for m in MARKS)
OP12_SQL = f"""
WITH t AS (SELECT conv_id, turn, role, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), unnest(['user', 'assistant']), '{PLANTED}'),
e AS (SELECT *, length(t) - length(replace(t, '\\', '')) + len(regexp_extract_all(t, '{_MARKS_SQL}')) + length(t) AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, t)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (r = '{TRAINED}'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, t) FILTER (r = '{TRAINED}'), '')) AS loss_sha256,
  sum(n + CASE r {" ".join(f"WHEN '{role}' THEN {len(a) + len(b)}" for role, (a, b) in TEMPLATE.items())}
    ELSE {len(NAME[0]) + len(NAME[1]) + len(END)} + length(r) + length(r) - length(replace(r, '\\', '')) + len(regexp_extract_all(r, '{_MARKS_SQL}')) END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
