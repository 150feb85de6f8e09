r"""How filters interact: what each removes after the others, in every order.

A document fails some of the five filters. Whether it survives a subset of them is the truth of "none of these
fails", for each of the 32 subsets one bit, so a document becomes a 32-bit word of the subsets that it survives. Survivors
by subset are the positional population counts of these words: in each task they are added up by carry-save adders,
which take three words of one weight to a sum and a carry for all 32 positions at once, and the tasks' counts
are added by part and label. Everything asked about an order of filters follows from survivors by subset, so documents are read
once, not once an order.

Filters: A few words, B few distinct words, C many capitals, D symbols, E the text of a smaller doc_id. Words are
runs of characters other than space and the controls 9 to 13.

E needs the smallest doc_id of every text that several ids share: ids meet by the text's SHA-256, minima are combined before
they are shuffled, and only such texts are joined back, as a table of its own, so a large group of copies can be split.

Results for odd input, all tested: a null text is the empty one, a null source the empty string; very long texts
are measured whole; repeated rows all count, and don't fail E for each other; a null doc_id is no smaller and no larger than another and
has no label; a label given twice counts if any row has it; an empty table gives an empty table; other columns are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut
from .quality import SPACE
from .tables import few, map_rows, read

FILTERS = "ABCDE"
SYMBOLS = "#$%&*|"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SUBSETS = 1 << len(FILTERS)
#: Kinds of documents whose survivors are counted, and groups that a task holds before it hands on what it has.
KINDS, GROUPS = ("n", "good", "toxic"), 10_000
#: By mask of failed filters: bit s is set if none of the subset s fails.
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not s & m) for m in range(SUBSETS)], dtype=np.uint32)


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit ``words`` have each bit: carry-save adders, level by level."""
    counts, weight, level = np.zeros(32, dtype=np.int64), 1, words.astype(np.uint32)
    while len(level):
        carries = []
        while len(level) > 2:
            third = len(level) // 3
            a, b, c = level[:third], level[third : 2 * third], level[2 * third : 3 * third]
            either = a ^ b
            carries.append((a & b) | (c & either))
            level = np.concatenate([either ^ c, level[3 * third :]])
        for word in level.tolist():
            counts += weight * ((word >> np.arange(32)) & 1)
        level, weight = np.concatenate(carries) if carries else level[:0], 2 * weight
    return counts


def own_failures(text: Column) -> Column:
    """The mask of filters that a text fails by itself: A to D."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    measures = F.struct(F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("distinct"), F.length(text).alias("chars"), F.length(F.translate(text, CAPITALS, "")).alias("rest"))
    m = F.element_at(F.transform(F.array(measures), lambda x: _mask([x["n"] < 200, 100 * x["distinct"].cast("long") < 50 * x["n"].cast("long"), 100 * (x["chars"] - x["rest"]).cast("long") > 2 * x["chars"].cast("long")])), 1)
    return m.bitwiseOR(F.when(text.rlike(f"[{SYMBOLS}]"), 1 << FILTERS.index("D")).otherwise(0))


def _mask(failures: list[Column]) -> Column:
    out = F.lit(0)
    for i, failed in enumerate(failures):
        out = out.bitwiseOR(F.when(failed, 1 << i).otherwise(0))
    return out


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part and fails (the mask of failed filters), a row a document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), own_failures(text).alias("fails"), F.unhex(F.sha2(text, 256)).alias("key")), "texts")
    first = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("key", "first")
    rows = rows.join(few(cut(first, "copied")), "key", "left")
    again = F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    return rows.select("doc_id", "part", F.col("fails").bitwiseOR(again).alias("fails"))


def survivors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part and, for all documents, those of quality 1 and toxic ones, how many survive each subset of the filters (arrays by subset)."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))])
    rows = failures(docs).join(few(cut(marks.where("good or toxic"), "marks")), "doc_id", "left")
    rows = rows.select("part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))

    def run(batches):
        import pyarrow as pa

        def handed_on():
            counts = np.concatenate([np.empty((len(KINDS), 0), dtype=np.int64), *held.values()], axis=1)
            names = pa.array([p for p in held for _ in range(SUBSETS)], pa.string())
            out = [names, pa.array(np.tile(np.arange(SUBSETS, dtype=np.int32), len(held))), *(pa.array(c) for c in counts)]
            held.clear()
            return pa.RecordBatch.from_arrays(out, names=["part", "subset", *KINDS])

        held: dict[str, np.ndarray] = {}
        for batch in batches:
            part = batch["part"].dictionary_encode()
            codes, words = part.indices.to_numpy(), WORDS[batch["fails"].to_numpy()]
            kinds = [np.ones(len(words), dtype=bool), *(batch[k].to_numpy(zero_copy_only=False) for k in KINDS[1:])]
            order = np.argsort(codes, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1) if len(order) else ():
                name = part.dictionary[int(codes[at[0]])].as_py()
                held[name] = held.get(name, 0) + np.stack([positional_counts(words[at][kind[at]]) for kind in kinds])
            if len(held) >= GROUPS:
                yield handed_on()
        yield handed_on()

    counted = rows.mapInArrow(run, "part string, subset int, n long, good long, toxic long").groupBy("part", "subset").agg(*[F.sum(k).alias(k) for k in KINDS])
    whole = counted.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", *KINDS))).alias("s"))  # 32 rows a part
    return whole.select("part", *[F.col(f"s.{k}").alias(k) for k in KINDS])


def audit_rows(part: str, n: list[int], good: list[int], toxic: list[int]) -> Iterator[tuple]:
    """All orders and steps of a part, from its survivors by subset."""
    bit, every = {f: 1 << i for i, f in enumerate(FILTERS)}, SUBSETS - 1
    orders_with = [factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count()) if s != every else 0 for s in range(SUBSETS)]
    shapley = {f: sum(orders_with[s] * (n[s] - n[s | b]) for s in range(SUBSETS) if not s & b) for f, b in bit.items()}
    for order in permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            after = before | bit[f]
            removed = n[before] - n[after]
            yield part, "".join(order), step, n[after], removed, n[0] - n[bit[f]] - removed, n[every ^ bit[f]] - n[every], good[before] - good[after], toxic[before] - toxic[after], shapley[f]
            before = after


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part, order of the filters and step: what that step removes, what it would have, and what is lost."""
    return map_rows(survivors(docs, labels), lambda batch: (row for part in batch for row in audit_rows(*part)), AUDIT)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_BLANK = "[\\x20\\x09-\\x0D]+"
OP13_SQL = f"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{_BLANK}'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM t),
lab AS (SELECT doc_id, coalesce(max(quality) FILTER (quality = 1), 0) AS good, coalesce(max(toxic) FILTER (toxic = 1), 0) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * (length(t) - length(translate(t, '{CAPITALS}', ''))) > 2 * length(t))::INT
  + 8 * regexp_matches(t, '[{SYMBOLS}]')::INT + 16 * coalesce(doc_id > first, false)::INT AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN lab USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || f FROM o, (SELECT unnest(string_split('A B C D E', ' ')) AS f) WHERE NOT contains(filter_order, f)),
s AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM o WHERE length(filter_order) = 5),
b AS (SELECT *, 1 << (ascii(filter_order[step]) - 65) AS own, list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65)))::INT AS before FROM s),
r AS (SELECT part, filter_order, step, own,
  sum(CASE WHEN fails & (coalesce(before, 0) | own) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails & own > 0 AND fails & coalesce(before, 0) = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN fails & own > 0 AND fails & coalesce(before, 0) > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN fails & own > 0 AND fails & coalesce(before, 0) = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails & own > 0 AND fails & coalesce(before, 0) = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, b GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
