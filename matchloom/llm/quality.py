r"""Quality rules as a ledger of failure bits.

Every rule is evaluated once a document; the ledger holds the measurements and one bit a failed rule.
Policies are named, versioned masks over those bits, so applying another one, or asking what a rule costs
(:func:`ablations`), reads the stored ledger (:func:`write_ledger`) alone. ``op9_quality_rules`` needs one policy and
reads each text once, so it stores nothing and returns the bits; ``quality_ablations`` stores the ledger and asks all policies of it.

Words are runs of characters other than space and the controls 9 to 13. All work is array functions within a
row: nothing is shuffled, and windows of eight words are compared by hash first and by their words after.

Results for odd input, all tested: a null text has no words and fails ``few_words``; very long texts are
measured whole; repeated rows all appear; an empty table gives an empty table; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_root
from .tables import let, read

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Rules by bit; a rule is a failure condition on the measurements. Bits are never given away again.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeats_itself", "100 * n_repeat_words > 30 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("symbols", "n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("some_symbols", "10 * n_symbols > n_words"),
)
#: Policies by name and version: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base/1": ("few_words", "repeats_itself"),
    "prose/1": ("few_words", "repeats_itself", "short_words", "long_words", "symbols", "repeated_lines"),
    "strict/1": tuple(name for name, _ in RULES),
}


def mask(policy: str) -> int:
    return sum(1 << i for i, (name, _) in enumerate(RULES) if name in POLICIES[policy])


def _doubles(marks: Column) -> Column:
    """Positions of the entries of a sorted array of (value, position) whose value stands there twice or more."""
    same = lambda x, i: ((i > 0) & (F.get(marks, i - 1)["v"] == x["v"])) | (F.coalesce(F.get(marks, i + 1)["v"] == x["v"], F.lit(False)))
    return F.transform(F.filter(marks, lambda x, i: same(x, i)), lambda x: x["p"])


def _covered(starts: Column) -> Column:
    """How many words the windows that begin at the sorted ``starts`` cover."""
    n = F.size(starts)
    return F.aggregate(F.transform(starts, lambda p, i: F.when(i == n - 1, WINDOW).otherwise(F.least(F.lit(WINDOW), F.get(starts, i + 1) - p)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words inside windows of eight words that stand twice or more in the text."""
    marks = lambda value: F.array_sort(value)

    def exact(at: Column) -> Column:  # few positions: those whose hash is there twice
        texts = F.transform(at, lambda p: F.struct(F.concat_ws(" ", *[F.get(words, p + k) for k in range(WINDOW)]).alias("v"), p.alias("p")))
        return let(marks(texts), lambda m: let(F.array_sort(_doubles(m)), _covered))

    by_hash = let(marks(F.transform(hashes, lambda h, i: F.struct(h.alias("v"), i.alias("p")))), lambda m: let(_doubles(m), exact))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), by_hash).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements that the rules read."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("t"), F.filter(F.split(text, SPACE), lambda w: w != "").alias("words"))
    rows = rows.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != ""))
    # bound by `let`: an expression that Spark moves into a lambda would be computed again for every window
    # words of a window are found by their places, so long texts take linear time
    rolled = let(F.transform("words", lambda w: F.xxhash64(w)), lambda wh: F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(*[F.get(wh, i - 1 + k) for k in range(WINDOW)])))
    windows = F.when(F.size("words") >= WINDOW, rolled).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("windows", windows)
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words"), F.col("windows")).alias("n_repeat_words"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and ``failure_bits``."""
    bits = F.lit(0)
    for i, (_, rule) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule), 1 << i).otherwise(0))
    return measure(docs).withColumn("failure_bits", bits)


def write_ledger(docs: DataFrame, path: str) -> DataFrame:
    """The ledger of ``docs``, stored: policies and ablations read it, and no text is measured again. Returned as it is read back."""
    led = ledger(docs)
    led.write.mode("errorifexists").parquet(path)
    return docs.sparkSession.read.schema(led.schema).parquet(path)


def apply_policy(led: DataFrame, policy: str) -> DataFrame:
    """The ledger with ``kept``: no rule of the policy failed."""
    return led.withColumn("kept", F.col("failure_bits").bitwiseAND(mask(policy)) == 0)


def ablations(led: DataFrame, policy: str) -> DataFrame:
    """A row for each rule of the policy: documents that fail it, that only it rejects, and that stay without it."""
    counts = led.groupBy("failure_bits").agg(F.count("*").alias("n"))  # at most 2 ** rules rows
    m = mask(policy)
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << i).alias("bit")) for i, (name, _) in enumerate(RULES) if m >> i & 1])
    rows = counts.select("n", F.col("failure_bits").bitwiseAND(m).alias("b"), F.explode(rules).alias("r"))
    when = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(
        when(F.col("b").bitwiseAND(F.col("r.bit")) != 0).alias("n_fail"),
        when(F.col("b") == F.col("r.bit")).alias("n_fail_alone"),
        when(F.col("b").bitwiseAND(F.lit(m).bitwiseXOR(F.col("r.bit"))) == 0).alias("n_kept_without"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = apply_policy(ledger(read(spark, sf_dir, "documents")), "prose/1")
    base = F.col("failure_bits").bitwiseAND(mask("base/1")) != 0
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("kept")).alias("kept"), "failure_bits")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All policies' ablations from one stored ledger of ``documents``."""
    led = write_ledger(read(spark, sf_dir, "documents"), f"{shared_root(spark)}/matchloom/ledger-{uuid.uuid4().hex}")
    parts = [ablations(led, p).withColumn("policy", F.lit(p)) for p in POLICIES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("policy", "rule", "n_fail", "n_fail_alone", "n_kept_without")


_BLANK = "[\\x20\\x09-\\x0D]"
_MEASURED = f"""
WITH t AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{_BLANK}+'), lambda x: x <> '') AS words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{_BLANK}+', '', 'g') <> '') AS lines FROM t),
win AS (SELECT row_id, unnest(range(1, len(words) - {WINDOW - 2})) AS p, words FROM w WHERE len(words) >= {WINDOW}),
txt AS (SELECT row_id, p, array_to_string(words[p:p + {WINDOW - 1}], ' ') AS v FROM win),
dup AS (SELECT row_id, p, count(*) OVER (PARTITION BY row_id, v) AS c FROM txt),
cov AS (SELECT row_id, sum(CASE WHEN nxt IS NULL THEN {WINDOW} ELSE least({WINDOW}, nxt - p) END) AS n FROM
  (SELECT row_id, p, lead(p) OVER (PARTITION BY row_id ORDER BY p) AS nxt FROM dup WHERE c > 1) GROUP BY row_id),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '{_BLANK}+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (row_id))"""
_BITS = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, (_, rule) in enumerate(RULES))
OP9_SQL = f"""{_MEASURED}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  ({" OR ".join(r for n, r in RULES if n in POLICIES["base/1"])}) AS base_failed,
  NOT ({" OR ".join(r for n, r in RULES if n in POLICIES["prose/1"])}) AS kept, ({_BITS})::INT AS failure_bits FROM m
"""
_ASKED = ", ".join(f"('{p}', '{name}', {1 << i}, {mask(p)})" for p in POLICIES for i, (name, _) in enumerate(RULES) if mask(p) >> i & 1)
ABLATIONS_SQL = f"""{_MEASURED}, b AS (SELECT {_BITS} AS bits FROM m), q AS (SELECT * FROM (VALUES {_ASKED}) v(policy, rule, bit, mask))
SELECT policy, rule, count(*) FILTER (bits & bit > 0) AS n_fail, count(*) FILTER (bits & mask = bit) AS n_fail_alone, count(*) FILTER (bits & mask & ~bit = 0) AS n_kept_without FROM b, q GROUP BY policy, rule
"""
