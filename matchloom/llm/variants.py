r"""Spelling variants: words one edit apart, grouped under the most frequent one.

Words that differ by one inserted, deleted or replaced code point meet on asymmetric q-chunks. The shorter word (either,
if they are as long) is cut into two disjoint chunks; one edit spoils one of them at most, so the other one is a
positional gram of the longer word, shifted by one place at most: a chunk before the edit stands where it stood, one after an
insertion stands one place further. Of all positional grams of a word only those are written that a chunk of a word as long, or one
shorter, can meet, which are four. Pairs that meet are verified by their edit distance.

A chunk that more than ``CROWD`` words have would make a pair of any two of them. There the method goes on inside the rest of the word,
which holds the edit: the rest is cut into chunks of at most ``LEAST`` code points, one edit spoils one of them, and words meet on all the others. What
meets then differs by a few neighbouring code points, so a crowd of any size makes few pairs more than it has near words.

``form`` is a word's near word of largest n if that is at least twice its own; ties go to the smaller word. n at least
doubles along forms, so ``root`` is found by a few rounds of doubling.

Results for odd input, all tested: a null or empty text has no words; very long texts and words are taken whole;
repeated rows count each time; a null doc_id is hashed as an empty one; an empty table gives an empty table; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, discard
from .tables import few, map_rows, read

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: One run in so many loses a code point.
DAMAGE = 97
#: Words that have one chunk before it is called crowded, and code points of a chunk of a crowded word's rest. Neither changes the result.
CROWD, LEAST = 64, 2


def damaged(doc_id: int | None, run: str) -> str:
    """The run, or without one of its code points, as the checksum of doc_id and run says."""
    h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % DAMAGE else run[: h % len(run)] + run[h % len(run) + 1 :]


def vocabulary(docs: DataFrame, length: int = 5, least: int = 3) -> DataFrame:
    """(word, n) of the words of at least ``length`` code points that occur ``least`` times or more."""

    def run(batch):
        total: Counter = Counter()
        for doc_id, text in batch:
            for word, n in Counter(RUN.findall((text or "").encode().lower().decode())).items():  # bytes: only A to Z change
                word = damaged(doc_id, word)
                if len(word) >= length:
                    total[word] += n
        yield from total.items()

    counts = map_rows(docs.select("doc_id", "text"), run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _chunks(word: Column, longer: int) -> Column:
    """The two places where a chunk of a word that is ``longer`` code points shorter can stand in ``word``: its layout's length, which chunk, the gram, and the rest."""
    n = F.length(word) - longer
    half = F.floor(n / 2).cast("int")
    first = F.struct(n.alias("len"), F.lit(0).alias("chunk"), F.substring(word, F.lit(1), half).alias("gram"), F.substring(word, half + 1, F.length(word)).alias("rest"))
    second = F.struct(n.alias("len"), F.lit(1).alias("chunk"), F.substring(word, half + 1 + longer, F.length(word)).alias("gram"), F.substring(word, F.lit(1), half + longer).alias("rest"))
    return F.array(first, second)


def _without(rest: Column, own: Column) -> Column:
    """``rest`` without each of the chunks of a rest of ``own`` code points: where the chunk begins, and what is left."""
    longer = F.length(rest) - own
    return F.transform(F.sequence(F.lit(0), F.greatest(own - 1, F.lit(0)), F.lit(LEAST)), lambda at: F.struct(at.alias("at"), F.concat(F.substring(rest, F.lit(1), at), F.substring(rest, at + 1 + LEAST - F.greatest(at + LEAST - own, F.lit(0)) + longer, F.length(rest))).alias("kept")))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b): pairs of the distinct ``words`` (word) that are one edit apart, each once, a no longer than b."""
    w = F.col("word")
    short = words.select("word", F.explode(_chunks(w, 0)).alias("c")).select("word", "c.*")
    long_ = words.select("word", F.explode(F.concat(_chunks(w, 0), F.filter(_chunks(w, 1), lambda c: c["len"] > 0))).alias("c")).select("word", "c.*")
    key = ["len", "chunk", "gram"]
    crowded = few(cut(short.groupBy(*key).agg(F.count("*").alias("m")).where(F.col("m") > CROWD).select(*key, F.lit(True).alias("crowded")), "crowded"))
    sides = [cut(side.join(crowded, key, "left").withColumn("crowded", F.coalesce("crowded", F.lit(False))), "chunks") for side in (short, long_)]

    def met(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        a, b = a.alias("a"), b.alias("b")
        same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in on]
        once = (F.length("a.word") < F.length("b.word")) | (F.col("a.word") < F.col("b.word"))
        near = F.levenshtein("a.word", "b.word", 1) == 1
        for c in [*same, once]:
            near = c & near
        return a.join(b, near).select(F.col("a.word").alias("a"), F.col("b.word").alias("b"))

    plain = met(*(side.where("not crowded") for side in sides), key)
    own = F.col("len") - F.length("gram")  # of the shorter word's rest
    finer = [side.where("crowded").select("word", *key, F.explode(_without(F.col("rest"), own)).alias("x")).select("word", *key, "x.*") for side in sides]
    return plain.unionByName(met(*finer, [*key, "at", "kept"])).distinct()


def with_roots(forms: DataFrame) -> DataFrame:
    """(word, form) with ``root``: where following forms ends. Every round doubles how far each word has got."""
    now = cut(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        after = F.col("root")
        step = now.alias("x").join(now.select(F.col("word").alias("at"), F.col("root").alias("next")), after == F.col("at"), "left")
        done = cut(step.select("x.word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = done.where("moved").limit(1).count()
        discard(now)
        now = done.select("word", "root")
        now._matchloom_path = done._matchloom_path
        if not moved:
            break
    return forms.join(now, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of ``docs`` (doc_id, text)."""
    words = cut(vocabulary(docs), "words")
    pairs = cut(near_pairs(words.select("word")), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    best = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("m")), "other").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    rows = words.join(best, "word", "left")
    form = F.when(-F.col("best.m") >= 2 * F.col("n"), F.col("best.other"))
    rows = cut(rows.select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form.isNotNull(), -F.col("best.m")).alias("form_n")), "forms")
    return with_roots(rows).select("word", "form", "root", "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents"))


OP11_SQL = f"""
WITH RECURSIVE bits AS (SELECT i, i::BIGINT AS c, 0 AS step FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
u AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents),
r AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n FROM u GROUP BY ALL),
h AS (SELECT r, n, length(r) AS k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)), '..'), lambda b: ('0x' || b)::BIGINT)),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM r, crc),
d AS (SELECT n, CASE WHEN h % {DAMAGE} = 0 THEN r[1:h % k] || r[h % k + 2:] ELSE r END AS w FROM h),
w AS (SELECT w AS word, sum(n)::BIGINT AS n FROM d WHERE length(w) >= 5 GROUP BY w HAVING sum(n) >= 3),
v AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w),
x AS (SELECT word, i, word[1:i - 1] || word[i + 1:] AS k FROM v),
p AS (SELECT a.word, b.word AS other FROM x a JOIN x b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
  UNION SELECT x.word, w.word FROM x JOIN w ON x.k = w.word UNION SELECT w.word, x.word FROM x JOIN w ON x.k = w.word),
g AS (SELECT p.word, count(*) AS n_near, arg_min(p.other, (-w.n, p.other)) AS other, max(w.n) AS m FROM p JOIN w ON w.word = p.other GROUP BY p.word),
f AS (SELECT word, CASE WHEN m >= 2 * n THEN other END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * n THEN m END AS form_n FROM w LEFT JOIN g USING (word)),
c AS (SELECT word, word AS now, 0 AS step FROM f UNION ALL SELECT c.word, f.form, step + 1 FROM c JOIN f ON f.word = c.now WHERE f.form IS NOT NULL),
e AS (SELECT word, arg_max(now, step) AS root FROM c GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN e USING (word)
"""
