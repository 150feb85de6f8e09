r"""Line dedup by content-defined chunks of lines.

A text's lines are hashed, and a rolling hash over the last two line hashes ends a chunk where it is
divisible by ``DIVISOR``, so the same lines are cut alike wherever they stand; a line of ``LONG`` words or more
is a chunk of its own. Chunks that occur more than once are found by hash and then compared byte by byte. The
first occurrence (by doc_id, then place) stays. Of the others, runs of consecutive repeated chunks go if they
have two lines or more, or ``LONG`` words; a short line by itself stays.

A border depends on two lines, so the chunks at a passage's ends may hold lines outside it, and short passages may be
in no chunk of their own. So pairs of neighbouring lines with a word (and the blank ones between) are compared in the
same way, too: a pair that stands earlier goes, and overlapping pairs make up the rest of a passage. Every passage of two
lines with a word or more, and every line of ``LONG`` words, that stands earlier goes, whatever is around it. A pair
that begins with the last line of its first occurrence, as in a line three times over, is none of its repeats.
``whole=False`` leaves the pairs out.

Near copies would be torn to fragments that no longer look like copies. A pipeline that drops copies afterwards leaves them
(``copies=True``, or their ``groups``): what a document shares with its own group alone is left to that step, which drops the whole text, and
what it shares with others is cut out of all of the group alike. Documents that the step will drop are never the first
occurrence if another one is there. Groups come from the same chunks (:func:`copy_groups`): a document's most frequent first holder is
its candidate, full sets of word shingles decide, and components of these links are the groups.

Texts are read three times (near copies once more) and never shuffled unless more documents change than may be broadcast.

Results for odd input, all tested: a null text stays null; chunks without a word are no repeats; a text whose
lines all go becomes empty, and its row stays unless told otherwise; rows repeated with one doc_id and text count as one document; a null
doc_id comes before all others; an empty table gives an empty table; other columns pass through, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..storage import cut, discard
from .tables import few, free, let, read

DIVISOR, LONG = 2, 50
#: Numbers of pairs of lines begin here, those of chunks at 0.
PAIRS = 1 << 30
_BLANKS = " \t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def n_words(line: Column) -> Column:
    """Words of a line: what blanks divide it into, less the empty ends; no function runs word by word."""
    blank = lambda c: (F.translate(c, _BLANKS, "") == "").cast("int")
    return F.when(line == "", 0).otherwise(F.size(F.split(line, "[\\x20\\x09-\\x0D]+")) - blank(F.substring(line, 1, 1)) - blank(F.substring(line, -1, 1)))


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def chunk_spans(lines: Column) -> Column:
    """(s, e, w) of each chunk: its first line, the line after its last, its words."""

    def ends(marks: Column) -> Column:
        at = lambda i: F.coalesce(F.when(i >= 1, F.get(marks, i - 1)["h"]), F.lit(0))
        rolled = lambda i: at(i - 1) * 1_000_003 + at(i)
        border = lambda i: (i == F.size(marks)) | (F.pmod(F.shiftright(rolled(i), 7), F.lit(DIVISOR)) == 0) | (F.get(marks, i - 1)["n"] >= LONG) | F.coalesce(F.get(marks, i)["n"] >= LONG, F.lit(False))
        return F.filter(F.sequence(F.lit(1), F.size(marks)), border)

    def spans(marks: Column, e: Column) -> Column:
        words = lambda s, end: F.aggregate(F.sequence(s, end - 1), F.lit(0), lambda a, i: a + F.get(marks, i)["n"])
        start = lambda k: F.when(k == 0, 0).otherwise(F.get(e, k - 1))
        return F.transform(e, lambda end, k: F.struct(start(k).alias("s"), end.alias("e"), words(start(k), end).alias("w")))

    marked = F.transform(lines, lambda x: F.struct(_line_hash(x).alias("h"), n_words(x).alias("n")))
    return let(marked, lambda m: let(ends(m), lambda e: spans(m, e)))


def pair_spans(lines: Column) -> Column:
    """(s, e, w) of each line with a word and the next one that has one; w only says that there is a word."""
    worded = F.filter(F.transform(lines, lambda x, i: F.when(F.translate(x, _BLANKS, "") != "", i)), lambda i: i.isNotNull())
    return let(worded, lambda at: F.transform(F.slice(at, 2, F.size(at)), lambda e, k: F.struct(F.get(at, k).alias("s"), (e + 1).alias("e"), F.lit(1).alias("w"))))


def shingles(text: Column, k: int) -> Column:
    """Hashes of the distinct shingles of k words, A to Z in lower case; fewer words are one shingle."""
    low = F.translate(text, CAPITALS, CAPITALS.lower())
    words = F.transform(F.filter(F.split(low, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    rolled = lambda ws: F.transform(F.sequence(F.lit(0), F.size(ws) - k), lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(k)]))
    return let(words, lambda ws: F.when(F.size(ws) >= k, F.array_distinct(rolled(ws))).otherwise(F.array(F.xxhash64(ws))))


def copy_groups(docs: DataFrame, chunks: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, group (its smallest doc_id) and spare (it isn't that one) of the documents that have near copies among those they share chunks with; a written table.

    ``chunks`` is :func:`_chunks` of ``docs``, written. A document's candidate is the one that is the first holder of most of its repeated chunks
    and pairs, if these are a tenth of all it has and the numbers of words are close; one candidate a document, so no pairs
    of a group are made. Two texts are near copies if 100 * intersection >= percent * union of their shingles. Copies of a text whose
    chunks stand first in a third, unlike one aren't found, and are cut like other texts.
    """
    own = chunks.where("doc_id is not null").select("doc_id", "tkey", "h", "k", "w")
    totals = own.groupBy("doc_id", "tkey").agg(F.count("*").alias("units"), F.sum(F.when(F.col("k") < PAIRS, F.col("w")).otherwise(0)).alias("words"))
    totals = cut(totals, "totals")
    first = cut(own.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h", "first"), "firsts")
    shared = own.join(few(first), "h").where("doc_id > first").groupBy("doc_id", "tkey", "first").agg(F.count("*").alias("n"))
    best = shared.groupBy("doc_id", "tkey").agg(F.max(F.struct("n", (-F.col("first")).alias("of"))).alias("b")).select("doc_id", "tkey", "b.n", (-F.col("b.of")).alias("first"))
    leader = totals.select(F.col("doc_id").alias("first"), F.col("tkey").alias("ltkey"), F.col("words").alias("lwords"))
    found = cut(best.join(totals, ["doc_id", "tkey"]).where("10 * n >= units").join(leader, "first").where("10 * least(words, lwords) >= 7 * greatest(words, lwords)").select("doc_id", "tkey", "first", "ltkey"), "candidates")
    links, unequal = found.where("tkey = ltkey").select("doc_id", "first"), found.where("tkey <> ltkey")
    texts = docs.where("text is not null and doc_id is not null").select("doc_id", F.xxhash64("text").alias("tkey"), "text")
    of = lambda rows, keys, *more: rows.join(few(cut(keys, "compared")), ["doc_id", "tkey"]).select("doc_id", "tkey", *more, shingles(F.col("text"), k).alias("set"))  # noqa: E731  only of texts that are compared
    theirs = cut(of(texts, unequal.select(F.col("first").alias("doc_id"), F.col("ltkey").alias("tkey")).distinct()).distinct(), "sets")
    both = of(texts, unequal, "first", "ltkey").join(few(theirs.select(F.col("doc_id").alias("first"), F.col("tkey").alias("ltkey"), F.col("set").alias("lset"))), ["first", "ltkey"])
    n = F.size(F.array_intersect("set", "lset"))
    near = both.select("doc_id", "first", n.alias("n"), (F.size("set") + F.size("lset") - n).alias("all")).where(f"100 * n >= {percent} * all")
    components = connected_components(cut(links.unionByName(near.select("doc_id", "first")).distinct(), "copies"), "doc_id", "first")
    out = cut(components.select(F.col("node").alias("doc_id"), F.col("component").alias("group"), (F.col("node") != F.col("component")).alias("spare")), "groups")
    discard(totals, first, found, theirs)
    return out


def _grouped(units: DataFrame, groups: DataFrame | None) -> DataFrame:
    """``units`` with the group of their document, null without one, and whether that will be dropped."""
    if groups is None:
        return units.withColumns({"group": F.lit(None).cast("long"), "spare": F.lit(False)})
    g = groups.select(F.col("doc_id").alias("i"), "group", "spare")
    return units.join(few(g), F.col("doc_id") == F.col("i"), "left").drop("i").withColumn("spare", F.coalesce("spare", F.lit(False)))


def _chunks(docs: DataFrame, whole: bool) -> DataFrame:
    """doc_id, tkey, k, s, e, w, chunk (text), h for every chunk with a word and, if ``whole``, every pair, numbered from ``PAIRS``."""
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("tkey"), F.split("text", "\n").alias("lines"))
    # lines are found by their places: a slice would pass over all lines for every chunk
    text = lambda ls, c: F.array_join(F.transform(F.sequence(c["s"], c["e"] - 1), lambda i: F.get(ls, i)), "\n")
    unit = lambda ls, start: lambda c, k: F.struct((k + start).alias("k"), c["s"].alias("s"), c["e"].alias("e"), c["w"].cast("long").alias("w"), text(ls, c).alias("chunk"))
    of = lambda ls, spans, start: F.transform(spans(ls), unit(ls, start))
    cut_up = let(F.col("lines"), lambda ls: F.concat(of(ls, chunk_spans, 0), of(ls, pair_spans, PAIRS)) if whole else of(ls, chunk_spans, 0))
    units = rows.select("doc_id", "tkey", F.explode(cut_up).alias("c")).select("doc_id", "tkey", "c.*").where("w > 0")
    # a pair and a chunk of the same lines are different things
    return units.withColumn("h", F.when(F.col("k") < PAIRS, F.xxhash64("chunk")).otherwise(F.bitwise_not(F.xxhash64("chunk"))))


def _of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents (doc_id, text) that ``keys`` (doc_id, tkey) names."""
    rows, k = docs.select("doc_id", "text"), keys.select(F.col("doc_id").alias("i"), F.col("tkey").alias("t"))
    return rows.join(few(k), rows["doc_id"].eqNullSafe(F.col("i")) & (F.xxhash64("text") == F.col("t")) & rows["text"].isNotNull(), "left_semi")


def _merged(ranges: Column) -> Column:
    """Sorted ranges as ones that don't overlap."""
    none = F.array().cast("array<struct<s:int,e:int>>")

    def step(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["s"].alias("s"), F.greatest(last["e"], r["e"]).alias("e"))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["e"] >= r["s"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(ranges, none, step)


def repeated_lines(docs: DataFrame, whole: bool = True, groups: DataFrame | None = None, copies: bool = False) -> DataFrame:
    """doc_id, tkey and ``gone``, ranges of lines (s, e) that repeat an earlier text, for the documents that have any.

    ``groups`` (doc_id, group, spare), a written table, has the documents that are copies of each other; with ``copies`` they are found here.
    """
    written = cut(_chunks(docs, whole).drop("chunk"), "chunks")
    groups = copy_groups(docs, written) if copies else groups
    chunks = _grouped(written, groups)
    twice = cut(chunks.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "twice")
    # byte comparison: equal hashes are grouped by their text
    holders = cut(chunks.join(few(twice), "h", "left_semi").select("doc_id", "tkey").distinct(), "holders")
    seen = _grouped(_chunks(_of(docs, holders), whole).join(few(twice), "h", "left_semi"), groups)
    texts = seen.groupBy("h", "chunk").agg(F.min(F.struct("spare", "doc_id", "k", "group")).alias("first"), F.count("*").alias("n"))
    by_hash = cut(texts.groupBy("h").agg(F.count("*").alias("n_texts"), F.first("first").alias("first"), F.first("n").alias("n")), "groups")
    sure = by_hash.where("n_texts = 1").select("h", "first")
    # the first one stays whole, so a pair that begins with its last line is no repeat of it
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & ((F.col("k") == F.col("first.k")) | ((F.col("k") > PAIRS) & (F.col("k") == F.col("first.k") + 1)))
    # what a group shares by itself is left to the step that drops its copies; inside one document it is a repeat
    of_group = F.coalesce((F.col("group") == F.col("first.group")) & (F.col("doc_id") != F.col("first.doc_id")), F.lit(False))
    later = lambda df: df.where(~own & ~of_group).select("doc_id", "tkey", "k", "s", "e", "w")
    dups = later(chunks.join(few(sure), "h"))
    clashes = by_hash.where("n_texts > 1").select("h")
    if clashes.head(1):  # different texts under one hash: told apart by their bytes
        by_text = texts.where("n > 1").join(clashes, "h", "left_semi").select("h", "chunk", "first")
        dups = dups.unionByName(later(_grouped(_chunks(docs, whole), groups).join(by_text, ["h", "chunk"])))
    dups = dups.distinct()  # rows repeated with one doc_id and text
    # runs of consecutive repeated chunks: equal k minus rank
    ranked = dups.groupBy("doc_id", "tkey").agg(F.array_sort(F.collect_list(F.struct("k", "s", "e", "w"))).alias("c"))
    run = F.explode(F.transform("c", lambda x, i: F.struct((x["k"] - i).alias("run"), x["s"].alias("s"), x["e"].alias("e"), x["w"].alias("w"))))
    runs = ranked.select("doc_id", "tkey", run.alias("x")).groupBy("doc_id", "tkey", "x.run").agg(F.min("x.s").alias("s"), F.max("x.e").alias("e"), F.sum("x.w").alias("w"))
    runs = runs.where(f"e - s >= 2 or w >= {LONG}")
    gone = runs.groupBy("doc_id", "tkey").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("gone"))
    out = cut(gone.withColumn("gone", _merged(F.col("gone"))) if whole else gone, "gone")
    discard(written, twice, holders, by_hash)
    return out


def drop_repeated_lines(docs: DataFrame, counts: bool = False, drop_emptied: bool = False, whole: bool = True, groups: DataFrame | None = None, copies: bool = False) -> DataFrame:
    """The documents, all columns as they are but ``text``; with ``counts`` also n_lines and n_removed.

    With ``drop_emptied`` the rows of texts that lose their last word go, too.
    """
    i, t, g = free(docs, "_id", "_tkey", "_gone")
    gone = repeated_lines(docs, whole, groups, copies).select(F.col("doc_id").alias(i), F.col("tkey").alias(t), F.col("gone").alias(g))  # a written table
    rows = docs.join(few(gone), docs["doc_id"].eqNullSafe(F.col(i)) & (F.xxhash64(docs["text"]) == F.col(t)) & docs["text"].isNotNull(), "left")
    lines = F.split(docs["text"], "\n")
    stay = F.array_join(F.filter(lines, lambda x, n: ~F.exists(g, lambda r: (n >= r["s"]) & (n < r["e"]))), "\n")
    text = F.when(F.col(g).isNull(), docs["text"]).otherwise(stay)
    if drop_emptied:
        rows = rows.where(F.col(g).isNull() | (F.translate(stay, _BLANKS, "") != ""))
    extra = []
    if counts:
        removed = F.aggregate(g, F.lit(0).cast("long"), lambda a, r: a + r["e"] - r["s"])
        extra = [F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed")]
    return rows.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns], *extra)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


OP8_SQL = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS ln, generate_subscripts(ls, 1) AS i FROM d),
h AS (SELECT *, ('0x' || substr(md5(ln), 1, 8))::BIGINT AS h, len(list_filter(regexp_split_to_array(ln, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS w FROM l),
b AS (SELECT *, (((coalesce(lag(h) OVER o, 0) * 1000003 + h) >> 7) % {DIVISOR} = 0) OR w >= {LONG} OR coalesce(lead(w) OVER o, 0) >= {LONG} AS fin FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, coalesce(sum(fin::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM b),
c AS (SELECT doc_id, k, string_agg(ln, chr(10) ORDER BY i) AS chunk, min(i) AS s, max(i) AS e, sum(w) AS w FROM k GROUP BY doc_id, k HAVING sum(w) > 0),
r AS (SELECT *, count(*) OVER (PARTITION BY chunk) AS n, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, k) AS nth FROM c),
u AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS run FROM r WHERE n > 1 AND nth > 1),
wl AS (SELECT doc_id, i AS s, lead(i) OVER o AS e, row_number() OVER o AS k FROM h WHERE ln <> '' AND w > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
pt AS (SELECT wl.doc_id, k, s, e, string_agg(ln, chr(10) ORDER BY i) AS pair FROM wl JOIN l ON l.doc_id = wl.doc_id AND l.i BETWEEN s AND e WHERE e IS NOT NULL GROUP BY ALL),
pf AS (SELECT *, first_value(doc_id) OVER o AS d1, first_value(k) OVER o AS k1 FROM pt WINDOW o AS (PARTITION BY pair ORDER BY doc_id, k)),
g AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM u GROUP BY doc_id, run HAVING max(e) - min(s) >= 1 OR sum(w) >= {LONG}
  UNION ALL SELECT doc_id, s, e FROM pf WHERE doc_id <> d1 OR k > k1 + 1),
stay AS (SELECT l.doc_id, string_agg(ln, chr(10) ORDER BY i) AS text, count(*) AS n FROM l WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = l.doc_id AND l.i BETWEEN g.s AND g.e) GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(stay.text, '') END AS text, coalesce(len(ls), 0)::BIGINT AS n_lines, (coalesce(len(ls), 0) - coalesce(stay.n, 0))::BIGINT AS n_removed FROM d LEFT JOIN stay USING (doc_id)
"""
