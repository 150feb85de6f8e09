r"""Personal data, and the terms that give it away.

Patterns find emails, ip addresses, card and phone numbers; these base spans are the protected entities. A term
(a run of four letters or more) can disclose an entity without naming it: how strongly is estimated over the
corpus. With N documents, n(e) of them naming entity e, n(t) of them using term t, and n(e, t) of them using t
close to e, the pointwise mutual information log2(N n(e, t) / (n(e) n(t))) is compared with what there is to
disclose, the entity's information log2(N / n(e)). In place of the share n(e, t) / n(t) of a term's documents that use it close to
the entity stands its lower confidence bound (Wilson's, ``Z`` standard deviations, one-sided 95 %), so a word that was seen once, or
a few times, proves little: of one sighting in one document 27 % count, of three in three 53 %, of ten in ten 79 %. A term is sensitive, wherever it
stands, if what it discloses reaches ``DISCLOSURE`` of the entity's information, and it was seen in ``SUPPORT`` different surroundings of the
entity, since copies of one text are no evidence. The same rule holds for corpora of any size.

A term that no document uses away from its entity is removed, others are generalised to ``<TERM>``.

Positions come from what lies between matches, so they need no code outside SQL functions. Patterns are the
stated ones with possessive repeats and borders that the leftmost match has anyway, so long runs cost linear time. Sums over matches
are made by blocks, pieces of a text are cut from blocks of it, and terms are found by one pass over the words, so a text with
many entities or terms costs about as much a span as one with few.

Results for odd input, all tested: a null text has no spans; very long texts are searched whole; repeated rows get
equal results and count as one document; an empty table gives an empty table; other columns pass through, whatever
their names. Offsets count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import cut, discard
from .tables import few, free, let, read

#: A span's kind is its place here; the last two are terms to be generalised and to be removed.
KINDS = ("email", "ip", "card", "phone", "term", "term")
LABELS = ("<EMAIL>", "<IP>", "<CARD>", "<PHONE>", "<TERM>", "")
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Characters of surroundings on either side, least different surroundings, least share of an entity's information, standard deviations of the bound.
AROUND, SUPPORT, DISCLOSURE, Z, TERM = 60, 3, 0.8, 1.645, r"\p{L}{4,}"
#: Code points of the blocks that pieces of a text are cut from; terms of a text that are looked for word by word.
BLOCK, FEW_TERMS = 1000, 64
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    at = lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
    value = lambda i: F.when(i % 2 == 0, at(i) * 2 - F.when(at(i) > 4, 9).otherwise(0)).otherwise(at(i))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, "\\."), lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda n: F.when(F.length(n) > 3, F.lit(False)).otherwise(n.cast("int") <= 255)))
    if kind == "card":
        return let(_digits(m), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _test(kind: str):
    return lambda s: _valid(kind, s["value"])


def _is(kind: int):
    return lambda s: s["kind"] == kind


def _before(values: Column, combine, zero: int) -> Column:
    """For each of the ``values`` what ``combine`` makes of those before it; by blocks of about the root of their number, so no step copies what was made so far."""
    start = F.lit(zero).cast("int")
    over = lambda xs: F.aggregate(xs, start, combine)

    def blocks(size: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int")), lambda j: over(F.slice(values, j * size + 1, size)))
        return let(each, lambda es: let(F.transform(es, lambda _, j: over(F.slice(es, F.lit(1), j))), lambda firsts: places(size, firsts)))

    def places(size: Column, firsts: Column) -> Column:
        at = lambda i: F.floor(i / size).cast("int")
        return F.transform(values, lambda _, i: combine(F.get(firsts, at(i)), over(F.slice(values, at(i) * size + 1, i - at(i) * size))))

    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(let(F.ceil(F.sqrt(F.size(values))).cast("int"), blocks))


def _place(gaps: Column, found: Column, kind: Column) -> Column:
    """Spans from the texts between matches and the matches."""
    lengths = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))
    span = lambda before: lambda m, i: let(F.get(before, i) + F.length(F.get(gaps, i)), lambda at: F.struct(at.alias("start"), kind.cast("int").alias("kind"), (at + F.length(m)).alias("end"), m.alias("value")))
    return let(lengths, lambda ls: let(_before(ls, lambda a, x: a + x, 0), lambda before: F.transform(found, span(before))))


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` to ``end`` (exclusive), from the blocks that it touches."""
    first = F.floor(start / BLOCK).cast("int")
    some = F.array_join(F.slice(blocks, first + 1, F.floor((end - 1) / BLOCK).cast("int") - first + 1), "")
    return F.when(end <= start, "").otherwise(F.substring(some, start - first * BLOCK + 1, end - start))


def find(text: Column, pattern: Column, kind: Column) -> Column:
    """All matches as spans; a text without any is searched once."""
    none = F.array().cast(SPAN)
    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda gaps: _place(gaps, found, kind))))


def base_spans(text: Column) -> Column:
    """The base spans of ``text``, sorted by start, then kind."""
    must = {"email": "@", "ip": ".", "card": "", "phone": "+"}
    parts = []
    for i, kind in enumerate(KINDS[:4]):
        spans = F.filter(find(text, F.lit(PATTERNS[kind]), F.lit(i)), _test(kind))
        parts.append(F.when(F.contains(text, F.lit(must[kind])), spans).otherwise(F.array().cast(SPAN)) if must[kind] else spans)
    return F.array_sort(F.concat(*parts))


def _entity(span: Column) -> Column:
    """What is protected: the value without its spelling."""
    return F.when(span["kind"] == 0, F.lower(span["value"])).when(span["kind"] == 1, span["value"]).otherwise(_digits(span["value"]))


def _surroundings(blocks: Column, length: Column, span: Column) -> Column:
    """Whole terms close to the span, lower case, each once."""
    left = _cut(blocks, F.greatest(span["start"] - AROUND, F.lit(0)), span["start"])
    right = _cut(blocks, span["end"], F.least(span["end"] + AROUND, length))
    left = F.when(span["start"] > AROUND, F.regexp_replace(left, r"^[\p{L}]+", "")).otherwise(left)
    right = F.when(length > span["end"] + AROUND, F.regexp_replace(right, r"[\p{L}]+$", "")).otherwise(right)
    return F.array_distinct(F.regexp_extract_all(F.lower(F.concat(left, F.lit(" "), right)), F.lit(TERM), F.lit(0)))


def _mentions(text: Column, base: Column) -> Column:
    """Entity and surroundings of each base span."""
    of = lambda bs, n: lambda s: F.struct(s["kind"].alias("kind"), _entity(s).alias("entity"), _surroundings(bs, n, s).alias("terms"))
    none = F.array().cast("array<struct<kind:int,entity:string,terms:array<string>>>")
    return F.when(F.size(base) == 0, none).otherwise(let(_blocks(text), lambda bs: let(F.length(text), lambda n: F.transform(base, of(bs, n)))))


def _terms(docs: DataFrame) -> DataFrame:
    """One row a document and term: nothing else of the document goes with it. Rows repeated with one doc_id and text give theirs again."""
    text = F.lower("text")
    return docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("tkey"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))).alias("term"))


def _term_counts(docs: DataFrame, wanted: DataFrame, found: DataFrame) -> DataFrame:
    """term and n_t, the documents that use it, of the ``wanted`` terms. All terms are counted before anything is dealt out, since the wanted
    ones may be common; what repeated rows add is taken off again."""
    counted = _terms(docs).groupBy("term").agg(F.count("*").alias("n"))
    if docs.count() > found.count():
        key = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("tkey"))
        again = cut(key.groupBy("doc_id", "tkey").agg(F.count("*").alias("m")).where("m > 1"), "again").select(F.col("doc_id").alias("i"), F.col("tkey").alias("t"), "m")
        extra = docs.join(few(again), F.col("doc_id").eqNullSafe(F.col("i")) & (F.xxhash64("text") == F.col("t"))).dropDuplicates(["doc_id", "t"])
        extra = extra.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"), (1 - F.col("m")).alias("n"))
        counted = counted.unionByName(extra)
        counted = counted.groupBy("term").agg(F.sum("n").alias("n"))
    return counted.withColumnRenamed("n", "n_t").join(few(wanted), "term", "left_semi")


def _least_share(n_et: Column, n_t: Column) -> Column:
    """Wilson's lower bound of n_et / n_t."""
    k, n, z2 = n_et.cast("double"), n_t.cast("double"), Z * Z
    p = k / n
    return (p + z2 / (2 * n) - Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def sensitive_terms(docs: DataFrame, found: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """term, share (of the information of the entity it discloses most of, at least) and ``wide``: whether it stands away from the entity, too."""
    with_term = _near_terms(found)
    entity = ["kind", "entity"]
    mentions = found.where(F.size("mentions") > 0).select("doc_id", "tkey", F.explode("mentions").alias("m")).select("doc_id", "tkey", "m.kind", "m.entity")
    named = mentions.distinct().groupBy(*entity).agg(F.count("*").alias("n_e"))
    joint = with_term.select(*entity, "term", "doc_id", "tkey").distinct().groupBy(*entity, "term").agg(F.count("*").alias("n_et"))
    places = with_term.select(*entity, "term", "place").distinct().groupBy(*entity, "term").agg(F.count("*").alias("places")).where(F.col("places") >= support)
    n = F.lit(float(max(found.count(), 1)))

    def share(n_t: str) -> Column:
        information = F.log2(n / F.col("n_e"))
        return F.when(information > 0, F.log2(n * _least_share(F.col("n_et"), F.col(n_t)) / F.col("n_e")) / information)

    # documents that use a term near any entity are among those that use it: a term that is too common by that
    # count alone, as most are, can't be sensitive, and needn't be looked for in the corpus
    around = with_term.select("term", "doc_id", "tkey").distinct().groupBy("term").agg(F.count("*").alias("n_near"))
    pairs = joint.join(places, [*entity, "term"]).join(named, entity).join(around, "term")
    pairs = cut(pairs.where(share("n_near") >= disclosure), "pairs")
    wanted = cut(pairs.select("term").distinct(), "terms")
    shares = pairs.join(_term_counts(docs, wanted, found), "term").withColumn("share", share("n_t")).where(F.col("share") >= disclosure).select("term", "share", (F.col("n_et") < F.col("n_t")).alias("wide"))
    out = cut(shares.groupBy("term").agg(F.max("share").alias("share"), F.min("wide").alias("wide")), "sensitive")
    discard(pairs, wanted)
    return out


def _near_terms(found: DataFrame) -> DataFrame:
    """doc_id, tkey, kind and entity, place (of surroundings) and each term of the surroundings."""
    near = found.where(F.size("mentions") > 0).select("doc_id", "tkey", F.explode("mentions").alias("m")).select("doc_id", "tkey", F.col("m.kind").alias("kind"), F.col("m.entity").alias("entity"), F.col("m.terms").alias("terms"))
    return near.withColumn("place", F.xxhash64(F.array_sort("terms"))).select("doc_id", "tkey", "kind", "entity", "place", F.explode("terms").alias("term"))


def spans(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """doc_id, tkey and ``spans``: base ones and, of the sensitive terms, those that overlap none of them."""
    docs = docs.select("doc_id", "text")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tkey"), F.coalesce(base_spans(F.col("text")), F.array().cast(SPAN)).alias("base"))
    found = cut(rows.select("doc_id", "tkey", "base", _mentions(F.col("text"), F.col("base")).alias("mentions")).distinct(), "found")
    terms = sensitive_terms(docs, found, disclosure, support)
    if not terms.head(1):
        return found.select("doc_id", "tkey", F.col("base").alias("spans"))
    # terms that stand near their entity only are in documents that are known already; the corpus is read for others alone
    holders = _near_terms(found).select("doc_id", "tkey", "term").join(few(terms.where("not wide").select("term")), "term")
    wide = cut(terms.where("wide").select("term"), "wide")
    if wide.head(1):
        holders = holders.unionByName(_terms(docs).join(few(wide), "term").select("term", "doc_id", "tkey"))
    where = holders.groupBy(F.col("doc_id").alias("i"), F.col("tkey").alias("t")).agg(F.collect_set("term").alias("own"))
    texts = docs.withColumn("tkey", F.xxhash64("text")).join(few(cut(where, "where")), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("tkey") == F.col("t")))
    # a text's few terms are looked for among its words before these become rows; where there are many, rows are joined with them
    held = F.filter(find(F.col("text"), F.lit(r"\p{L}+"), F.lit(4)), lambda x: (F.size("own") > FEW_TERMS) | F.array_contains("own", F.lower(x["value"])))
    words = texts.select("doc_id", "tkey", held.alias("held")).distinct().select("doc_id", "tkey", F.explode("held").alias("x")).withColumn("term", F.lower("x.value"))
    kind = F.when(F.col("wide"), 4).otherwise(5)
    hits = words.join(few(terms.select("term", "wide")), "term").select("doc_id", "tkey", F.struct("x.start", kind.alias("kind"), "x.end", "x.value").alias("x"))
    more = _clear(hits, found).groupBy("doc_id", "tkey").agg(F.collect_list("x").alias("more")).select(F.col("doc_id").alias("i"), F.col("tkey").alias("t"), "more")
    both = found.select("doc_id", "tkey", "base").join(more, F.col("doc_id").eqNullSafe(F.col("i")) & F.col("tkey").eqNullSafe(F.col("t")), "left")
    return both.select("doc_id", "tkey", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(SPAN)))).alias("spans"))


def _clear(hits: DataFrame, found: DataFrame) -> DataFrame:
    """The hits (doc_id, tkey, x) that overlap no base span of their text: of the base spans that begin before a hit's end none reaches into it."""
    base = found.where(F.size("base") > 0).select("doc_id", "tkey", F.explode("base").alias("x"))
    rows = hits.select("doc_id", "tkey", "x", F.col("x.end").alias("at"), F.lit(False).alias("own")).unionByName(base.select("doc_id", "tkey", "x", F.col("x.start").alias("at"), F.lit(True).alias("own")))
    # a base span that begins where a hit ends comes after it
    upto = Window.partitionBy("doc_id", "tkey").orderBy("at", "own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(F.col("own"), F.col("x.end"))).over(upto)
    return rows.withColumn("reach", reach).where(~F.col("own") & (F.coalesce("reach", F.lit(0)) <= F.col("x.start"))).select("doc_id", "tkey", "x")


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents, all columns as they are but ``text``: entities become their kind, terms are generalised or removed."""
    i, t, found = free(docs, "_id", "_tkey", "_spans")
    some = cut(spans(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias(i), F.col("tkey").alias(t), F.col("spans").alias(found)), "spans")
    # a text's row stays where it is unless too many have spans
    rows = docs.join(few(some), docs["doc_id"].eqNullSafe(F.col(i)) & (F.xxhash64(docs["text"]) == F.col(t)) & docs["text"].isNotNull(), "left")
    labels = F.array(*[F.lit(x) for x in LABELS])
    of = F.col(found)

    def cleaned(blocks: Column, before: Column) -> Column:
        """The pieces between spans, each with the next span's label; a span that an earlier one covers adds nothing, one that it overlaps goes on from its end."""
        piece = lambda s, i: let(F.get(before, i), lambda at: F.when(s["end"] <= at, "").otherwise(F.concat(_cut(blocks, at, s["start"]), F.get(labels, s["kind"]))))
        last = F.array_max(F.transform(of, lambda s: s["end"]))
        return F.concat(F.array_join(F.transform(of, piece), ""), _cut(blocks, last, F.length(docs["text"])))

    clean = let(_blocks(docs["text"]), lambda bs: let(F.transform(of, lambda s: s["end"]), lambda ends: let(_before(ends, lambda a, x: F.greatest(a, x), 0), lambda before: cleaned(bs, before))))
    text = F.when(F.col(found).isNull(), docs["text"]).otherwise(clean)
    return rows.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """A row for each document: counts of the base kinds, a checksum of the base spans, and all spans."""
    found = spans(docs)
    kinds = F.array(*[F.lit(k) for k in KINDS])
    listed = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] < 4)
    counts = [F.size(F.filter("spans", _is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    small = found.select(F.col("doc_id").alias("_id"), F.col("tkey").alias("_tkey"), *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("tkey"))
    out = rows.join(small, rows["doc_id"].eqNullSafe(F.col("_id")) & rows["tkey"].eqNullSafe(F.col("_tkey")))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS[:4]], "base_sha256", "spans", "n_spans")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents").select("doc_id", "text"))


_SQL_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_SQL_LUHN = "list_sum(list_transform(range(1, length(g) + 1), lambda i: CASE WHEN i % 2 = 0 THEN list_extract([0, 2, 4, 6, 8, 1, 3, 5, 7, 9], reverse(g)[i]::INT + 1) ELSE reverse(g)[i]::INT END)) % 10 = 0"
_SQL_LEAST = f"((n_et / n_t + {Z * Z / 2!r} / n_t - {Z!r} * sqrt(n_et / n_t * (1 - n_et / n_t) / n_t + {Z * Z / 4!r} / (n_t * n_t))) / (1 + {Z * Z!r} / n_t))"
OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, * FROM (SELECT DISTINCT doc_id, text FROM documents)),
f AS ({" UNION ALL ".join(f"SELECT r, text, {i} AS kind, '{k}' AS name, regexp_extract_all(text, '{p}') AS ms, regexp_split_to_array(text, '{p}') AS gs FROM d WHERE text IS NOT NULL" for i, (k, p) in enumerate(_SQL_PATTERNS.items()))}),
u AS (SELECT r, text, kind, name, unnest(range(1, len(ms) + 1)) AS i, ms, gs FROM f),
v AS (SELECT r, text, kind, name, ms[i] AS m, regexp_replace(ms[i], '[^0-9]', '', 'g') AS g, (coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s FROM u),
b AS (SELECT r, text, kind, name, s, s + length(m) AS e, CASE kind WHEN 0 THEN lower(m) WHEN 1 THEN m ELSE g END AS entity FROM v
  WHERE CASE kind WHEN 0 THEN true WHEN 1 THEN len(list_filter(string_split(m, '.'), lambda x: coalesce(length(ltrim(x, '0')), 0) > 3 OR coalesce(try_cast(x AS DOUBLE), 0) > 255)) = 0
    WHEN 2 THEN length(g) BETWEEN 12 AND 19 AND {_SQL_LUHN} ELSE length(g) BETWEEN 9 AND 15 END),
sr AS (SELECT r, kind, entity, list_sort(list_distinct(regexp_extract_all(lower(
  (CASE WHEN s > {AROUND} THEN regexp_replace(substr(text, s - {AROUND} + 1, {AROUND}), '^\\p{{L}}+', '') ELSE substr(text, 1, s) END) || ' ' ||
  (CASE WHEN length(text) > e + {AROUND} THEN regexp_replace(substr(text, e + 1, {AROUND}), '\\p{{L}}+$', '') ELSE substr(text, e + 1, {AROUND}) END)), '\\p{{L}}{{4,}}'))) AS terms FROM b),
wt AS (SELECT r, kind, entity, terms AS place, unnest(terms) AS term FROM sr),
ne AS (SELECT kind, entity, count(DISTINCT r) AS n_e FROM sr GROUP BY ALL),
et AS (SELECT kind, entity, term, count(DISTINCT r) AS n_et, count(DISTINCT place) AS places FROM wt GROUP BY ALL),
tu AS (SELECT DISTINCT r, unnest(regexp_extract_all(lower(text), '\\p{{L}}{{4,}}')) AS term FROM d),
nt AS (SELECT term, count(*) AS n_t FROM tu GROUP BY term),
sh AS (SELECT DISTINCT term FROM et JOIN ne USING (kind, entity) JOIN nt USING (term), (SELECT greatest(count(*), 1)::DOUBLE AS n FROM d)
  WHERE log2(n / n_e) > 0 AND places >= {SUPPORT} AND log2(n * {_SQL_LEAST} / n_e) / log2(n / n_e) >= {DISCLOSURE}),
wd AS (SELECT d.r, text, regexp_extract_all(text, '\\p{{L}}+') AS ms, regexp_split_to_array(text, '\\p{{L}}+') AS gs FROM d WHERE r IN (SELECT r FROM tu SEMI JOIN sh USING (term))),
wp AS (SELECT r, unnest(range(1, len(ms) + 1)) AS i, ms, gs FROM wd),
ws AS (SELECT r, ms[i] AS m, (coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s FROM wp WHERE lower(ms[i]) IN (SELECT term FROM sh)),
a AS (SELECT r, kind, name, s, e FROM b UNION ALL SELECT r, 4, 'term', s, s + length(m) FROM ws WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.r = ws.r AND b.s < ws.s + length(ws.m) AND ws.s < b.e)),
o AS (SELECT r, count(*) FILTER (WHERE kind = 0) AS n_email, count(*) FILTER (WHERE kind = 1) AS n_ip, count(*) FILTER (WHERE kind = 2) AS n_card, count(*) FILTER (WHERE kind = 3) AS n_phone,
  coalesce(string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind, e) FILTER (WHERE kind < 4), '') AS base, string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind, e) AS spans, count(*) AS n_spans FROM a GROUP BY r)
SELECT documents.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_spans, 0) AS n_spans
FROM documents JOIN d ON d.doc_id IS NOT DISTINCT FROM documents.doc_id AND d.text IS NOT DISTINCT FROM documents.text LEFT JOIN o USING (r)
"""
