"""Tokenizers and blocking keys: expressions over strings and attribute lists.

Attributes are ``array<struct<key, value>>``; text is split at characters that are no ASCII letter or digit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = r"[\W_]"
NGRAM, SUFFIX, EXTENDED_SHARE = 3, 2, 0.95
ATTRIBUTES = "array<struct<key:string,value:string>>"


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` computed once a row: inside a lambda, an expression is computed again each time."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def text_tokens(text: Column) -> Column:
    """Lower-cased tokens in order, without empty ones: one row's work in compiled code, no lambda."""
    return F.array_remove(F.split(F.lower(text), f"{SEPARATORS}+"), "")


def has_token(text: Column) -> Column:
    """Whether :func:`text_tokens` finds any, without cutting the text up."""
    return F.lower(text).rlike("[a-z0-9]")


def usable(attributes: Column, exclude: Iterable[str] = ()) -> Column:
    """Attributes that have a value and aren't excluded."""
    exclude = list(exclude)
    return F.filter(attributes, lambda a: (F.trim(a["value"]) != "") & (~a["key"].isin(exclude) if exclude else F.lit(True)))


def tokens(attributes: Column, exclude: Iterable[str] = ()) -> Column:
    """Tokens of all attribute values."""
    return F.flatten(F.transform(usable(attributes, exclude), lambda a: text_tokens(a["value"])))


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def runs(items: Column, n: int, separator: str = "") -> Column:
    """Runs of ``n`` neighbouring items, joined; fewer items are one run. An item is found by its place at once, so long lists take linear time."""

    def each(xs: Column) -> Column:
        run = lambda x, i: F.concat_ws(separator, x, *[F.get(xs, i + k) for k in range(1, n)])
        return F.when(F.size(xs) <= n, F.array(F.array_join(xs, separator))).otherwise(F.slice(F.transform(xs, run), 1, F.greatest(F.size(xs) - (n - 1), F.lit(1))))

    return let(items, each)


def windows(token: Column, n: int) -> Column:
    """Runs of ``n`` characters; a shorter string is itself."""
    short = F.transform(F.sequence(F.lit(1), F.greatest(F.length(token) - (n - 1), F.lit(1))), lambda i: F.substring(token, i, F.lit(n)))
    return F.when(F.length(token) <= 64, short).otherwise(runs(characters(token), n))  # finding a place in a string takes longer the further it is


def ngrams(attributes: Column, exclude: Iterable[str] = (), n: int = NGRAM) -> Column:
    return F.flatten(F.transform(tokens(attributes, exclude), lambda t: windows(t, n)))


def token_suffixes(token: Column, least: int = SUFFIX) -> Column:
    """All suffixes of ``least`` characters or more; a shorter token is itself."""
    return F.when(F.length(token) < least, F.array(token)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(token) - least + 1, F.lit(1))), lambda i: F.substring(token, i, F.length(token))))


def suffixes(attributes: Column, exclude: Iterable[str] = (), least: int = SUFFIX) -> Column:
    return F.flatten(F.transform(tokens(attributes, exclude), lambda t: token_suffixes(t, least)))


def token_substrings(token: Column, least: int = SUFFIX) -> Column:
    """All substrings of ``least`` characters or more, and the token."""
    sized = lambda n: F.transform(F.sequence(F.lit(1), F.length(token) - n + 1), lambda i: F.substring(token, i, n))
    every = F.flatten(F.transform(F.sequence(F.lit(least), F.greatest(F.length(token), F.lit(least))), sized))
    return F.when(F.length(token) <= least, F.array(token)).otherwise(F.array_distinct(every))


def substrings(attributes: Column, exclude: Iterable[str] = (), least: int = SUFFIX) -> Column:
    return F.flatten(F.transform(tokens(attributes, exclude), lambda t: token_substrings(t, least)))


def token_extended_qgrams(token: Column, n: int = NGRAM, share: float = EXTENDED_SHARE) -> Column:
    """Concatenations, in order, of all q-grams and of any choice of at least ``share`` of them, one at least.

    No q-gram is left out of account. Up to 20 of them one at most may be missing, so keys are as many as q-grams; beyond,
    two and more may be, and the number of keys grows with the binomial: 742 from 38 q-grams, 1.7 million from 80.
    """

    def keys(grams: Column) -> Column:
        may_miss = F.size(grams) - F.greatest(F.floor(F.size(grams) * F.lit(share)).cast("int"), F.lit(1))
        begun = F.array(F.struct(F.lit("").alias("s"), F.lit(0).alias("missing")))

        def step(made: Column, gram: Column) -> Column:
            with_it = F.transform(made, lambda m: F.struct(F.concat(m["s"], gram).alias("s"), m["missing"].alias("missing")))
            without = F.transform(F.filter(made, lambda m: m["missing"] < may_miss), lambda m: F.struct(m["s"].alias("s"), (m["missing"] + 1).alias("missing")))
            return F.concat(with_it, without)

        return F.array_distinct(F.transform(F.aggregate(grams, begun, step), lambda m: m["s"]))

    return let(windows(token, n), keys)


def extended_qgrams(attributes: Column, exclude: Iterable[str] = (), n: int = NGRAM) -> Column:
    return F.flatten(F.transform(tokens(attributes, exclude), lambda t: token_extended_qgrams(t, n)))


def keyed_ngrams(attributes: Column, exclude: Iterable[str] = (), n: int = NGRAM) -> Column:
    """N-grams of whole values, each with its attribute's name before it."""
    grams = lambda a: F.transform(windows(F.replace(F.lower(F.trim(a["value"])), F.lit(" "), F.lit("_")), n), lambda g: F.concat(a["key"], F.lit("_"), g))
    return F.flatten(F.transform(usable(attributes, exclude), grams))


def character_codes(token: Column) -> Column:
    """The code of each character."""
    return F.transform(characters(token), lambda c: F.ascii(c))


# The English stop words of Spark's StopWordsRemover, which results have to agree with.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after above below to from up down in out on off over under
again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t
can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've
we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't
cannot could here's how's let's ought that's there's what's when's where's who's why's would
""".split()


def is_good_word(token: Column) -> Column:
    """All ASCII letters or all digits, and no stop word."""
    return token.rlike("^([A-Za-z]+|[0-9]+)$") & ~token.isin(STOP_WORDS)


def token_set(attributes: Column) -> Column:
    return F.array_distinct(tokens(attributes))


def character_ngrams(attributes: Column, n: int = 2) -> Column:
    """Character n-grams of the joined tokens, across their borders."""
    return let(characters(F.array_join(token_set(attributes), "")), lambda cs: F.when(F.size(cs) == 0, F.array().cast("array<string>")).otherwise(runs(cs, n)))


def word_ngrams(words: Column, n: int = 1) -> Column:
    """Runs of ``n`` words; fewer words are one run."""
    return runs(words, n, " ")


def attribute_values(attributes: Column, key: str, separator: str = " ") -> Column:
    """All values of an attribute in one string."""
    return F.array_join(F.transform(F.filter(attributes, lambda a: a["key"] == key), lambda a: a["value"]), separator)
