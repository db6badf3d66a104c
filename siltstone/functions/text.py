"""Text analysis: one set of rules, as Spark columns for stored text and in Python for query text."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.errors import invalid

ANALYZERS = ("default", "simple", "ascii_fold", "keyword", "english_basic")
#: What isn't a letter, letter-like mark or number separates words.
SEPARATOR = r"[^\p{IsAlphabetic}\p{N}]"
STOPWORDS = frozenset("with will was to this they these there then their the that such or on of not no it is into in if for by but be at as are and an a".split())
_BASES = {
    "a": "ąăāåäãâáà", "c": "čċĉćç", "e": "ěęėĕēëêéè", "i": "ıįĭīïîíì", "n": "ňņńñ",
    "o": "őŏōøöõôóò", "u": "ųűůŭūüûúù", "y": "ÿý",
}
_FROM = "".join(_BASES.values())
_TO = "".join(base * len(chars) for base, chars in _BASES.items())
_DOUBLE = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"))


def resolve(name: str | None) -> str:
    """The analyzer of that name; none means the default one."""
    name = name or "default"
    if name not in ANALYZERS:
        raise invalid(f"unknown analyzer '{name}'; there are: {', '.join(ANALYZERS)}")
    return "default" if name == "simple" else name


# --------------------------------------------------------------------------- columns


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits. Splitting comes first: lower-casing can make new marks."""
    return F.transform(F.filter(F.split(text, SEPARATOR + "+"), lambda x: x != ""), F.lower)


def fold(token: Column) -> Column:
    """Latin letters without their marks."""
    token = F.translate(token, _FROM, _TO)
    for old, new in _DOUBLE:
        token = F.replace(token, F.lit(old), F.lit(new))
    return token


def fold_plural(token: Column) -> Column:
    """Regular English plurals in the singular; words like 'lens' or 'class' stay."""
    n = F.length(token)
    return (
        F.when(~token.rlike("^[a-z]{4,}$"), token)
        .when(token.rlike("^..+ies$"), F.regexp_replace(token, "ies$", "y"))
        .when(token.rlike("([sxz]|ch|sh)es$") & (n >= 4), F.regexp_replace(token, "es$", ""))
        .when(token.endswith("s") & ~token.rlike("(ss|us|is|ns)$"), F.regexp_replace(token, "s$", ""))
        .otherwise(token)
    )


def keyword_term(text: Column) -> Column:
    """All letters and digits of a text as one lower-cased term."""
    return F.lower(F.regexp_replace(text, SEPARATOR, ""))


def map_terms(terms: Column, analyzer: str) -> Column:
    """Default terms as the analyzer has them."""
    if analyzer == "ascii_fold":
        return F.transform(terms, fold)
    if analyzer == "english_basic":
        stop = F.array(*[F.lit(w) for w in sorted(STOPWORDS)])
        return F.transform(F.filter(terms, lambda x: ~F.array_contains(stop, x)), fold_plural)
    return terms


def terms(text: Column, analyzer: str = "default") -> Column:
    """The terms of a text, in order and with repeats; empty for null."""
    if analyzer == "keyword":
        term = keyword_term(text)
        found = F.when(term != "", F.array(term))
    else:
        found = map_terms(tokens(text), analyzer)
    return F.coalesce(found, F.array().cast("array<string>"))


# --------------------------------------------------------------------------- query text


@functools.cache
def _word(c: str) -> bool:
    return c.isalnum() or c.isalpha()


def query_tokens(text: str) -> list[str]:
    return [run.lower() for run in "".join(c if _word(c) else " " for c in text).split(" ") if run]


def query_plural(token: str) -> str:
    if not re.fullmatch("[a-z]{4,}", token):
        return token
    for pattern, ending in ((r"(..+)ies", "y"), (r"(.*(?:[sxz]|ch|sh))es", "")):
        if m := re.fullmatch(pattern, token):
            return m[1] + ending
    return token[:-1] if token.endswith("s") and not token.endswith(("ss", "us", "is", "ns")) else token


def query_fold(token: str) -> str:
    token = token.translate(str.maketrans(_FROM, _TO))
    for old, new in _DOUBLE:
        token = token.replace(old, new)
    return token


def query_terms(text: str, analyzer: str = "default") -> list[str]:
    """Distinct terms of a query, in order."""
    found = query_tokens(text)
    if analyzer == "keyword":
        found = ["".join(found)] if found else []
    elif analyzer == "ascii_fold":
        found = [query_fold(t) for t in found]
    elif analyzer == "english_basic":
        found = [query_plural(t) for t in found if t not in STOPWORDS]
    return list(dict.fromkeys(found))


def offsets(text: str, analyzer: str = "default") -> list[tuple[str, int, int]]:
    """(term, start, end) of each token; positions are UTF-8 bytes of the text."""
    if analyzer == "keyword":
        inner = text.strip()
        if not inner:
            return []
        start = len(text[: len(text) - len(text.lstrip())].encode())
        return [(inner.lower(), start, start + len(inner.encode()))]
    found, run, at, begin = [], "", 0, 0
    for c in [*text, ""]:
        if c and _word(c):
            if not run:
                begin = at
            run += c
        elif run:
            found.append((run.lower(), begin, at))
            run = ""
        at += len(c.encode())
    if analyzer == "ascii_fold":
        return [(query_fold(t), s, e) for t, s, e in found]
    if analyzer == "english_basic":
        return [(query_plural(t), s, e) for t, s, e in found if t not in STOPWORDS]
    return found
