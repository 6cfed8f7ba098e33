"""Text functions as column expressions. Null stays null unless a function says otherwise."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that say nothing by themselves.
STOPWORDS = ["en", "of", "de", "het", "een", "in", "op", "voor", "van", "the", "and", "or", "for", "to", "at"]
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
#: What an accent is once a text is decomposed.
COMBINING = re.compile("[\u0300-\u036f]+")
PHONE = r"\+?[0-9][0-9 ().-]{7,}[0-9]"


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once a row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def collapse(text: Column) -> Column:
    """White space at the ends removed, runs of it one space."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def dedupe_key(text: Column) -> Column:
    """Collapsed and in lower case."""
    return F.lower(collapse(text))


def normalize_words(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def words_of(text: Column) -> Column:
    """The words of ``normalize_words``; an empty array for null."""
    found = normalize_words(F.coalesce(text, F.lit("")))
    return F.when(found == "", F.array().cast("array<string>")).otherwise(F.split(found, " "))


def tokens_of(text: Column) -> Column:
    """Words of two or more characters that are not stop words."""
    return F.filter(words_of(text), lambda w: (F.length(w) >= 2) & ~w.isin(STOPWORDS))


@F.pandas_udf(StringType())
def fold_accents(text: pd.Series) -> pd.Series:
    """Without combining accents, in lower case. There is no built-in decomposition, so this one runs in Arrow batches."""

    def one(value: str | None) -> str | None:
        if value is None:
            return None
        return value.lower() if value.isascii() else COMBINING.sub("", unicodedata.normalize("NFD", value)).lower()

    return text.map(one, na_action="ignore")


def slugify(text: Column, longest: int = 80) -> Column:
    """Folded, other characters as single hyphens, at most ``longest`` characters."""
    parts = F.regexp_replace(F.regexp_replace(fold_accents(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.substring(parts, 1, longest)


def strip_html(text: Column) -> Column:
    return collapse(F.regexp_replace(text, "<[^>]+>", " "))


def null_if_longer(text: Column, longest: int) -> Column:
    """Trimmed; null if empty or longer than ``longest``."""
    t = F.trim(text)
    return F.when((F.length(t) > 0) & (F.length(t) <= longest), t)


def cut_to(text: Column, longest: int) -> Column:
    """Trimmed and cut; null if empty."""
    t = F.trim(text)
    return F.when(F.length(t) > 0, F.substring(t, 1, longest))


def join_distinct(values: Column, separator: str = ", ") -> Column:
    """Distinct values that are not null, in order; null if there are none."""
    return F.nullif(F.array_join(F.array_distinct(F.array_compact(values)), separator), F.lit(""))


def strip_url_queries(text: Column) -> Column:
    """URLs inside a text lose query and fragment."""
    return F.regexp_replace(text, r"(https?://[^\s?#]+)[?#]\S*", "$1")


def after_label(text: Column, labels: list[str]) -> Column:
    """What follows ``Label:`` up to a sentence end or two spaces; null if no label stands in the text."""
    names = "|".join(re.escape(x) for x in labels)
    found = F.regexp_extract(text, rf"(?i)(?:^|[\s.;])(?:{names})\s*:\s*(.*?)(?=[.!?;](?:\s|$)|\s\s|\n|$)", 1)
    return F.nullif(F.trim(found), F.lit(""))


def first_match(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))


def sentences(text: Column, longest: int = 400) -> Column:
    """Sentences and lines of three or more characters, each cut at ``longest``."""
    parts = F.transform(F.split(text, r"(?<=[.!?;])\s+|[\n\r•·|]+"), collapse)
    return F.transform(F.filter(parts, lambda s: F.length(s) >= 3), lambda s: F.substring(s, 1, longest))


def quote_around(text: Column, start: Column, length: Column, radius: int = 80) -> Column:
    """The text around a match (``start`` from 1), with an ellipsis on each side that was cut."""
    first = F.greatest(start - radius, F.lit(1))
    last = F.least(start + length + radius - 1, F.length(text))
    return F.concat(
        F.when(first > 1, F.lit("…")).otherwise(F.lit("")),
        F.trim(F.substring(text, first, last - first + 1)),
        F.when(last < F.length(text), F.lit("…")).otherwise(F.lit("")),
    )


def term_pattern(term: str) -> str:
    """A regular expression for one term: a whole word; a plural ending from five letters on, a compound's tail from eight."""
    body = r"\s+".join(re.escape(w) for w in term.lower().split())
    tail = "" if len(term) <= 4 else (r"(?:[a-z]*)" if len(term) >= 8 else r"(?:en|s|es|n)?")
    return rf"(?<![\p{{L}}\p{{N}}]){body}{tail}(?![\p{{L}}\p{{N}}])"


def matches_term(word: Column, term: str) -> Column:
    """Equal, a compound that starts with the term, or a word of the same family (a long shared beginning)."""
    tests = [word == term]
    if len(term) >= 5:
        tests.append((F.length(word) > len(term)) & F.startswith(word, F.lit(term)))
    share = max(7, -(-7 * len(term) // 10))
    if share <= len(term):
        tests.append((F.length(word) >= share) & (F.left(word, F.lit(share)) == term[:share]))
    return reduce(or_, tests)


def term_matches(word: Column, term: str) -> Column:
    """Equal, or one begins with the other: the term has five or more characters, the word four or more."""
    near = F.startswith(word, F.lit(term)) | F.startswith(F.lit(term), word)
    long_enough = (F.length(word) >= 4) & F.lit(len(term) >= 5)
    return (word == term) | (long_enough & near)


def phrase_count(words: Column, phrase: list[str]) -> Column:
    """Places where the words of ``phrase`` stand in a row."""
    here = F.filter(
        F.sequence(F.lit(0), F.size(words) - len(phrase)),
        lambda i: reduce(and_, (F.get(words, i + k) == p for k, p in enumerate(phrase))),
    )
    return F.when(F.size(words) >= len(phrase), F.size(here)).otherwise(F.lit(0))
