"""Names of employers: when a text can be one, where a page names one, and which of several counts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse, once

#: Labels of an employer in a text, small words that may open a name, and what no name begins with or holds.
EMPLOYER_LABELS = "werkgever organisatie employer company bedrijf".split()
NAME_PREFIXES = "de het van von der den ten ter la le the".split()
NAVIGATION = [
    "solliciteer", "solliciteren", "apply", "bekijk", r"lees\s+meer", r"meer\s+(?:informatie|info|lezen)", "terug", "home", "menu", "contact", "login", "inloggen", "zoek", "zoeken", "vacatures?",
    r"alle\s+vacatures", r"over\s+ons", r"naar\s+overzicht", "klik", "deel", "delen", "print", "bewaar", "share", r"more\s+information", r"read\s+more", "back",
]
READER_WORDS = "je jij jouw jou wij we ons onze ik mijn you your our".split()
JOB_WORDS = [
    "fte", "uur", "uren", r"per\s+(?:week|maand|jaar|uur)", "salaris", "ervaring", "opleiding", "vacature", "solliciteer", "functie", "werkzaamheden", "taken",
]
JOB_BEGINNINGS = ["€", "(?<![A-Za-z0-9_])verantwoordelijk"]
LEGAL_ENDINGS = [r"[A-Za-z]{1,2}\.[A-Za-z]{1,2}\.", r"(?:inc|ltd|co|corp|bv|nv|gmbh|e\.a|e\.d|o\.a|c\.s|a\.o)\."]
#: Class and id parts that mark an employer's name, words after "over" that name none, and the line and cut of a label in a text.
NAME_MARKS = "employer-name employer__name employername company-name company__name companyname organization-name organisation-name organization__name organisation__name hiring-organization hiring-organisation".split()
NO_NAME_AFTER_OVER = "ons onze mij mijzelf jou jouw jezelf de het een deze dit die dat werken us our you the this these those".split()
LABEL_LINE = rf"(?im)^[ \t]*(?:[-•*·▪]\s*)?(?:{'|'.join(EMPLOYER_LABELS)})[ \t]*(?::|[ \t][-–—][ \t])[ \t]*(\S[^\n\r]*)$"
VALUE_CUT = r";|\s{3,}|\t|\s\|\s"
ABOUT_HEADING = r"(?i)^(?:over|about)\s+(\S.{1,140})$"
LOGO_OF = [r"(?i)^\s*logo\s+(?:voor|van|of|for)\s+(\S.*?)\s*$", r"(?i)^\s*(\S.*?)\s+logo\s*$"]
LONGEST, LONGEST_IN_TEXT, WORDS_IN_TEXT, WORDS_OF_PROSE = 150, 90, 9, 12


def _has(value: Column, pattern: str) -> Column:
    return F.rlike(value, F.lit(pattern))


def _whole(words: list[str]) -> str:
    return rf"(?i)(?<![A-Za-z0-9_])(?:{'|'.join(words)})(?![A-Za-z0-9_])"


_LEGAL_END = rf"(?i)(?<![A-Za-z0-9_])(?:{'|'.join(LEGAL_ENDINGS)})$"
_LEGAL_INSIDE = rf"(?i)(?<![A-Za-z0-9_])(?:{'|'.join(LEGAL_ENDINGS)})(?=\s)"

#: What refuses a name, by name of the check: the strengths of evidence it applies to, and the test of a collapsed text.
#: ``explicit``: a label or an element names the employer; ``text``: found in running text; ``structured``: a block that the title confirms.
EXPLICIT, IN_TEXT, STRUCTURED = "explicit", "text", "structured"
REFUSALS: dict[str, tuple[set[str], Callable[[Column], Column]]] = {
    "too short or too long": ({EXPLICIT, IN_TEXT, STRUCTURED}, lambda v: ~F.length(v).between(2, LONGEST)),
    "navigation": ({EXPLICIT, IN_TEXT, STRUCTURED}, lambda v: _has(v, rf"(?i)^(?:{'|'.join(NAVIGATION)})(?![A-Za-z0-9_])")),
    "asks or announces": ({EXPLICIT, STRUCTURED}, lambda v: _has(v, "[:?!]$")),
    "a paragraph": ({EXPLICIT}, lambda v: (F.size(F.split(v, " ")) > WORDS_OF_PROSE) & _has(v, "[.!?]")),
    "long for a text": ({IN_TEXT}, lambda v: (F.length(v) > LONGEST_IN_TEXT) | (F.size(F.split(v, " ")) > WORDS_IN_TEXT)),
    "nothing that names": ({IN_TEXT, STRUCTURED}, lambda v: ~_has(v, r"[\p{Lu}\p{N}]")),
    "a small beginning": ({IN_TEXT, STRUCTURED}, lambda v: _has(v, r"^\p{Ll}") & ~F.lower(F.substring_index(v, " ", 1)).isin(NAME_PREFIXES)),
    "marks of a sentence": ({IN_TEXT}, lambda v: _has(v, "[:;?!]")),
    "marks inside a block": ({STRUCTURED}, lambda v: _has(v, "[;?!]")),
    "several sentences": ({IN_TEXT}, lambda v: _has(v, r"\.\s+\S")),
    "several sentences but for legal forms": ({STRUCTURED}, lambda v: _has(F.regexp_replace(v, _LEGAL_INSIDE, ""), r"\.\s+\S")),
    "the end of a sentence": ({IN_TEXT}, lambda v: _has(v, r"\.$") & ~_has(v, _LEGAL_END)),
    "speaks to the reader": ({IN_TEXT, STRUCTURED}, lambda v: _has(v, _whole(READER_WORDS))),
    "speaks of the job": ({IN_TEXT, STRUCTURED}, lambda v: _has(v, _whole(JOB_WORDS)) | _has(v, rf"(?i){'|'.join(JOB_BEGINNINGS)}")),
}


def without_stop(name: Column) -> Column:
    """Without one full stop at the end, unless it is that of an abbreviation or legal form."""
    return F.when(_has(name, r"\.$") & ~_has(name, _LEGAL_END), F.regexp_replace(name, r"\s*\.$", "")).otherwise(name)


def company_name(raw: Column, strength: str) -> Column:
    """The collapsed name if no check of its strength refuses it, else null."""
    tests = [test for strengths, test in REFUSALS.values() if strength in strengths]
    value = once(collapse(raw), without_stop) if strength == STRUCTURED else collapse(raw)
    return once(value, lambda v: F.when(~reduce(or_, (test(v) for test in tests)), v))


def match_key(name: Column) -> Column:
    """A name without case, repeated spaces and full stops at the end of a word."""
    return F.regexp_replace(F.lower(collapse(name)), r"\.(?=\s|$)", "")


def company_from_text(text: Column) -> Column:
    """The first usable name after an employer's label that opens a line, with a colon or a spaced dash between."""
    found = F.regexp_extract_all(text, F.lit(LABEL_LINE), 1)
    names = F.transform(found, lambda v: company_name(F.get(F.split(v, VALUE_CUT), F.lit(0)), IN_TEXT))
    return F.get(F.array_compact(names), F.lit(0))


def choose_company(json_ld: Column, microdata: Column, label: Column, block: Column, text: Column, declared: Column) -> Column:
    """Struct of the strongest usable name and its source; ``none`` where there is none."""
    plain = lambda c: F.nullif(collapse(c), F.lit(""))
    ranked = [
        (plain(json_ld), "json_ld"), (plain(microdata), "microdata"), (company_name(label, EXPLICIT), "explicit_label"),
        (company_name(block, EXPLICIT), "organization_block"), (company_name(text, IN_TEXT), "text_fallback"), (company_name(declared, IN_TEXT), "page_metadata"),
    ]
    pairs = F.array(*(F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(s).alias("source"))) for v, s in ranked))
    none = F.struct(F.lit(None).cast("string").alias("value"), F.lit("none").alias("source"))
    return F.coalesce(F.get(F.array_compact(pairs), F.lit(0)), none)
