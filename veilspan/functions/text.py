"""Column expressions over text: folding, canonical form, tokens, counting, clipping."""
from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions.regexes import WS_CHARS, WS_RUN, rx


def _fold_table() -> tuple[str, str]:
    """Every character whose decomposed, mark-free, lower-case form is one other character."""
    src, dst = [], []
    for cp in [*range(0x41, 0xD800), *range(0xE000, 0xFFFE)]:
        ch = chr(cp)
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if not unicodedata.combining(c)).lower()
        if len(base) == 1 and base != ch:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


_FOLD_FROM, _FOLD_TO = _fold_table()


def fold(c: Column) -> Column:
    """Lower case without accents, one character out per character in, so offsets stay valid."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, _FOLD_FROM, _FOLD_TO))


def normalize(c: Column) -> Column:
    """`fold` that also drops loose combining marks (may shorten the text)."""
    return fold(F.regexp_replace(c, r"[\u0300-\u036f]", ""))


_DIGIT_SEP = rx(r"(\d)[\s.,'](?=\d{3}(?!\d))")


def collapse_digit_separators(c: Column) -> Column:
    """"15,000", "15.000", "15 000" → "15000".

    One pass is the fixpoint: a separator only goes when exactly three digits follow it, and
    joining groups never makes a shorter run three digits long.
    """
    return F.regexp_replace(c, _DIGIT_SEP, "$1")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, WS_RUN, " "))


def canonical(c: Column) -> Column:
    return squeeze(collapse_digit_separators(normalize(c)))


def amount_haystack(c: Column) -> Column:
    """Text form in which the written forms of an amount are searched (not trimmed)."""
    return F.regexp_replace(collapse_digit_separators(normalize(c)), WS_RUN, " ")


def digit_runs(c: Column) -> Column:
    """Digits with the punctuation between them removed: "+502 55 55 12 34" → "+50255551234"."""
    return F.regexp_replace(c, rx(r"(\d)[\s.\-/()+]+(?=\d)"), "$1")


WORD = "[\\p{L}\\p{N}]+(?:[-'’][\\p{L}\\p{N}]+)*"


def word_count(c: Column) -> Column:
    """Unicode words, a hyphen or apostrophe joins."""
    return F.regexp_count(c, F.lit(WORD))


def token_count(c: Column) -> Column:
    """Whitespace-separated tokens."""
    return F.regexp_count(c, F.lit(rx(r"\S+")))


def words_of(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def clip(c: Column, n: int) -> Column:
    """First n characters, with an ellipsis when something was cut off."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def quote_regex(c: Column) -> Column:
    """A literal for use inside a pattern column."""
    return F.regexp_replace(c, r"[.*+?^${}()|\[\]\\]", r"\\$0")


def split_items(c: Column) -> Column:
    """Free text → sentences / bullet items longer than three characters."""
    parts = F.split(c, rx(r"\n+|(?<=[.;!?])\s+|\s+[•·*-]\s+"), -1)
    cleaned = F.transform(parts, lambda s: js_trim(F.regexp_replace(s, rx(r"^[\s•·*\-–—\d.)]+"), "")))
    return F.filter(cleaned, lambda s: F.length(s) > 3)


def sentences(c: Column, splitter: str) -> Column:
    """Trimmed, non-empty pieces of a text."""
    return F.filter(F.transform(F.split(c, splitter, -1), js_trim), lambda s: s != "")


def first_n(arr: Column, n: int | Column) -> Column:
    return F.slice(arr, 1, n)


def array_first(arr: Column) -> Column:
    return F.get(arr, F.lit(0))
