"""Text columns: white space, numbers, dates, labels and cuts. Regular expressions are Unicode-aware."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EDGES = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, EDGES, "")


def text_or_null(c: Column) -> Column:
    """Trimmed text; null where nothing is left."""
    return F.nullif(strip(c.cast("string")), F.lit(""))


def int_or_null(c: Column) -> Column:
    """A whole number written as text; ``true``, fractions and other texts are null."""
    t = strip(c)
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("int"))


def date_or_null(c: Column) -> Column:
    """The date of an ISO date or timestamp, with or without a zone; null for other texts."""
    t = strip(c)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}(?:$|[T ]\d{2}:\d{2}.*$)"), F.substring(t, 1, 10).try_cast("date"))


def words(c: Column) -> Column:
    """Words by white space of any kind."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.coalesce(F.size(words(c)), F.lit(0))


def fold(c: Column) -> Column:
    """Lower case with single blanks, for comparing values."""
    return F.array_join(words(F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))), " ")


# How clause numbers are written, and components that make a year, date or sum instead
NUMBER = r"(?U)^\s*(?:(\d+(?:\.\d+)+)\.?|(\d+)[.)])(?=\s+\S)"
HEADER_NUMBER = r"(?U)^\s*(\d+(?:\.\d+)*)[.)]?(?=\s+\S)"
BARE_NUMBER = r"(?U)^\s*(?:(\d+(?:\.\d+)+)\.?|(\d+)[.)])\s*$"
NO_NUMBER = r"\d{4,}|(?:^|\.)0\d"
SENTENCE_GAP = r"(?U)(?<=[.!?;])\s+(?=[«\"(A-ZА-ЯЁ0-9])|\n+"
TERM_EDGES = r"""(?U)^[\s«»"'*_#.,;:()]+|[\s«»"'*_#.,;:()]+$"""
HEADING_NUMBER = r"(?iuU)^\s*(?:раздел\s+|глава\s+|п\.\s*)?\d+(?:\.\d+)*[.)]?\s*"


def _number(c: Column, pattern: str, groups: int) -> Column:
    found = F.concat(*[F.regexp_extract(c, pattern, g) for g in range(1, groups + 1)])
    return F.when((found != "") & ~found.rlike(NO_NUMBER), found)


def clause_number(c: Column) -> Column:
    """The clause number that starts a text (``1.1. text``, ``1) text``); null if there is none."""
    return _number(c, NUMBER, 2)


def header_number(c: Column) -> Column:
    """The number of a heading, which needs no mark after it; null if there is none."""
    return _number(c, HEADER_NUMBER, 1)


def bare_number(c: Column) -> Column:
    """The number that is all of a text; null if there is more or none."""
    return _number(c, BARE_NUMBER, 2)


def sentences(c: Column) -> Column:
    """Sentences: cut after an end mark before a capital, digit or quote, and at line breaks."""
    return F.filter(F.transform(F.split(c, SENTENCE_GAP), strip), lambda s: s != "")


def normalize_term(c: Column) -> Column:
    """Key of a term: folded, with ё as е, without marks at its ends."""
    t = F.translate(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), "ё", "е")
    return strip(F.regexp_replace(F.regexp_replace(t, TERM_EDGES, ""), r"(?U)\s+", " "))


def normalize_heading(c: Column) -> Column:
    """A heading without its section word, number and edge marks."""
    return normalize_term(F.regexp_replace(F.coalesce(c, F.lit("")), HEADING_NUMBER, ""))


def cut_words(c: Column, limit: int) -> Column:
    """At most ``limit`` words, with a mark where words were cut."""
    w = words(c)
    return F.when(F.size(w) > limit, F.concat(F.array_join(F.slice(w, 1, limit), " "), F.lit("…"))).otherwise(F.array_join(w, " "))


def cut_chars(c: Column, limit: int) -> Column:
    """At most ``limit`` characters, the mark included."""
    return F.when(F.length(c) > limit, F.concat(F.regexp_replace(F.substring(c, 1, limit - 1), r"(?U)\s+$", ""), F.lit("…"))).otherwise(c)


def document_label(kind: Column, number: Column, date: Column) -> Column:
    """``kind №number от dd.mm.yyyy`` of the parts there are; null if there is none."""
    parts = F.concat_ws(
        " ", F.nullif(strip(kind), F.lit("")), F.concat(F.lit("№"), F.nullif(strip(number), F.lit(""))), F.concat(F.lit("от "), F.date_format(date, "dd.MM.yyyy"))
    )
    return F.nullif(parts, F.lit(""))


# Citation marks, numbers with times and dates, clock times, and sums of a clock time and minutes
CITATION = r"\[(?:[SD]\d+|\d+)\]"
NUMBER_OR_TIME = r"\d+(?:[:.,]\d+)*"
CLOCK = r"(?<!\d)(\d{1,2})[:.\-](\d{2})(?!\d)"
CLOCK_SUM = r"(?U)(\d{1,2}):(\d{2})\s*(?:\([^)]*\))?\s*\+\s*(\d{1,3})\s*мин\w*\s*(?:\([^)]*\))?\s*=\s*(\d{1,2}):(\d{2})"


def numbers_in(c: Column) -> Column:
    """Distinct numbers, times, dates and sums of a text, sorted; citation marks aren't numbers."""
    bare = F.regexp_replace(c, CITATION, "")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(bare, F.lit(NUMBER_OR_TIME), F.lit(0))))


def times_in(c: Column) -> Column:
    """Distinct times of a text as ``h:mm``, sorted."""
    pattern = F.lit(CLOCK)
    hours, minutes = F.regexp_extract_all(c, pattern, F.lit(1)), F.regexp_extract_all(c, pattern, F.lit(2))
    return F.array_sort(F.array_distinct(F.zip_with(hours, minutes, lambda h, m: F.concat(h.cast("int").cast("string"), F.lit(":"), m))))


def computed_times(c: Column, starts: Column | None = None) -> Column:
    """Results of sums ``hh:mm + n min = hh:mm`` in a text that hold, as ``h:mm``, sorted; only of sums from given starts, if any are given."""
    pattern = F.lit(CLOCK_SUM)
    parts = F.arrays_zip(*[F.regexp_extract_all(c, pattern, F.lit(i)).alias(f"g{i}") for i in range(1, 6)])
    clock = lambda hours, minutes: F.concat(hours.cast("int").cast("string"), F.lit(":"), minutes)

    def holds(p: Column) -> Column:
        g = [p[f"g{i}"].cast("int") for i in range(1, 6)]
        total = g[0] * 60 + g[1] + g[2]
        right = (F.floor(total / 60) == g[3]) & (total % 60 == g[4])
        return right if starts is None else right & F.array_contains(starts, clock(p["g1"], p["g2"]))

    right = F.filter(parts, holds)
    return F.array_sort(F.array_distinct(F.transform(right, lambda p: clock(p["g4"], p["g5"]))))


def closest(key: Column, others: Column, least: float) -> Column:
    """The place of the text most similar to ``key`` among ``others``, the last of equals; -1 if none reaches ``least``, or there are none."""

    @F.pandas_udf("int")
    def find(keys: pd.Series, lists: pd.Series) -> pd.Series:
        found = []
        for key, texts in zip(keys, lists):
            scored = [(SequenceMatcher(None, key, t).ratio(), i) for i, t in enumerate(texts) if t] if key and texts is not None else []
            best = max(scored, default=(-1.0, -1))
            found.append(best[1] if best[0] >= least else -1)
        return pd.Series(found, dtype="int32")

    return find(key, others)


def candidate_terms(c: Column) -> Column:
    """Abbreviations of a text in order of appearance: runs of two or more capitals, digits allowed after them."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?<![\p{L}\p{N}])(\p{Lu}{2,}[\p{Lu}\p{N}]*)(?![\p{L}\p{N}])"), F.lit(1)))
