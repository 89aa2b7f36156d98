"""Features that go beyond one expression: date forms, preference words, distinctive words, a hashing embedder."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from recollex.functions.text import ENTITY_STOP_WORDS, QUERY_STOP_WORDS

# English months, words of preference, and words that tell nothing about a text.
MONTHS = "january february march april may june july august september october november december".split()
PREFERENCE = (
    r"(?i)\b(?:prefer(?:red|ring|s)?|lik(?:e[ds]?|ing)|lov(?:e[ds]?|ing)|enjoy(?:ed|ing|s)?|interested\s+in|looking\s+(?:for|to|into)|want(?:ed|ing|s)?|need(?:ed|ing|s)?|"
    r"favou?rite|recommend(?:ed|ing|s)?|upgrad(?:e[ds]?|ing)|chos(?:e|en)|choos(?:e|ing)|pick(?:ed|ing|s)?|bought|purchas(?:e[ds]?|ing)|got\s+a|switch(?:ed|ing)\s+to|"
    r"start(?:ed|ing)\s+using|been\s+using|try(?:ing|ied)\s+out|lean(?:ing|s|ed)?\s+towards?)\b"
)
PLAIN_WORDS = (
    "i me my we our you your it its they the a an and or but in on at to for of is am are was were be been being have has had do does did will would could should can may might "
    "shall not no so if that this these those some any all more much very just also too than then now here there when where how what which who with from about into by as up out new "
    "really because something things think know want need looking interested tried trying started been using recently currently actually going getting got one ones good great best"
).split()

# What counts as a word of a preference, as a distinctive word, and as a word that names a thing.
WISHED = r"\b([A-Za-z0-9][\w\-]{2,})\b"
DISTINCTIVE = r"(?<![a-z0-9_])([a-z0-9][a-z0-9_\-]{2,})(?![a-z0-9_])"
NAMED = r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+|[A-Z]{2,}|[a-zA-Z][\w\-]{3,})\b"
# Relative expressions that are searched for as they stand.
RELATIVE = (
    r"(?i)\b(last\s+(?:week|month|year)|(?:a\s+)?(?:few|couple\s+of)\s+(?:weeks|months|years)\s+ago|(?:the\s+)?(?:previous|prior|following|next)\s+(?:week|month|year|day)|"
    r"(?:two|three|four|five|six|seven|eight|nine|ten)\s+(?:days?|weeks?|months?|years?)\s+(?:ago|later|before|after))\b"
)
_NAME = "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in MONTHS)
_MONTH_FIRST = rf"(?i)\b(?:{_NAME})\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}\b"
_DAY_FIRST = rf"(?i)\b\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{_NAME})\s+\d{{4}}\b"
_ISO = r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b"
_SLASHED = r"\b\d{1,2}/\d{1,2}/\d{4}\b"


def _date_forms(year: Column, month: Column, day: Column) -> Column:
    """The ways a day may be written in a question; none for a month, day or year out of range."""
    name = F.element_at(F.array(*map(F.lit, MONTHS)), F.when(month.between(1, 12), month).otherwise(1))
    y, m, d, short = year.cast("string"), month.cast("string"), day.cast("string"), F.substring(name, 1, 3)
    forms = [
        F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.concat_ws(" ", name, d, y), F.concat_ws(" ", short, d, y), F.concat_ws(" ", d, name, y), F.concat_ws(" ", d, short, y),
        F.concat_ws("/", m, d, y), F.concat_ws("/", d, m, y), F.concat_ws(" ", name, y),
    ]
    fits = month.between(1, 12) & day.between(1, 31) & year.between(1900, 2100)
    return F.when(fits, F.array(*forms)).otherwise(F.array().cast("array<string>"))


def date_terms(text: Column, most: int | None = 40) -> Column:
    """Every written form of the dates in a text and its relative expressions, each once, in order; the first ``most``.

    Named dates come first, then year-first ones, then a/b/Y in both readings.
    A null text has none.
    """
    number = lambda s, i: F.get(F.filter(F.split(s, r"[^0-9]+"), lambda x: x != ""), F.lit(i)).try_cast("int")
    month = lambda s: F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.substring(F.regexp_extract(F.lower(s), "([a-z]{3,})", 1), 1, 3)).cast("int")
    named = lambda s: F.regexp_replace(s, r"(?i)(\d)(?:st|nd|rd|th)\b", "$1")
    all_of = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), 0)
    found = [
        F.transform(F.transform(all_of(_MONTH_FIRST), named), lambda s: _date_forms(number(s, 1), month(s), number(s, 0))),
        F.transform(F.transform(all_of(_DAY_FIRST), named), lambda s: _date_forms(number(s, 1), month(s), number(s, 0))),
        F.transform(all_of(_ISO), lambda s: _date_forms(number(s, 0), number(s, 1), number(s, 2))),
        F.transform(all_of(_SLASHED), lambda s: F.concat(_date_forms(number(s, 2), number(s, 0), number(s, 1)), _date_forms(number(s, 2), number(s, 1), number(s, 0)))),
    ]
    relative = F.transform(F.regexp_extract_all(text, F.lit(RELATIVE), 1), lambda s: F.trim(F.regexp_replace(F.lower(s), r"\s+", " ")))
    terms = F.array_distinct(F.concat(F.flatten(F.concat(*found)), relative))
    return F.coalesce(F.slice(terms, 1, most) if most else terms, F.array().cast("array<string>"))


def _first_spellings(words: Column) -> Column:
    """Each word once without regard to case, as first written."""
    lower = F.transform(words, lambda w: F.lower(w))
    return F.filter(words, lambda w, i: F.array_position(lower, F.lower(w)) == i + 1)


def preference_terms(text: Column, most: int = 20) -> Column:
    """Words of three signs or more in sentences of preference, as first written, in order, the first ``most``; a null text has none."""
    sentences = F.filter(F.split(text, r"[.!?\n]+"), lambda s: s.rlike(PREFERENCE))
    words = F.flatten(F.transform(sentences, lambda s: F.regexp_extract_all(s, F.lit(WISHED), 1)))
    kept = F.filter(words, lambda w: ~F.lower(w).isin(*PLAIN_WORDS))
    return F.coalesce(F.slice(_first_spellings(kept), 1, most), F.array().cast("array<string>"))


def distinctive_words(text: Column) -> Column:
    """Lower-case words of three signs or more that tell one memory from another, each once."""
    words = F.regexp_extract_all(F.lower(text), F.lit(DISTINCTIVE), 1)
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*ENTITY_STOP_WORDS)))


def context_words(text: Column, most: int = 5) -> Column:
    """Product names, acronyms and words of four letters or more, as written, each once without regard to case; the first ``most``."""
    words = F.regexp_extract_all(text, F.lit(NAMED), 1)
    kept = F.filter(words, lambda w: ~F.lower(w).isin(*sorted({*PLAIN_WORDS, *QUERY_STOP_WORDS})))
    return F.slice(_first_spellings(kept), 1, most)


def hashing_embedder(width: int = 64):
    """A deterministic stand-in for a sentence model: signed hashed words, unit length; null for a text without words."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import xxhash

        def one(text):
            v = np.zeros(width)
            for w in re.findall(r"[^\W_]+", (text or "").lower()):
                h = xxhash.xxh64_intdigest(w)
                v[h % width] += 1 if h >> 63 else -1
            size = np.linalg.norm(v)
            return (v / size).astype(np.float32).tolist() if size else None

        for part in parts:
            yield part.map(one)

    return embed
