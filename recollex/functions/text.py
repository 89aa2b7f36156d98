"""Text features as column expressions: tokens, trigrams, names, dates, query intents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that results must agree on, in plain form.
COMMON_CAPITALS = (
    "The This That What When Where Which Who How Why Did Does Can Could Would Should Have Has Had Are Was Were Will May "
    "Not But And For With From Into About After Before Between During Until Also Just Only Then Than Very Most Some"
).split()
RANK_STOP_WORDS = (
    "a an the and or in on at to for of is it its was be been i me my we you your he she they this that not with from "
    "have has do does did will can so if as up out are by no but had"
).split()
RERANK_STOP_WORDS = (
    "a an the and or but in on at to for of with by from is it as be was were been are have has had do does did will would could should may might can shall not "
    "no so if then than that this these those i me my we us our you your he him his she her they them their its what which who whom how when where why all each every "
    "both few more most some any also just about up out into over after before between under again very too here there now only"
).split()
ENTITY_STOP_WORDS = (
    "i me my we our you your it its they the a an and or but in on at to for of is am are was were be been being have has had do does did will would could "
    "should can may might not no so if that this these those some any all more much very just also too than then now here there when where how what which who "
    "with from about into by as up out new really because something things think know want need like prefer enjoy love good great best better one ones get got going make "
    "time way thing lot many few other well"
).split()
QUERY_STOP_WORDS = (
    "i me my we our you your it its they the a an and or but in on at to for of is am are was were be been being have has had do does did will would could "
    "should can may might shall not no so if that this these those some any all more much very just also too than then now here there when where how what which who "
    "with from about into by as up out tips advice suggestions thoughts recommendations ideas tell recommend suggest think feel like choose know need want looking "
    "good best great new really something"
).split()
VAGUE = r"(?i)\b(?:any\s+(?:tips|advice|suggestions|thoughts|recommendations|ideas)|what\s+(?:do\s+you|should\s+I|would\s+you|can\s+you)\s+(?:recommend|suggest|think)|how\s+(?:do\s+you|should\s+I)\s+(?:feel|like|choose)|tell\s+me\s+about)\b"
FACTUAL = r"(?i)\b(?:when\s+did|what\s+(?:is|was|were|are)\s+(?:the|my|our)|where\s+(?:is|was|did)|which\s+(?:port|version|file|database|command|config|setting)|how\s+(?:many|much|long|often)|what\s+(?:time|date|year|port|version|number))\b"
RECENCY = r"(?i)\b(?:most\s+recent(?:ly)?|latest|last|current(?:ly)?|nowadays|these\s+days|at\s+(?:this\s+)?(?:point|moment)|right\s+now|still|anymore|now|today)\b"
SPECIFIC_TIME = r"(?i)\b(?:\d{4}|january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec|monday|tuesday|wednesday|thursday|friday|saturday|sunday|yesterday|\d{1,2}/\d{1,2})\b"
COUNTING = r"(?i)\b(?:how\s+many|how\s+much|count(?:ed)?|total(?:\s+number)?(?:\s+of)?|number\s+of|sum\s+of|tally|aggregate|all\s+(?:the\s+)?(?:times?|instances?|occasions?|events?))\b"
INTERVAL = r"(?i)\bhow\s+(?:many|long|much)\s+(?:\w+\s+)?ago\b"
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
NUMBER_WORDS = {"two": 2, "three": 3, "four": 4, "five": 5, "six": 6}


def rank_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits of more than one character, in order, repeats kept."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) > 1)


def has_text(text: Column) -> Column:
    """Whether a text has more than white space and invisible characters; a null text has not."""
    return F.coalesce(text.rlike(r"(?U)[^\s\x{1c}-\x{1f}\x{200b}\x{200c}\x{200d}\x{2060}\x{feff}\x{180e}]"), F.lit(False))


def rerank_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and underscores of more than one character outside the stop list, in order."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda w: (F.length(w) > 1) & ~w.isin(*RERANK_STOP_WORDS))


def word_runs(words: Column, n: int) -> Column:
    """Every run of ``n`` neighbouring words, joined by a blank."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - n + 1))
    return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def numbers_in(text: Column) -> Column:
    """Distinct numbers of a text as written."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b\d+(?:[.,]\d+)?\b"), 0))


def how_many_in(wanted: Column, text: Column) -> Column:
    """How many of the wanted strings stand in the text; a null text holds none."""
    # The text as a variable of its own, so that it is made once and not for each of the wanted.
    return F.get(F.transform(F.array(text), lambda t: F.size(F.filter(wanted, lambda w: F.coalesce(F.contains(t, w), F.lit(False))))), F.lit(0))


def is_exchange(content: Column) -> Column:
    """Whether both sides of an exchange are there."""
    return F.coalesce(content.rlike(r"(?i)\[USER\]:") & content.rlike(r"(?i)\[ASSISTANT\]:"), F.lit(False))


def _among(word: Column, words: list[str]) -> Column:
    return word.isin(*words)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each word padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values; 0 where both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared.cast("double"), (F.size(a) + F.size(b) - shared).cast("double")), F.lit(0.0))


def proper_nouns(text: Column) -> Column:
    """Capitalised ASCII words that are no common openers, each once, in order."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])([A-Z][a-z]+)(?![A-Za-z0-9_])"), 1)
    return F.array_distinct(F.filter(found, lambda w: ~_among(w, COMMON_CAPITALS)))


def content_words(query: Column) -> Column:
    """Words of three letters or more outside the stop list."""
    return F.filter(F.regexp_extract_all(query, F.lit(r"(?<![A-Za-z0-9_])([a-zA-Z]{3,})(?![A-Za-z0-9_])"), 1), lambda w: ~_among(F.lower(w), QUERY_STOP_WORDS))


def is_vague(query: Column) -> Column:
    nouns = F.size(content_words(query))
    words = F.size(F.filter(F.split(query, r"\s+"), lambda w: w != ""))
    return F.when(query.rlike(FACTUAL), False).when(query.rlike(VAGUE), nouns < 2).otherwise((words <= 4) & (nouns < 1))


def keyword_weight(query: Column, base: float) -> Column:
    """The keyword share of a fusion: low for vague questions without nouns, full otherwise."""
    nouns = F.size(content_words(query))
    short = F.size(F.split(query, r"\s+")) <= 12
    wish = query.rlike(r"(?i)\b(?:recommend|suggest|prefer|like|enjoy|want|looking|interested)\b")
    return F.when(query.rlike(FACTUAL), base).when(query.rlike(VAGUE) & (nouns < 2), base * 0.3).when(short & wish & (nouns < 2), base * 0.5).otherwise(base)


def wants_recent(query: Column) -> Column:
    return query.rlike(RECENCY) & ~query.rlike(SPECIFIC_TIME)


def is_counting(query: Column) -> Column:
    return query.rlike(COUNTING)


def asks_interval(query: Column) -> Column:
    return query.rlike(INTERVAL)


def target_date(query: Column, reference: Column) -> Column:
    """The day that a relative expression means, counted from ``reference``; null where there is none."""
    q = F.lower(query)
    number = lambda unit: F.nullif(F.regexp_extract(q, rf"(\d{{1,6}})\s+{unit}s?\s+ago", 1), F.lit("")).try_cast("int")
    word = F.regexp_extract(q, r"(two|three|four|five|six)\s+weeks?\s+ago", 1)
    weekday = F.regexp_extract(q, rf"\blast\s+({'|'.join(WEEKDAYS)})\b", 1)
    wanted = F.array_position(F.array(*map(F.lit, WEEKDAYS)), weekday) - 1
    back = F.pmod(F.weekday(reference) - wanted, F.lit(7)).cast("int")
    days = F.coalesce(
        number("day"),
        F.when(q.rlike(r"(?:a\s+couple|a\s+pair|two)\s+of\s+days?\s+ago"), 2),
        F.when(q.rlike(r"a\s+few\s+days?\s+ago"), 3),
        F.when(q.rlike(r"\byesterday\b"), 1),
        number("week") * 7,
        F.when(word != "", F.try_element_at(F.create_map(*[F.lit(x) for p in NUMBER_WORDS.items() for x in p]), word) * 7),
        F.when(q.rlike(r"\blast\s+week\b"), 7),
        number("month") * 30,
        F.when(q.rlike(r"\blast\s+month\b"), 30),
        F.when(weekday != "", F.when(back == 0, 7).otherwise(back)),
    )
    return F.date_sub(reference, days)


def memory_date(content: Column, tags: Column, created: Column) -> Column:
    """The day a memory speaks of: a ``[Date: ...]`` mark, else the first date-like tag, else the day it was made."""
    mark = F.call_function("try_to_date", F.nullif(F.regexp_extract(content, r"\[Date:\s*(\d{4}-\d{2}-\d{2})\]", 1), F.lit("")), F.lit("yyyy-MM-dd"))
    tag = F.call_function("try_to_date", F.get(F.filter(tags, lambda t: t.rlike(r"^\d{4}-\d{2}-\d{2}$")), F.lit(0)), F.lit("yyyy-MM-dd"))
    return F.coalesce(mark, tag, F.to_date(created))
