"""Mixed timestamp texts to one UTC instant.

Every step is a JVM expression: a text is matched against a short list of
forms, rewritten to ``year|month|day|hour|minute|second|fraction|am|zone`` and
handed to ``try_make_timestamp`` with the zone that applies.  Daylight-saving
changes follow java.time: of a local time that occurs twice the first is taken,
one that never occurs moves forward by the skipped hour.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Abbreviations of the supported zones and their offsets.
ABBREVIATIONS = {
    "UTC": "+00:00", "GMT": "+00:00", "Z": "+00:00", "BST": "+01:00", "CET": "+01:00", "CEST": "+02:00",
    "EST": "-05:00", "EDT": "-04:00", "PST": "-08:00", "PDT": "-07:00", "IST": "+05:30", "JST": "+09:00",
    "AEST": "+10:00", "AEDT": "+11:00",
}

# Month names by their first three letters, English, German and French.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "mär": 3, "mai": 5, "okt": 10, "dez": 12, "fév": 2, "avr": 4, "aoû": 8, "déc": 12,
}

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_ZONE = r"(?:\s*([Zz]|[+-]\d{2}(?::?\d{2})?)(?:\s*\[[A-Za-z_/+\-0-9:]+\])?|\s*\[([A-Za-z_/+\-0-9]+)\]|\s+([A-Za-z]+(?:/[A-Za-z_\-]+)*))?"
_AMPM = r"(?:\s*([AaPp])\.?[Mm]\.?)?"
_MONTH = r"(\p{L}{3,})\.?"
_DAY = r"(\d{1,2})(?:st|nd|rd|th)?"
_WEEKDAY = r"(?:\p{L}{2,}\.?,?\s+)?"

#: Forms as (pattern, rewriting).  Groups that a text lacks come out empty.
FORMS: tuple[tuple[str, str], ...] = (
    # 2024-05-01, 2024-05-01T10:00[:00[.123]][+02:00][[Europe/Berlin]], 2024-05-01 10:00 CET, 2024/05/01 (Wed) 10:00
    (rf"(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})(?:\s*\(\p{{L}}+\.?\))?(?:[Tt\s]\s*{_CLOCK}{_AMPM}{_ZONE})?", "$1|$2|$3|$4|$5|$6|$7|$8|$9$10$11"),
    # 20240501, 20240501T100000Z
    (rf"(\d{{4}})(\d{{2}})(\d{{2}})(?:[Tt](\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?{_ZONE})?", "$1|$2|$3|$4|$5|$6|$7||$8$9$10"),
    # Wed, 01 May 2024 10:00:00 +0200; 1 may 2024 10:00; 1. May 2024; 1 May 2024, 1:15 PM CET
    (rf"{_WEEKDAY}{_DAY}\.?[\s\-]+{_MONTH}[\s\-,]+(\d{{4}})(?:,?\s+(?:at\s+)?{_CLOCK}{_AMPM}{_ZONE})?", "$3|$2|$1|$4|$5|$6|$7|$8|$9$10$11"),
    # May-01-2024; May 1st, 2024 at 10:00
    (rf"{_WEEKDAY}{_MONTH}[\s\-]+{_DAY}[\s\-,]+(\d{{4}})(?:,?\s+(?:at\s+)?{_CLOCK}{_AMPM}{_ZONE})?", "$3|$1|$2|$4|$5|$6|$7|$8|$9$10$11"),
    # 1:15 pm on 1 May, 2024
    (rf"{_CLOCK}{_AMPM}{_ZONE}\s+on\s+{_DAY}\.?\s+{_MONTH},?\s+(\d{{4}})", "$11|$10|$9|$1|$2|$3|$4|$5|$6$7$8"),
)
#: All-numeric with the year last; which of the first two is the month depends on the locale.
_YEAR_LAST = rf"(\d{{1,2}})([/.\-])(\d{{1,2}})\2(\d{{4}})(?:,?\s+{_CLOCK}{_AMPM}{_ZONE})?"
_WEEK = r"(\d{4})-?W(\d{2})(?:-?([1-7]))"
_NUMBER = r"-?\d{9,17}(?:\.\d+)?"


def _whole(pattern: str) -> str:
    return rf"^(?:{pattern})$"


def _rewritten(text: Column, locale: Column) -> Column:
    cases = [F.when(text.rlike(_whole(p)), F.regexp_replace(text, _whole(p), to)) for p, to in FORMS]
    month_first, day_first = "$4|$1|$3|$5|$6|$7|$8|$9|$10$11$12", "$4|$3|$1|$5|$6|$7|$8|$9|$10$11$12"
    last = F.when(
        text.rlike(_whole(_YEAR_LAST)),
        F.when(locale == "en_US", F.regexp_replace(text, _whole(_YEAR_LAST), month_first)).otherwise(F.regexp_replace(text, _whole(_YEAR_LAST), day_first)),
    )
    return F.coalesce(*cases, last)


def _literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def zone_of(mark: Column) -> Column:
    """The zone id or offset for what a text says after its time; null where it is none that exists."""
    digits = F.regexp_replace(mark, ":", "")
    offset = F.concat(F.substring(digits, 1, 3), F.lit(":"), F.when(F.length(digits) >= 5, F.substring(digits, 4, 2)).otherwise(F.lit("00")))
    fits = (F.substring(digits, 2, 2).try_cast("int") <= 14) & (F.coalesce(F.substring(digits, 4, 2).try_cast("int"), F.lit(0)) < 60)
    return (
        F.when(mark.rlike(r"^[+-]\d{2}"), F.when(fits, offset))
        .when(mark.rlike(r"^[A-Za-z]+$"), F.try_element_at(_literal_map(ABBREVIATIONS), F.upper(mark)))
        .when(mark.contains("/"), mark)
    )


def _parts(parts: Column) -> Column:
    """struct(year, month, day, hour, minute, seconds, mark) of a rewritten date; null fields where a text is out of range."""
    get = lambda i: F.nullif(F.get(parts, F.lit(i)), F.lit(""))
    month = F.coalesce(get(1).try_cast("int"), F.try_element_at(_literal_map(MONTHS), F.lower(F.substring(get(1), 1, 3))))
    hour, half = get(3).try_cast("int"), F.lower(get(7))
    hour24 = F.when(half.isNull(), hour).when(hour.between(1, 12), F.pmod(hour, F.lit(12)) + F.when(half == "p", 12).otherwise(0))
    second = F.coalesce(get(5), F.lit("0"))
    micros = F.rpad(F.substring(F.coalesce(get(6), F.lit("0")), 1, 6), 6, "0")
    return F.struct(
        get(0).try_cast("int").alias("year"), month.alias("month"), get(2).try_cast("int").alias("day"),
        F.when(get(3).isNull(), F.lit(0)).otherwise(hour24).alias("hour"),
        F.coalesce(get(4), F.lit("0")).try_cast("int").alias("minute"),
        F.when(second.try_cast("int") < 60, F.concat(second, F.lit("."), micros).try_cast("decimal(16,6)")).alias("seconds"),
        get(8).alias("mark"),
    )


def _week_instant(text: Column, zone: Column) -> Column:
    part = lambda i: F.regexp_extract(text, _whole(_WEEK), i).try_cast("int")
    fourth = F.make_date(part(1), F.lit(1), F.lit(4))
    day = F.date_add(F.date_sub(fourth, F.weekday(fourth)), (part(2) - 1) * 7 + part(3) - 1)
    exists = part(2).between(1, 53) & (F.weekofyear(day) == part(2))
    local = F.call_function("try_make_timestamp", F.year(day), F.month(day), F.day(day), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"), zone)
    return F.when(text.rlike(_whole(_WEEK)) & exists, F.unix_micros(local))


def _number_instant(text: Column) -> Column:
    whole = F.regexp_extract(text, r"^(-?\d+)", 1).try_cast("long")
    fraction = F.regexp_extract(text, r"\.(\d+)$", 1)
    micros = F.rpad(F.substring(fraction, 1, 6), 6, "0").try_cast("long")
    size = F.abs(whole)
    value = (
        F.when(size < 100_000_000_000, whole * 1_000_000 + F.coalesce(F.when(fraction != "", micros), F.lit(0)))
        .when(size < 100_000_000_000_000, whole * 1_000 + F.coalesce(F.when(fraction != "", (micros / 1000).cast("long")), F.lit(0)))
        .otherwise(whole)
    )
    return F.when(text.rlike(_whole(_NUMBER)) & ~text.rlike(r"^\d{8}$"), value)


def normalise_timestamps(df: DataFrame, text: str, locale: str, zone: str, out: str = "utc_us") -> DataFrame:
    """Adds ``out``: the microseconds since 1970-01-01 UTC that a written date denotes (long).

    ``zone`` is used where the text itself names none; null means UTC.  Null,
    blank and meaningless texts, days that do not exist and texts with an
    unknown zone give null.  Repeated rows keep their own results, an empty
    table stays empty, other columns pass through (one called like ``out`` is
    replaced).  The steps are columns of their own, so that none is evaluated
    twice and the generated code stays small.
    """
    clean, cut, home, parts, own = "_rx_text", "_rx_cut", "_rx_home", "_rx_parts", "_rx_own"
    staged = (
        df.withColumns({clean: F.regexp_replace(F.col(text), r"(?U)^[\s\x{200b}\x{feff}]+|[\s\x{200b}\x{feff}]+$", ""), home: F.coalesce(F.col(zone), F.lit("UTC"))})
        .withColumn(cut, F.split(_rewritten(F.col(clean), F.col(locale)), r"\|", -1))
        .withColumn(parts, _parts(F.col(cut)))
        .withColumn(own, F.when(F.col(parts)["mark"].isNull(), F.col(home)).otherwise(zone_of(F.col(parts)["mark"])))
    )
    p = F.col(parts)
    fits = (p["minute"] < 60) & (p["hour"] < 24)
    written = F.when(fits, F.call_function("try_make_timestamp", p["year"], p["month"], p["day"], p["hour"], p["minute"], p["seconds"], F.col(own)))
    value = F.coalesce(_number_instant(F.col(clean)), _week_instant(F.col(clean), F.col(home)), F.unix_micros(written))
    # Always true, but not foldable: keeps a later filter on the result from being pushed down, which would evaluate it all twice.
    value = F.when(F.monotonically_increasing_id() >= 0, value)
    return staged.withColumn(out, value).drop(clean, cut, home, parts, own)


def _histories(prior: float, change: float):
    """The cheapest sequence of zones for each row's dates, by dynamic programming over (date, zone)."""

    def cheapest(dates: list[np.ndarray], n: int) -> tuple[list[int], int]:
        cost, came = np.where(np.arange(n) > 0, prior, 0.0), []
        away = np.where(np.eye(n, dtype=bool), 0.0, change)
        for last, now in zip(dates, dates[1:], strict=False):
            step = cost[:, None] + away + (last[:, None] > now[None, :])
            came.append(step.argmin(axis=0))
            cost = step.min(axis=0)
        path = [int(cost.argmin())]
        for back in reversed(came):
            path.append(int(back[path[-1]]))
        path.reverse()
        return path, sum(int(a[i] > b[j]) for a, b, i, j in zip(dates, dates[1:], path, path[1:], strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen, bad = [], []
            for row in batch.column("_tried").to_pylist():
                read = [np.array(d["us"], np.int64) for d in row if d["us"]]
                path, wrong = cheapest(read, len(read[0])) if read else ([], 0)
                ways = iter(path)
                chosen.append([next(ways) if d["us"] else None for d in row])
                bad.append(wrong)
            names = [*batch.schema.names, "_chosen", "violations"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chosen, pa.list_(pa.int32())), pa.array(bad, pa.int64())], names=names)

    return run


def estimate_zones(df: DataFrame, keys: list[str], order: str, text: str, locale: str, zone: str, candidates: list[str], prior: float = 1.5, change: float = 1.5) -> DataFrame:
    """The zones that best explain the written order, for every record whose zone is null.

    Dates of one record (equal ``keys``, null being a key of its own) are
    written in rising order.  Each date is read in every candidate zone; those
    that fix their own instant (offsets, epoch numbers) are anchors, equal in
    all.  Of all histories of zones the cheapest is taken: one for two
    neighbours that run backwards, ``prior`` for beginning in another zone than
    the first candidate, ``change`` for going from one zone to another.  So the
    first candidate holds unless at least two violations speak against it.  Out
    comes one row a record: ``(keys, history, violations, dates)``, where
    ``history`` is an array of (order, zone, utc_us) in order, with null zone and
    instant for what cannot be read, and ``dates`` counts what can.  Records are
    taken to be bounded (they come from one row's array); only those without a
    zone are grouped.  Other columns are ignored.
    """
    missing = df.where(F.col(zone).isNull()).select(*keys, order, text, locale)
    tried = missing.withColumn("_try", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(z).alias("z")) for i, z in enumerate(candidates)])))
    timed = normalise_timestamps(tried.withColumn("_zone", F.col("_try.z")), text, locale, "_zone", "_us")
    dates = timed.groupBy(*keys, order, text, locale).agg(F.array_sort(F.collect_list(F.when(F.col("_us").isNotNull(), F.struct(F.col("_try.i").alias("i"), F.col("_us").alias("us"))))).alias("_read"))
    # Equal dates of one position come out of the group once; their instants repeat, a multiple of the candidates.
    once = F.transform(F.array_distinct("_read"), lambda r: r["us"])
    records = dates.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.when(F.size("_read") > 0, once).alias("us")))).alias("_tried"))
    schema = ", ".join(f"`{c}` {t}" for c, t in records.dtypes)
    told = records.mapInArrow(_histories(prior, change), f"{schema}, _chosen array<int>, violations long")
    names = F.array(*[F.lit(z) for z in candidates])
    history = F.transform(
        F.arrays_zip("_tried", "_chosen"),
        lambda x: F.struct(x["_tried"]["o"].alias("order"), F.get(names, x["_chosen"]).alias("zone"), F.get(x["_tried"]["us"], x["_chosen"]).alias("utc_us")),
    )
    return told.select(*keys, history.alias("history"), "violations", F.size(F.filter("_chosen", lambda c: c.isNotNull())).cast("long").alias("dates"))


def question_stamps(questions: DataFrame) -> DataFrame:
    """(record_id, stamp_no, written, time_zone, locale, row): one row for each entry of ``haystack_dates``; ``row`` numbers the records."""
    rows = questions.select(F.col("question_id").alias("record_id"), "time_zone", "locale", F.monotonically_increasing_id().alias("row"), F.posexplode("haystack_dates").alias("pos", "written"))
    return rows.select("record_id", (F.col("pos") + 1).cast("int").alias("stamp_no"), "written", "time_zone", "locale", "row")


def sample_stamps(samples: DataFrame) -> DataFrame:
    """The same for the ``session_N_date_time`` keys of the conversation objects; texts that are no JSON object give no rows."""
    entries = samples.select(
        F.col("sample_id").alias("record_id"), "time_zone", "locale", (-1 - F.monotonically_increasing_id()).alias("row"), F.explode(F.from_json("conversation", "map<string,string>")).alias("name", "written")
    )
    number = F.regexp_extract("name", r"^session_(\d+)_date_time$", 1).try_cast("int")
    return entries.where(number.isNotNull()).select("record_id", number.alias("stamp_no"), "written", "time_zone", "locale", "row")


def found_stamps(questions: DataFrame, samples: DataFrame, zones: list[str]) -> DataFrame:
    """Every date of both tables that denotes an instant; records without a zone get the history of ``zones`` that fits them best."""
    stamps = question_stamps(questions).unionByName(sample_stamps(samples))
    known = normalise_timestamps(stamps.where("time_zone IS NOT NULL"), "written", "locale", "time_zone").select("record_id", "stamp_no", "utc_us")
    guessed = estimate_zones(stamps, ["record_id", "row"], "stamp_no", "written", "locale", "time_zone", zones)
    guessed = guessed.select("record_id", F.inline("history")).select("record_id", F.col("order").alias("stamp_no"), "utc_us")
    return known.unionByName(guessed).where("utc_us IS NOT NULL")
