from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from recollex.operators.timestamps import estimate_zones, normalise_timestamps, question_stamps, sample_stamps


def us(*parts, micro=0):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp()) * 1_000_000 + micro


CASES = [
    ("2024-05-01T10:00:00Z", "en_US", "Asia/Tokyo", us(2024, 5, 1, 10)),
    ("2024-05-01 10:00:00", "en_US", "Asia/Tokyo", us(2024, 5, 1, 1)),
    ("2024-05-01 10:00:00", "en_US", None, us(2024, 5, 1, 10)),
    ("2024-05-01", "de_DE", "Europe/Berlin", us(2024, 4, 30, 22)),
    (" \t2024-05-01T10:00:00.123456789+02\n", "en_US", None, us(2024, 5, 1, 8, micro=123456)),
    ("2024-05-01T10:00:00,5z", "en_US", "Asia/Tokyo", us(2024, 5, 1, 10, micro=500000)),
    ("20240501T100000Z", "en_US", "Asia/Tokyo", us(2024, 5, 1, 10)),
    ("2024-05-01T10:00:00+05:30[Asia/Kolkata]", "en_US", "UTC", us(2024, 5, 1, 4, 30)),
    ("2024-05-01 10:00 Europe/London", "en_US", "UTC", us(2024, 5, 1, 9)),
    ("5 Mar 2024, 12:18 AM JST", "en_US", "UTC", us(2024, 3, 4, 15, 18)),
    ("12:29 pm on 23 April, 2024", "en_US", "UTC", us(2024, 4, 23, 12, 29)),
    ("Wed, 01 May 2024 13:37:34 -0700", "en_US", "UTC", us(2024, 5, 1, 20, 37, 34)),
    ("March 20th, 2024 at 23:43", "en_GB", "UTC", us(2024, 3, 20, 23, 43)),
    ("July-03-2024", "en_GB", "UTC", us(2024, 7, 3)),
    ("23. Oct 2024", "de_DE", "UTC", us(2024, 10, 23)),
    ("2025/05/28 (Wed) 04:16", "en_US", "UTC", us(2025, 5, 28, 4, 16)),
    ("03/04/2024", "en_US", "UTC", us(2024, 3, 4)),
    ("03/04/2024", "en_GB", "UTC", us(2024, 4, 3)),
    ("03/04/2024", None, "UTC", us(2024, 4, 3)),
    ("3/4/2024 7:05 PM", "en_US", "UTC", us(2024, 3, 4, 19, 5)),
    ("31.03.2024 02:30", "de_DE", "Europe/Berlin", us(2024, 3, 31, 1, 30)),  # never occurs: an hour later
    ("2024-10-27 02:30:00", "de_DE", "Europe/Berlin", us(2024, 10, 27, 0, 30)),  # occurs twice: the first
    ("2024-W01-1", "en_US", "UTC", us(2024, 1, 1)),
    ("2023-W53-1", "en_US", "UTC", None),
    ("1726707495", "en_US", "Asia/Tokyo", 1726707495 * 1_000_000),
    ("1729163620273", "en_US", None, 1729163620273 * 1000),
    ("1711850751750517", "en_US", None, 1711850751750517),
    ("2024-02-30", "en_US", "UTC", None),
    ("2024-13-01", "en_US", "UTC", None),
    ("0000-00-00", "en_US", "UTC", None),
    ("2024-05-01 25:00:00", "en_US", "UTC", None),
    ("2024-05-01 10:00:00 XYZ", "en_US", "UTC", None),
    ("yesterday", "en_US", "UTC", None),
    ("", "en_US", "UTC", None),
    (None, None, None, None),
    ("x" * 100_000, "en_US", "UTC", None),
]


def test_forms(spark):
    df = spark.createDataFrame([(i, t, loc, z, "mine") for i, (t, loc, z, _) in enumerate(CASES)], "i int, written string, locale string, zone string, utc_us string")
    got = {r["i"]: r["utc_us"] for r in normalise_timestamps(df, "written", "locale", "zone").collect()}
    assert [(CASES[i][0], got[i]) for i in got] == [(CASES[i][0], CASES[i][3]) for i in got]


def test_repeated_rows_and_empty_table(spark):
    one = spark.createDataFrame([("2024-05-01", "en_US", "UTC")] * 2, "written string, locale string, zone string")
    assert normalise_timestamps(one, "written", "locale", "zone").count() == 2
    assert normalise_timestamps(one.limit(0), "written", "locale", "zone").count() == 0


def test_stamps_of_both_tables(spark):
    q = spark.createDataFrame([("q", "UTC", "en_US", ["2024-05-01", None]), ("r", None, None, None)], "question_id string, time_zone string, locale string, haystack_dates array<string>")
    assert [(r.record_id, r.stamp_no, r.written) for r in question_stamps(q).orderBy("stamp_no").collect()] == [("q", 1, "2024-05-01"), ("q", 2, None)]
    s = spark.createDataFrame([("a", None, None, '{"session_2": [], "session_2_date_time": 1726707495, "session_10_date_time": null}'), ("b", None, None, "broken")], "sample_id string, time_zone string, locale string, conversation string")
    assert sorted((r.stamp_no, r.written) for r in sample_stamps(s).collect()) == sorted([(2, "1726707495"), (10, None)], key=lambda x: x[0])


@pytest.mark.parametrize("zone", ["Asia/Tokyo", "America/New_York"])
def test_zone_is_estimated_from_order(spark, zone):
    rows = []
    for i in range(12):
        instant = us(2024, 5, 1) + i * 3_600_000_000 * 2
        rows.append(("k", i, instant, i % 2 == 0))
    df = spark.createDataFrame(rows, "k string, n int, us long, fixed boolean")
    local = F.date_format(F.from_utc_timestamp(F.timestamp_micros("us"), zone), "yyyy-MM-dd HH:mm:ss")
    df = df.select("k", "n", F.when(F.col("fixed"), F.concat(F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).otherwise(local).alias("t"), F.lit("en_GB").alias("l"), F.lit(None).cast("string").alias("z"))
    best = estimate_zones(df, ["k"], "n", "t", "l", "z", ["UTC", "Asia/Tokyo", "America/New_York"]).collect()
    # A date that is an instant of its own is in any zone.
    assert [(r.violations, r.dates, {h.zone for h, x in zip(r.history, rows, strict=True) if not x[3]}) for r in best] == [(0, 12, {zone})]
    assert [h.utc_us for h in best[0].history] == [x[2] for x in rows]


def test_history_of_zones_and_the_first_candidate(spark):
    """A record that moves from one zone to another; records whose order says nothing, or speaks once only against UTC, stay in UTC."""
    hour, start = 3_600_000_000, us(2024, 5, 1)
    rows = []
    for i in range(24):
        instant, shift = start + i * 2 * hour, 9 if i < 12 else -4
        rows.append(("moved", i, f"{instant // 1_000_000}" if i % 2 else str(datetime.fromtimestamp(instant / 1e6 + shift * 3600, timezone.utc).replace(tzinfo=None))))
    rows += [("few", 0, "2024-05-01 10:00:00"), ("few", 1, "2024-05-01 09:00:00Z"), ("none", 0, "someday"), (None, 0, "2024-05-01"), (None, 0, "2024-05-01")]
    df = spark.createDataFrame([(*r, "en_GB", None, 1) for r in rows], "k string, n int, t string, l string, z string, history int")
    got = {r.k: r for r in estimate_zones(df, ["k"], "n", "t", "l", "z", ["UTC", "Asia/Tokyo", "America/New_York"]).collect()}
    assert [h.zone for h in got["moved"].history][2:23:2] == ["Asia/Tokyo"] * 5 + ["America/New_York"] * 6 and got["moved"].violations == 0
    assert [h.utc_us for h in got["moved"].history] == [start + i * 2 * hour for i in range(24)]
    assert [h.zone for h in got["few"].history] == ["UTC", "UTC"] and got["few"].violations == 1
    assert got["none"].dates == 0 and got["none"].history[0].zone is None and got[None].history[0].utc_us == start
    assert estimate_zones(df.limit(0), ["k"], "n", "t", "l", "z", ["UTC"]).count() == 0
