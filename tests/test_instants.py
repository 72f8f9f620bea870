"""Normal forms of dates and times."""

import pytest

from siftline.functions.instants import normal_form

CASES = [
    ("2027-01-31", None, "2027-01-31"), ("25 January 2028", None, "2028-01-25"), ("May 24, 2027", None, "2027-05-24"), ("12/06/2026", None, None), ("13/06/2026", None, "2026-06-13"),
    ("06/13/2026", None, "2026-06-13"), ("08/08/2026", None, "2026-08-08"), ("13.02.2026", None, "2026-02-13"), ("03.02.2026", None, "2026-02-03"), ("2027-02-29", None, None), ("2028-02-29", None, "2028-02-29"),
    ("2025-W52-1", None, "2025-12-22"), ("2026-W53-7", None, "2027-01-03"), ("2025-W53-1", None, None), ("Fri, Apr 24th 2026", None, "2026-04-24"), ("15-JAN-2026", None, "2026-01-15"),
    ("16. April 2027", None, "2027-04-16"), ("10 mai 2024", None, "2024-05-10"), ("19 de mayo de 2027", None, "2027-05-19"), ("28 février 2026", None, "2026-02-28"), ("25. März 2026", None, "2026-03-25"),
    ("20260213", None, "2026-02-13"), ("1800612000", None, "2027-01-22T10:00:00Z"), ("1705127400123", None, "2024-01-13T06:30:00Z"),
    ("2026-09-05 23:59", None, None), ("2026-09-05 23:59", "Europe/Berlin", "2026-09-05T21:59:00Z"), ("2026-09-05 23:59", " EUROPE / berlin", "2026-09-05T21:59:00Z"), ("2026-09-05 23:59", "venue time", None),
    ("2026-09-05 23:59 Asia/Kolkata", "Europe/Berlin", "2026-09-05T18:29:00Z"), ("2026-09-05 23:59 America/Los_Angeles", None, "2026-09-06T06:59:00Z"),
    ("2025-04-11 09:30 AOE", None, "2025-04-11T21:30:00Z"), ("2025-04-11 09:30 Anywhere on Earth", None, "2025-04-11T21:30:00Z"), ("2025-05-10 12:00 GMT+2", None, "2025-05-10T10:00:00Z"), ("2025-05-10 12:00 UTC+5:30", None, "2025-05-10T06:30:00Z"),
    ("2024-05-04T09:30:00.9999999+05:30", None, "2024-05-04T04:00:00Z"), ("2027-06-16T11:00:00Z", None, "2027-06-16T11:00:00Z"), ("Sun, 12 Jul 2026 18:00:00 +0530", None, "2026-07-12T12:30:00Z"),
    ("May 20, 2027 11:59 pm", "UTC", "2027-05-20T23:59:00Z"), ("Jan 25, 2025 12:15 AM CET", None, "2025-01-24T23:15:00Z"), ("20250220T0000", "UTC", "2025-02-20T00:00:00Z"), ("2023-06-15T25:10:00", "UTC", None), ("10/10/2026 13:59 PM", "UTC", None),
    ("2026-03-29T02:30:00", "Europe/Berlin", None), ("2026-10-25T02:30:00", "Europe/Berlin", None), ("2026-10-25T03:00:00", "Europe/Berlin", "2026-10-25T02:00:00Z"), ("2026-03-29T03:00:00", "Europe/Berlin", "2026-03-29T01:00:00Z"),
    ("October 11 – 13, 2027", None, "2027-10-11"), ("27-30 June 2025", None, "2025-06-27"), ("May 31 - June 2, 2028", None, "2028-05-31"), ("31 March-2 April 2024", None, "2024-03-31"), ("01.–03.03.2026", None, "2026-03-01"),
    ("2025-01-15 – 2025-01-16", None, "2025-01-15"), ("2028-10-22/2028-10-22", None, "2028-10-22"), ("Dec 30 – Jan 2, 2028", None, "2027-12-30"), ("2025-01-16 - 2025-01-15", None, None),
    ("Q3 2024", None, None), ("mid June 2024", None, None), ("June 2028", None, None), ("April 14-15", None, None), ("9/2024", None, None), ("9999", None, None), ("TBA", None, None), ("", None, None), ("   ", None, None), (None, "UTC", None), ("x" * 100_000, None, None),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, t, z) for i, (t, z, _) in enumerate(CASES)], "i int, t string, z string")
    got = {r["i"]: r["normal_form"] for r in normal_form(df, "t", "z").collect()}
    wrong = [(CASES[i], got[i]) for i in got if got[i] != CASES[i][2]]
    assert not wrong and len(got) == len(CASES)


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Tokyo"])
def test_session_zone_has_no_say(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([("2026-09-05 23:59", "Europe/Berlin")], "t string, z string")
        assert normal_form(df, "t", "z").first()["normal_form"] == "2026-09-05T21:59:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_clashing_columns_repeats_and_empty(spark):
    df = spark.createDataFrame([("2026-01-02", "a")] * 3, "__inst_ string, __inst_y string")
    got = normal_form(df, "__inst_", out="out")
    assert got.columns == ["__inst_", "__inst_y", "out"] and [r["out"] for r in got.collect()] == ["2026-01-02"] * 3
    assert normal_form(df.limit(0), "__inst_").count() == 0


def test_texts_of_any_length(spark):
    rows = [("2026-05-01T10:00:00." + "123456789" * 40 + "Z", "2026-05-01T10:00:00Z"), ("2026-05-01" + " " * 500, "2026-05-01"), ("x" * 300_000, None), ("2026-05-01 " * 20_000, None), ("1" * 100_000, None)]
    got = normal_form(spark.createDataFrame(rows, "v string, want string"), "v").collect()
    assert [r["normal_form"] for r in got] == [w for _, w in rows]
