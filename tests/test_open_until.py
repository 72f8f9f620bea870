"""Ends of calls in every ISO writing, against datetime.fromisoformat."""

import datetime

import pytest
from pyspark.sql import functions as F

from siftline.functions import columns as C
from siftline.plans import core

ENDS = [
    "2026-06-01T00:00:01", "2026-06-01T00:00:00", "2026-06-01 00:00:01", "2026-06-02", "2026-06-01", "2026-05-31", "2026-06-01T00:00:00.0000019", "2026-06-01T00:00:00.5", "2026-06-01T00:00:00,250", "2026-06-01T00:00:00Z", "2026-06-01T00:01Z",
    "2026-06-01T01:00:00+02:00", "2026-05-31T23:00:00-02:00", "2026-06-01T01:30:00+0100", "2026-05-31T23:30:00.125-01", "2026-06-01T02:00:00.000+01", "20260602T1030", "20260601T000001Z", "20260602", "2026-06-01T05", "2026-02-30T10:00:00", "2026-06-31", "2026-13-01",
    "2026-06-05T25:00:00", "2026-06-05T10:61:00", "2026-06-05T10:00:00+25:00", "2026-06-05 10:00 CET", "2026/06/05 10:00", "12:30", "2027", "1790000000", "soon", "", " ", None,
]


def expected(end):
    try:
        at = datetime.datetime.fromisoformat((end or "").replace("Z", "+00:00"))
    except ValueError:
        return False
    return at.replace(tzinfo=at.tzinfo or datetime.UTC) > datetime.datetime(2026, 6, 1, tzinfo=datetime.UTC)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_open_until_equals_fromisoformat(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(i, e) for i, e in enumerate(ENDS)], "i int, e string")
        got = {ENDS[r["i"]]: r["x"] for r in df.select("i", C.open_until(F.col("e"), F.lit("2026-06-01 00:00:00").cast("timestamp_ntz")).alias("x")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == {e: expected(e) for e in ENDS}


def test_the_query_reads_every_iso_writing(spark, tmp_path):
    spark.createDataFrame([(i, e) for i, e in enumerate(ENDS)], "check_id bigint, cfp_end_local string").write.parquet(str(tmp_path / "event_results.parquet"))
    got = {ENDS[r["check_id"]]: r["is_open"] for r in core.QUERIES["open_until"](spark, str(tmp_path)).collect()}
    assert got == {e: expected(e) for e in ENDS}
