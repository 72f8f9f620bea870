"""Scalar functions against tables of cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from siftline.functions import columns as C

HOSTS = [("sessions.example", "api"), ("feed.example", "feed.example")]


def one(spark, f, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(f(*[F.col(n) for n in names]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("https://SESSIONS.EXAMPLE/Alder-Fen", "sessions.example/Alder-Fen"), ("https://sessions.example/heath?x=1#top", "sessions.example/heath"),
        ("https://sessions.example/", "sessions.example"), ("http://a.example//b//", "a.example//b"), ("https://u:p@h.example:8443/x", "h.example/x"),
        ("//h.example/x", "h.example/x"), ("https://h.example/a b", "h.example/a b"), ("https://h.example/a;p=1", "h.example/a"), ("https://h_x.example/y", "h_x.example/y"),
        (" https://h.example/x", "h.example/x"), ("http://[::1]:80/x", "::1/x"), ("https://u@[2001:DB8::7]/a/?q", "2001:db8::7/a"), ("", None), ("not-a-url", None), ("https://", None), ("mailto:cfp", None), (None, None),
    ],
)
def test_url_identity(spark, url, expected):
    assert one(spark, C.url_identity, url) == expected


@pytest.mark.parametrize(("url", "expected"), [("https://EVENTS.SESSIONS.EXAMPLE/heath", "api"), ("https://notsessions.example/heath", None), ("https://feed.example", "feed.example"), (None, None)])
def test_infer_source(spark, url, expected):
    assert one(spark, lambda u: C.infer_source(u, HOSTS), url) == expected


def test_source_matches_and_rank(spark):
    assert one(spark, lambda s, u: C.source_matches(s, u, HOSTS), "api", "https://sessions.example/x") is True
    assert one(spark, lambda s, u: C.source_matches(s, u, HOSTS), "API", "https://sessions.example/x") is False
    assert one(spark, lambda s, u: C.source_matches(s, u, HOSTS), None, None) is False
    assert [one(spark, lambda s: C.source_rank(s, ["b", "a"]), v) for v in ("b", "a", "x", None)] == [0, 1, 2, 2]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("2026-04-03T10:00", "2026-04-03"), ("12-14 May 2026", "2026-05-12"), ("May 3, 2026", "2026-05-03"), ("3 Sep 2026", "2026-09-03"), ("20260413", "2026-04-13"), ("  3   September  2026 ", "2026-09-03"), ("soon", None), ("", None), (None, None)],
)
def test_flexible_date(spark, text, expected):
    got = one(spark, C.flexible_date, text)
    assert (got and str(got)) == expected


@pytest.mark.parametrize(
    ("name", "conf", "due", "expected"),
    [
        ("Heron 2026 North", None, None, "heron-north-2026"), ("Fog Gathering", None, "2027-01-10", "fog-gathering-2027"), ("Saltmarsh", "2027-01-20", None, "saltmarsh-2027"),
        ("Café Conf", None, None, "caf-conf-2026"), ("2026", None, None, "-2026"), (None, None, None, None),
    ],
)
def test_slug(spark, name, conf, due, expected):
    assert one(spark, lambda a, b, c: C.slug_of(a, b, c, F.lit("2026-04-30").cast("date")), name, conf, due) == expected


@pytest.mark.parametrize(("slug", "url", "expected"), [("heron-2031-2032", None, "Heron 2031"), ("2032", "https://fogmoor.example/", "fogmoor.example"), ("big-data-days", None, "Big Data Days"), (None, None, None)])
def test_name(spark, slug, url, expected):
    assert one(spark, C.name_of, slug, url) == expected


def test_segments(spark):
    assert one(spark, C.first_segment, "https://s.example/devs-2026/sessions") == "devs-2026"
    assert one(spark, C.first_segment, "s.example/devs-2026") is None
    assert one(spark, C.last_segment, "https://s.example/a/b/") == "b"
    assert one(spark, C.last_segment, "s.example/devs") == "devs"


@pytest.mark.parametrize(("word", "text", "hit"), [("ai", "robotics and ai", True), ("ai", "rails conf", False), ("java", "javacro'26", True), ("c++", "c++ days", False), ("", "x", False), ("ml", "ml", True)])
def test_keyword(spark, word, text, hit):
    assert one(spark, C.keyword_hit, word, text) is hit


def test_epoch_day_is_utc_and_guarded(spark):
    df = spark.createDataFrame([(1775689200000,), (9223372036854775807,), (None,), (-1,)], "x bigint").select(C.epoch_ms_date(F.col("x")).alias("d"))
    assert [r["d"] for r in df.collect()] == [datetime.date(2026, 4, 8), None, None, datetime.date(1969, 12, 31)]


def test_notes(spark):
    assert one(spark, lambda n: C.append_note(n, F.lit("M")), "a") == "a | M"
    assert one(spark, lambda n: C.append_note(n, F.lit("M")), "a | M") == "a | M"
    assert one(spark, lambda n: C.append_note(n, F.lit("M")), None) == "M"
    day = F.lit("2026-06-01").cast("date")
    assert one(spark, lambda n: C.stale_prefix(n, day), "[stale since 2026-05-01] x") == "[stale since 2026-06-01] x"
    assert one(spark, C.strip_stale, "[stale since 2026-05-01] x") == "x"


def test_url_quoted(spark):
    assert one(spark, C.url_quoted, "a b/ü") == "a%20b/%C3%BC"
