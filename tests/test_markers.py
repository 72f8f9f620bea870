"""Feeds that fail, markers, cursors and the envelope."""

import json
from datetime import UTC, datetime

from siftline.operators import verify
from siftline.sources import documents, markers

NOW = datetime(2026, 6, 1, 6, tzinfo=UTC)


def test_a_feed_that_fails_costs_only_its_own(spark):
    def down():
        raise OSError("no route")

    a = json.dumps([{"untilDate": 1790000000000, "link": "https://l.example/1", "conf": {"name": "Heron", "location": "Fen", "date": [1795000000000]}}, 7, {"untilDate": "soon"}])
    rows, warnings = documents.gathered(spark, lambda: a.encode(), down, 1780272000000, "2026-06-01")
    assert [(r["name"], r["city"], r["feed"]) for r in rows.collect()] == [("Heron", "Fen", 0)] and warnings == ["feed B unreachable: no route"]
    rows, warnings = documents.gathered(spark, lambda: "{}", lambda: "[", 0, "2026-06-01")
    assert rows.count() == 0 and warnings[0] == "feed A: unexpected format (not a list)" and warnings[1].startswith("feed B unreachable") and warnings[2].startswith("both feeds")


def test_evidence_goes_to_a_file_and_back(spark, tmp_path):
    decisions = spark.createDataFrame([("fetch", "k", "verified"), ("fetch", "k", "drop"), ("unverifiable", None, "verify_failed"), ("other", None, "verify_failed")], "route string, fetch_slug string, action string")
    path = tmp_path / "run" / "evidence.json"
    row = markers.write_evidence(path, verify.evidence(decisions, "2026-06-01"))
    assert row["cohort_size"] == 3 and row["slugs_expected"] == 1 and row["live_call"] is True
    assert markers.may_advance(spark, path, "2026-06-01") == (True, "live") and markers.may_advance(spark, path, "2026-06-02") == (False, "other-date")
    for text, reason in (("[]", "no-marker"), ("{", "no-marker"), ('{"run_date": "2026-06-01"}', "no-evidence"), ('{"run_date": "2026-06-01", "slugs_expected": 0}', "none-required"), ('{"run_date": "2026-06-01", "cohort_size": 2, "verified": true}', "no-evidence")):
        path.write_text(text)
        assert markers.may_advance(spark, path, "2026-06-01")[1] == reason
    assert markers.may_advance(spark, tmp_path / "none", "2026-06-01") == (False, "no-marker")


def test_cursor_and_wake(tmp_path):
    path = tmp_path / "c" / "cursor.json"
    assert markers.wake(path, NOW) == {"wake": True, "reason": "no_cursor"}
    assert markers.stamp_cursor(path, NOW) == "2026-06-01T06:00:00Z" and not markers.wake(path, NOW)["wake"]
    for text, reason in (("{", "cursor_error"), ('{"schema_version": 1, "last_run": "x"}', "cursor_unparseable"), ('{"schema_version": 1, "last_run": "2026-06-01T00:00:00"}', "cursor_naive_datetime"), ('{"schema_version": 1, "last_run": "2026-07-01T00:00:00Z"}', "cursor_future"), ('{"schema_version": 1, "last_run": "2026-05-29T18:00:00Z"}', "cadence_elapsed")):
        path.write_text(text)
        assert markers.wake(path, NOW)["reason"] == reason and markers.wake(path, NOW)["wake"]
    assert markers.wake(None, NOW)["reason"] == "precheck_error"


def test_heartbeat():
    assert markers.heartbeat({"_last_checked": "2026-06-01T06:00:00Z"}, NOW) == (True, "fresh")
    assert not markers.heartbeat({"_last_checked": "2026-06-01T05:59:59Z"}, NOW)[0] and not markers.heartbeat({"_last_checked": "x"}, NOW)[0] and not markers.heartbeat(None, NOW)[0]


def test_envelope(spark):
    got = json.loads(markers.envelope(spark.createDataFrame([(2, "ü", None), (1, "b", "x")], "ord int, name string, city string"), ["w"], "2026-06-01T06:00:00Z"))
    assert got == {"cfps": [{"ord": 2, "name": "ü", "city": None}, {"ord": 1, "name": "b", "city": "x"}], "warnings": ["w"], "checked_at": "2026-06-01T06:00:00Z"}
