"""Discovery, feedback, freshness, and a whole run against the store."""

import json
import threading
from datetime import datetime
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from siftline.operators import discover, gating, maintain
from siftline.plans.pipeline import Settings, daily, run
from siftline.sources.documents import http_get
from siftline.sources.store import RunState, TableStore


def test_discovery(spark):
    events = [
        {"name": "A", "cfpLink": "https://s.example/a/", "cfpDates": {"end": "2026-07-01T10:00"}, "eventDates": {"start": "2026-10-01"}, "location": {"city": "X"}}, {"name": "On", "isOnline": True, "cfpLink": "https://s.example/b"},
        {"name": "Ug", "isUserGroup": "false", "cfpLink": "https://s.example/c"}, {"name": "Known", "cfpLink": "https://s.example/known", "isOnline": False}, {"name": "None", "cfpLink": ""}, 7,
    ]
    df = discover.fetch_open(spark, lambda: (200, json.dumps(events)))
    out, counts = discover.open_candidates(df, spark.createDataFrame([("known",), ("_cfg",), (None,)], "slug string"))
    assert [(r["slug"], r["city"], r["deadline"]) for r in out.collect()] == [("a", "X", "2026-07-01")]
    assert counts.first().asDict() == {"events_seen": 5, "after_filter": 3, "skipped_existing": 1, "skipped_no_slug": 1, "candidates_new": 1}
    with pytest.raises(RuntimeError):
        discover.fetch_open(spark, lambda: (500, ""))
    with pytest.raises(ValueError, match="no array"):
        discover.fetch_open(spark, lambda: (200, "{}"))


def test_freshness():
    assert gating.freshness_stamp({"_last_checked": "a", "_last_checked_skipped": "b", "_x": 1}, True, "n") == {"_last_checked": "n", "_x": 1}
    assert gating.freshness_stamp({"_last_checked": "a"}, False, "n") == {"_last_checked": "a", "_last_checked_skipped": "n"}


def test_gates(spark):
    df = spark.createDataFrame([("2026-06-01T00:00:00Z", True, "2026-06-02T10:00:00Z"), ("x", True, None), (None, False, "2026-06-01T05:00:00Z")], "at string, ok boolean, e string")
    now = F.to_timestamp(F.lit("2026-06-01T00:00:00Z"))
    assert [r[0] for r in df.select(gating.heartbeat_fresh(F.col("at"), F.lit("2026-06-01T00:00:00Z"))).collect()] == [True, False, False]
    assert [r[0] for r in df.select(gating.emphasised(F.col("ok"), F.col("e"), now)).collect()] == [True, False, False]
    rows = spark.createDataFrame([("2026-05-30", None), ("2026-05-01", None), (None, None), ("2026-05-30", True)], "v string, f boolean")
    shown, held = gating.suppressed(rows, "v", "f", F.lit("2026-06-01").cast("date"))
    assert shown.count() == 1 and held.count() == 3


def test_feedback_and_invariants(spark):
    state = spark.createDataFrame([("a", "open", None, None, "n"), ("b", "dismissed", None, True, "dedup artefact"), ("c", "dismissed", 3, None, "Dismissed: late")], "slug string, status string, remind_before_days int, user_actioned boolean, notes string")
    commands = spark.createDataFrame([("a", "sent", None, None, 1), ("a", "remind", 5, None, 2), ("c", None, None, True, 1), ("z", "sent", None, None, 1)], "slug string, status string, remind_before_days int, drop boolean, ord int")
    assert {(r["slug"], r["status"], r["remind_before_days"], r["user_actioned"]) for r in maintain.with_feedback(state, commands, "slug").collect()} == {("a", "remind", 5, True), ("b", "dismissed", None, True)}
    assert {r["slug"] for r in maintain.note_violations(state, "status", "notes", ["Dismissed:"], ["dedup"]).collect()} == {"b"}
    got = spark.createDataFrame([(None, ["x"], None), (["m"], None, None), (["m"], ["x"], True)], "m array<string>, s array<string>, p boolean")
    assert [r[0] for r in got.select(maintain.interests_to_store(F.lit(True), F.col("m"), F.col("s"), F.col("p"))).collect()] == [[], ["m"], ["x"]]
    assert got.select(maintain.interests_to_store(F.lit(False), F.col("m"), F.col("s"), F.lit(None).cast("boolean"))).first()[0] is None


STATE = "slug string, status string, name string, city string, conf_date string, deadline string, cfp_url string, source string, updated string, last_verified string, bot_notes string, user_actioned boolean, shown_in_brief boolean, _verify_failed boolean"


def row(slug, status="open", name="N", city="C", deadline="2027-01-01", url=None, source="feed.example", notes="", actioned=None):
    return (slug, status, name, city, None, deadline, url, source, None, None, notes, actioned, None, None)


def test_a_whole_run_and_its_repeat(spark, tmp_path):
    s = Settings("api", [("s.example", "api"), ("feed.example", "feed.example")], ["feed.example", "api"])
    store, stages = TableStore(spark, tmp_path / "t"), RunState(spark, tmp_path / "r")
    store.upsert(spark.createDataFrame([row("old", deadline="2026-01-01"), row("mine", status="sent", actioned=True), row("k1", url="https://s.example/k1", source="api"), row("twin", name=None, url="https://h.example/x", notes="t"), row("twin2", name="Two", url="https://h.example/x/", notes="u")], STATE), "slug", "user_actioned")
    fresh = spark.createDataFrame([row("k2", url="https://s.example/k2", source="api"), row("k3", url="https://s.example/k3", source="api"), row("plain")], STATE)
    results = spark.createDataFrame([("k1", False, None, False, None, "2026-05-01"), ("k2", False, None, True, False, "2026-09-01T00:00"), ("k3", False, True, None, None, None)], "slug string, has_error boolean, removed boolean, cfp_open boolean, is_online boolean, cfp_end_local string")
    report = run(store, stages, fresh, results, "2026-06-01", "2026-06-01T06:00:00Z", {}, s)
    got = {r["slug"]: r for r in store.read().collect()}
    assert set(got) == {"old", "mine", "k1", "twin", "k2", "plain"}
    assert got["old"]["status"] == "expired" and got["k1"]["status"] == "dismissed" and got["k2"]["deadline"] == "2026-09-01" and got["mine"]["status"] == "sent"
    assert got["twin"]["name"] == "Twin" and got["twin"]["bot_notes"] == "t | [merged from twin2]: u"
    assert got["k1"]["bot_notes"] == "Dismissed: MISSED — the call closed on 2026-05-01." and report["note_violations"] == 0
    assert (report["new_candidates_added"], report["existing_verified"], report["existing_verify_failed"], report["verification"]) == (2, 0, 0, "live")
    assert report["reason"] == "live" and report["config"]["_last_checked"] == "2026-06-01T06:00:00Z" and report["merged_away"] == 1
    again = run(store, stages, fresh, results, "2026-06-01", "2026-06-01T07:00:00Z", {}, s)
    assert again["merged_away"] == 0 and {r["slug"] for r in store.read().collect()} == set(got)


class _Beside(RunState):
    """Another writer commits while this run is about to."""

    def __init__(self, spark, root, store, rows):
        super().__init__(spark, root)
        self.store, self.rows = store, rows

    def load(self, stage):
        if stage == "merged_away" and self.rows is not None:
            self.store.upsert(self.rows, "slug", "user_actioned")
            self.rows = None
        return super().load(stage)


def test_a_run_keeps_what_another_writer_commits_meanwhile(spark, tmp_path):
    s = Settings("api", [("s.example", "api")], ["api"])
    store = TableStore(spark, tmp_path / "t")
    store.upsert(spark.createDataFrame([row("a", url="https://h.example/x"), row("b", url="https://h.example/x/"), row("c", url="https://h.example/x?y")], STATE), "slug", "user_actioned")
    beside = spark.createDataFrame([row("other"), row("c", url="https://h.example/x?y", status="sent", actioned=True)], STATE)
    results = spark.createDataFrame([], "slug string, has_error boolean, removed boolean, cfp_open boolean, is_online boolean, cfp_end_local string")
    report = run(store, _Beside(spark, tmp_path / "r", store, beside), spark.createDataFrame([row("new", url="https://n.example/")], STATE), results, "2026-06-01", "2026-06-01T06:00:00Z", {}, s)
    # b was merged into a; c, merged away too, has meanwhile been decided by a user and stays
    assert {r["slug"] for r in store.read().collect()} == {"a", "c", "new", "other"} and report["merged_away"] == 1


def test_warnings_of_failed_checks_come_and_go(spark, tmp_path):
    s = Settings("api", [("s.example", "api")], ["api"], interests=[{"id": "rust", "keywords": ["rust"]}])
    schema = STATE + ", stale boolean, matched_interests array<string>"
    store, stages = TableStore(spark, tmp_path / "t"), RunState(spark, tmp_path / "r")
    rows = [(*row("k1", url="https://s.example/k1", source="api", name="Rust Days", notes="x"), None, ["old"]), (*row("feed", source="feed.example", notes="[stale since 2026-01-01] y"), True, None), (*row("k2", url="https://s.example/k2", source="api", notes="[stale since 2026-01-01] z"), True, None)]
    store.upsert(spark.createDataFrame(rows, schema), "slug", "user_actioned")
    results = spark.createDataFrame([("k2", False, None, True, False, "2026-09-01T00:00")], "slug string, has_error boolean, removed boolean, cfp_open boolean, is_online boolean, cfp_end_local string")
    report = run(store, stages, store.read().limit(0), results, "2026-06-01", "2026-06-01T06:00:00Z", {}, s)
    got = {r["slug"]: r for r in store.read().collect()}
    assert (got["k1"]["bot_notes"], got["k1"]["stale"], got["k1"]["_verify_failed"], got["k1"]["matched_interests"]) == ("[stale since 2026-06-01] x", True, True, ["rust"])
    assert (got["feed"]["bot_notes"], got["feed"]["stale"], got["feed"]["_verify_failed"], got["feed"]["matched_interests"]) == ("y", None, None, [])
    assert (got["k2"]["bot_notes"], got["k2"]["deadline"], got["k2"]["last_verified"]) == ("z", "2026-09-01", "2026-06-01") and report["existing_verify_failed"] == 1 and report["suppressed"] == 1


def test_a_day_from_the_feeds_to_the_list(spark, tmp_path):
    ms = lambda day: int(datetime.fromisoformat(day + "T00:00:00+00:00").timestamp() * 1000)
    a = [{"untilDate": ms("2026-09-01"), "link": "https://l.example/heron", "conf": {"name": "Heron Rust Days", "location": "Fen", "date": [ms("2026-11-02")]}}, {"untilDate": ms("2026-09-01"), "link": "https://l.example/busy", "conf": {"name": "Busy", "location": "Fen", "date": [ms("2026-12-02")]}}]
    b = [{"name": "heron rust days", "locationName": "Fen", "date": "2 November 2026", "cfpEndDate": "1 September 2026", "cfpLink": "https://b.example/h"}, {"name": "Online Thing", "locationName": "Online", "date": "2026-10-01", "cfpEndDate": "2026-08-01", "cfpLink": "https://b.example/o"}]
    (tmp_path / "interests.json").write_text(json.dumps({"priority_interests": [{"id": "rust", "keywords": ["rust"]}]}))
    s = Settings("api", [("s.example", "api"), ("l.example", "list")], ["list", "api"])
    results = spark.createDataFrame([], "slug string, has_error boolean, removed boolean, cfp_open boolean, is_online boolean, cfp_end_local string")
    store, trips = TableStore(spark, tmp_path / "t"), json.dumps([{"uid": "t1", "start": "2026-12-01", "end": "2026-12-05"}, {"uid": "bad"}])
    report, out = daily(store, RunState(spark, tmp_path / "r"), lambda: json.dumps(a), lambda: json.dumps(b), trips, str(tmp_path / "interests.json"), results, "2026-06-01T06:00:00Z", {}, s, ["Nowhere"], ["blocked"], ["sent", "dismissed"])
    assert [(c["name"], c["days_left"]) for c in json.loads(out)["cfps"]] == [("Heron Rust Days", 92)] and json.loads(out)["warnings"] == []
    assert [(r["slug"], r["source"], r["matched_interests"]) for r in store.read().collect()] == [("heron-rust-days-2026", "list", ["rust"])]
    assert report["new_candidates_added"] == 1 and report["verification"] == "none-required" and report["written"] == 1


def test_http_get():
    class Page(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path == "/ok" else 404)
            self.end_headers()
            self.wfile.write(b"[1]")

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Page)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{server.server_port}"
        assert http_get(at + "/ok") == b"[1]"
        with pytest.raises(OSError, match="404"):
            http_get(at + "/no")
    finally:
        server.shutdown()
