"""Operators on small tables whose results are known."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from siftline.functions import columns as C
from siftline.operators import gating, interests, maintain, resolve, skew, verify

HOSTS = [("sessions.example", "api"), ("feed.example", "feed.example"), ("beans.example", "beans.example")]
PRIO = ["beans.example", "api", "feed.example"]
STATE = "ord bigint, slug string, cfp_url string, source string, name string, city string, bot_notes string, user_actioned boolean, shown_in_brief boolean"


def identified(spark, rows):
    df = spark.createDataFrame(rows, STATE).withColumn("norm", C.url_identity(F.col("cfp_url")))
    return df, resolve.winner_order(F.col("user_actioned"), F.col("shown_in_brief"), C.source_matches(F.col("source"), F.col("cfp_url"), HOSTS), C.source_rank(F.col("source"), PRIO), F.col("slug"))


def groups(spark, rows):
    df, order = identified(spark, rows)
    return resolve.ranked(df, "norm", order, F.col("user_actioned"), "ord")


def winner(spark, rows):
    return [r["slug"] for r in groups(spark, rows).where("is_winner and not skipped").collect()]


U = "https://sessions.example/x"


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        ([(1, "a", U, "feed.example", "n", "c", "", None, None), (2, "b", U + "/", "api", "n", "c", "", None, None)], ["b"]),
        ([(1, "a", U, "api", "n", "c", "", None, None), (2, "b", U, "feed.example", "n", "c", "", None, True)], ["b"]),
        ([(1, "a", U, "api", "n", "c", "", None, True), (2, "b", U, "feed.example", "n", "c", "", True, None)], ["b"]),
        ([(1, "a", U, "feed.example", "n", "c", "", None, True), (2, "b", U, "api", "n", "c", "", None, True)], ["b"]),
        ([(1, "a", "https://own.example/x", "feed.example", "n", "c", "", None, None), (2, "b", "https://own.example/x", "beans.example", "n", "c", "", None, None)], ["b"]),
        ([(1, "a", U, "api", "n", "c", "", True, None), (2, "b", U, "api", "n", "c", "", True, None)], []),
        ([(1, "a", U, "api", "n", "c", "", None, None)], []),
        ([(1, "b", U, None, "n", "c", "", None, None), (2, "a", U, "odd", "n", "c", "", None, None)], ["a"]),
    ],
)
def test_winner_tiers(spark, rows, expected):
    assert winner(spark, rows) == expected


def test_gap_fill_and_notes(spark):
    rows = [(1, "a", U, "feed.example", "A", " ", "old", None, None), (2, "b", U, "api", None, None, "", None, None), (3, "c", U, "x", "C", "town", "old", None, None), (4, "d", U, "x", "D", "city", "new", None, None)]
    df, order = identified(spark, rows)
    made = lambda frozen: resolve.grouped(df, "norm", order, "user_actioned", "ord", "slug", ["name", "city"], "bot_notes", F.lit(frozen))
    for g in (made(False), resolve.grouped(df, "norm", order, "user_actioned", "ord", "slug", ["name", "city"])):
        assert {(r["field_name"], r["donor"]) for r in resolve.inherited(g, "norm", ["name", "city"]).collect()} == {("name", 1), ("city", 3)}
    notes = resolve.folded_notes(made(False), "norm").first()
    assert (notes["survivor"], notes["notes"], notes["n_merged"]) == (2, "[merged from a]: old | [merged from d]: new", 2)
    assert resolve.folded_notes(made(True), "norm").first()["n_merged"] == 0
    assert resolve.merge_report(made(False), ["name", "city"]).first().asDict() == {"groups_merged": 1, "rows_dropped": 3, "groups_skipped": 0, "notes_merged": 2, "fields_inherited": 2}
    lost = resolve.merges(resolve.ranked(df, "norm", order, F.col("user_actioned"), "ord"), "norm", "ord").collect()
    assert sorted((r["winner"], r["loser"]) for r in lost) == [(2, 1), (2, 3), (2, 4)]


def test_lookup_and_first_seen(spark):
    table = spark.createDataFrame([("h/x", "b"), ("h/x", "a"), (None, "z")], "norm string, slug string")
    probes = spark.createDataFrame([(1, "h/x"), (2, "h/y"), (3, None)], "i int, p string")
    assert {(r["i"], r["s"]) for r in resolve.lookup(probes, "p", table, "norm", "slug", "s").collect()} == {(1, "a"), (2, None), (3, None)}
    rows = spark.createDataFrame([(0, 1, "DupConf 2026"), (1, 2, " dupconf 2026 "), (1, 3, "Other")], "feed int, id int, name string")
    assert {r["id"] for r in resolve.first_seen(rows, resolve.name_key(F.col("name")), [F.col("feed"), F.col("id")]).collect()} == {1, 3}


def test_overlap_is_closed_on_both_sides(spark):
    rows = spark.createDataFrame([(1, "2026-05-20"), (2, "2026-05-16"), (3, "2026-05-15"), (4, "2026-05-23"), (5, None), (1, "2026-05-20")], "id int, day string").withColumn("day", F.to_date("day"))
    trips = spark.createDataFrame([("2026-05-20", "2026-05-22"), ("2026-05-09", "2026-05-01")], "start string, end string").select(F.to_date("start").alias("start"), F.to_date("end").alias("end"))
    assert sorted(r["id"] for r in gating.overlapping(rows, F.col("day"), 4, trips).collect()) == [3, 4, 5]
    assert sorted(r["id"] for r in gating.overlapping(rows, F.col("day"), 4, trips, how="left_semi").collect()) == [1, 1, 2]
    named = trips.withColumn("trip", F.lit("t"))
    assert {(r["id"], r["trip"]) for r in gating.first_overlap(rows, "id", F.col("day"), 4, named, "trip").collect()} == {(1, "t"), (2, "t")}


def test_state_gate(spark):
    cand = spark.createDataFrame([("sent", "2026-07-01"), ("far", "2026-07-01"), ("near", "2026-06-05"), ("open", "2026-07-01"), ("new", None)], "slug string, deadline string")
    state = spark.createDataFrame([("sent", "sent", None), ("far", "remind", 7), ("near", "remind", None), ("open", "expired", None)], "slug string, status string, remind_before_days int")
    got = gating.state_gate(cand, state, "slug", F.lit("2026-06-01").cast("date"), ["sent", "dismissed"], "remind")
    assert {r["slug"] for r in got.collect()} == {"near", "open", "new"} and got.columns == cand.columns


def test_prefixes_virtual_and_regions(spark):
    df = spark.createDataFrame([("BlockMe Summit", "Town"), ("Fine", "Online"), ("Remote Days", "Town"), ("Ok", "Lagos, Nigeria"), (None, None)], "name string, city string")
    left = gating.without_prefixes(df, "name", spark.createDataFrame([("blockme",), (None,)], "p string"))
    assert left.count() == 4
    assert [r[0] for r in df.select(gating.is_virtual(F.col("name"), F.col("city"))).collect()] == [False, True, True, False, True]
    assert [r[0] for r in df.select(gating.in_regions(F.col("city"), ["Nigeria"])).collect()] == [False, False, False, True, False]


@pytest.mark.parametrize(
    ("last", "reason"),
    [(None, "no_cursor"), ("x", "cursor_unparseable"), ("2026-06-01T00:00:00", "cursor_naive_datetime"), ("2026-06-09T00:00:00Z", "cursor_future"), ("2026-05-29T00:00:00Z", "cadence_elapsed"), ("2026-06-01T00:00:00Z", "within_cadence")],
)
def test_cadence(spark, last, reason):
    df = spark.createDataFrame([(last,)], "l string").select(gating.cadence(F.to_timestamp(F.lit("2026-06-02T00:00:00Z")), F.col("l")).alias("r"))
    assert df.first()["r"] == reason


def test_evidence(spark):
    schema = "run_date string, cohort_size bigint, slugs_expected bigint, verified bigint, dismissed bigint, dropped bigint"
    rows = [("2026-06-01", 3, 3, 1, 0, 0), ("2026-06-01", 0, 0, 0, 0, 0), ("2026-06-01", 2, 0, 0, 0, 0), ("2026-05-31", 3, 3, 3, 0, 0), (None, None, None, None, None, None), ("2026-06-01", None, None, None, None, None), ("2026-06-01", None, None, 1, None, None), ("2026-06-01", None, 0, None, None, None)]
    got = gating.evidence_state(spark.createDataFrame(rows, schema), F.lit("2026-06-01").cast("date")).collect()
    assert [(r["reason"], r["advance"]) for r in got] == [("live", True), ("none-required", True), ("no-evidence", False), ("other-date", False), ("other-date", False), ("no-evidence", False), ("live", True), ("none-required", True)]


def test_decisions(spark):
    cohort = spark.createDataFrame([(1, "stored", "k1", None, "api"), (2, "new", "k1", None, "api"), (3, "stored", "k2", None, "feed.example"), (4, "stored", None, None, "api"), (5, "stored", None, "https://sessions.example/k3/x", "api"), (6, "new", "k4", None, "api"), (7, "new", "k5", None, "api"), (8, "stored", None, "https://sessions.example/k6", None)], "id int, cohort string, slug string, cfp_url string, source string")
    plan = verify.routed(cohort, "api", HOSTS)
    routes = {r["id"]: (r["route"], r["fetch_slug"]) for r in plan.collect()}
    assert routes[3] == ("other", None) and routes[4][0] == "unverifiable" and routes[5] == ("fetch", "k3") and routes[8] == ("fetch", "k6") and routes[1][0] == "unverifiable"
    results = spark.createDataFrame([("k1", False, None, True, False, "2026-08-15T23:59:59", 1), ("k1", False, None, True, False, "2026-09-01", 2), ("k3", False, None, False, False, None, 1), ("k4", False, True, None, None, None, 1), ("k5", True, None, True, False, "2026-01-01", 1), ("k6", False, None, None, True, "2026-01-01", 1)], "slug string, has_error boolean, removed boolean, cfp_open boolean, is_online boolean, cfp_end_local string, n int")
    got = {r["id"]: (r["action"], r["reason"], r["new_deadline"]) for r in verify.decided(plan, verify.last_results(results, "slug", "n")).collect()}
    assert got[2] == ("verified", None, "2026-09-01") and got[5] == ("verify_failed", None, None) and got[6] == ("drop", "removed", None) and got[7] == ("verify_failed", None, None) and got[8] == ("dismiss", "online", None)
    counts = verify.summary(verify.decided(plan, results.limit(0))).first().asDict()
    assert counts == {"n_verified": 0, "n_dismiss": 0, "n_drop": 0, "n_verify_failed": 8}


def test_fetch_isolates_rows(spark):
    def fetch(slug):
        if slug == "boom":
            raise OSError("down")
        return {"gone": (404, ""), "bad": (500, ""), "list": (200, "[]")}.get(slug, (200, json.dumps({"name": slug, "cfpDates": {"endUtc": "2026-09-01T00:00:00Z"}})))

    slugs = spark.createDataFrame([(s,) for s in ("ok", "gone", "bad", "list", "boom")], "fetch_slug string")
    got = {r["slug"]: r for r in verify.fetched(slugs, fetch).collect()}
    assert got["gone"]["removed"] and got["bad"]["error"] == "status 500" and got["list"]["error"] == "no object" and "down" in got["boom"]["error"] and got["ok"]["error"] is None
    flat = verify.fetched(slugs.where("fetch_slug = 'ok'"), fetch).select(*verify.normalised_event(F.col("payload"), F.col("slug"), F.lit("2026-06-01 00:00:00").cast("timestamp_ntz"), "https://sessions.example/")).first()
    assert flat["cfp_open"] is True and flat["cfp_url"] == "https://sessions.example/ok/" and flat["city"] is None


def test_maintenance_is_idempotent(spark):
    schema = "slug string, status string, deadline string, source string, cfp_url string, bot_notes string, user_actioned boolean, name string, schema_version int"
    state = spark.createDataFrame([("a-2026", "open", "2026-01-01", None, "https://own.example/a", None, None, None, None), ("b", "open", "2026-01-01", None, U, None, None, "B", 1), ("c", "approved", None, "x", None, "n", None, " ", 2), ("d", "open", "2026-01-01", "x", None, None, True, None, 1), ("e", "sent", "2026-01-01", None, None, None, None, "E", 1), ("f", "open", "2027-01-01", None, None, None, None, "F", 1)], schema)
    day = F.lit("2026-06-01").cast("date")
    once, report = maintain.expired(state, day, "api", HOSTS, ["open", "approved"])
    assert report.first().asDict() == {"n_expired": 1, "n_skipped_protected": 1, "n_skipped_authority": 1, "n_skipped_no_deadline": 1}
    assert maintain.expired(once.drop("outcome"), day, "api", HOSTS, ["open", "approved"])[1].first()["n_expired"] == 0
    named, report = maintain.backfilled_name(state)
    assert report.first().asDict() == {"n_filled": 2, "n_named": 3, "n_protected": 1, "n_remaining": 0} and {r["name"] for r in named.where("slug = 'a-2026'").collect()} == {"A"}
    sourced, report = maintain.backfilled_source(state, HOSTS)
    assert maintain.backfilled_source(sourced, HOSTS)[1].agg(F.sum("n_filled")).first()[0] == 0
    assert maintain.stamped(state, 1)[1].first()["n_stamped"] == 2 and maintain.stamped(maintain.stamped(state, 1)[0], 1)[1].first()["n_stamped"] == 0


def test_key_audit(spark):
    rows = spark.createDataFrame([(1, "a", "https://sessions.example/a", "api"), (2, "b", "https://sessions.example/x", "api"), (3, "c", None, "api"), (4, "d", None, "y")], "ord int, slug string, cfp_url string, source string")
    assert {(r["ord"], r["finding"]) for r in maintain.key_audit(rows, "api").collect()} == {(1, "ok"), (2, "drifted"), (3, "missing")}


def test_guarded_upsert(spark):
    disk = spark.createDataFrame([("a", "1", None), ("b", "2", True), ("c", "3", False)], "slug string, v string, user_actioned boolean")
    work = spark.createDataFrame([("a", "9", None), ("b", "9", None), ("n", "9", None), ("_cfg", "9", None)], "slug string, v string, user_actioned boolean")
    got = {r["slug"]: (r["v"], r["outcome"]) for r in maintain.guarded_upsert(disk, work, "slug", "user_actioned").collect()}
    assert got == {"a": ("9", "updated"), "b": ("2", "skipped_protected"), "c": ("3", "untouched"), "n": ("9", "inserted")}


def test_interests(spark):
    rows = spark.createDataFrame([(1, "JavaCro'26", None, None), (2, "Rails Conf", None, None), (3, "AgentCon", "ai day", None), (4, None, None, "Beans.example")], "ord int, name string, notes string, source string")
    config = [{"id": "java", "keywords": ["java"], "sources": ["beans"]}, {"id": "ai", "keywords": ["AI"]}, {"id": "java", "keywords": ["agentcon"]}]
    assert {r["ord"]: r["interests"] for r in interests.matched(rows, "ord", "name", "notes", "source", config).collect()} == {1: ["java"], 2: [], 3: ["java", "ai"], 4: ["java"]}
    assert interests.matched(rows, "ord", "name", "notes", "source", []).first()["interests"] == []


def test_salted_join_and_pairs_equal_plain_ones(spark):
    rows = spark.createDataFrame([Row(k=0 if i % 3 else i, v=i) for i in range(300)])
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = skew.salted_join(rows, counts, ["k"], "n", part=10)
    assert sorted(map(tuple, got.select("k", "v", "n").collect())) == sorted(map(tuple, rows.join(counts, "k").select("k", "v", "n").collect()))
    right = spark.createDataFrame([(0, "a"), (0, "b"), (3, "c")], "k bigint, w string")
    pairs = skew.salted_pairs(rows, right, "k", part=10)
    assert sorted(map(tuple, pairs.select("k", "v", "w").collect())) == sorted(map(tuple, rows.join(right, "k").select("k", "v", "w").collect()))


def test_running_sum_equals_brute_force(spark):
    data = [(g, i, (i * 7) % 5 + 1) for g in ("a", "b") for i in range(50)]
    df = spark.createDataFrame(data, "g string, i int, v int")
    got = {(r["g"], r["i"]): r["s"] for r in skew.running_sum(df, ["g"], [F.col("i")], F.col("v"), "s", F.floor(F.col("i") / 10)).collect()}
    for g in ("a", "b"):
        total = 0
        for i in range(50):
            total += (i * 7) % 5 + 1
            assert got[g, i] == total
