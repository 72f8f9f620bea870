"""Versioned store, run state, documents and the landing stream."""

import json
import threading

import pytest

from siftline.sources import documents as D
from siftline.sources import store as S
from siftline.streaming.landing import activity_windows, upsert_stream

SCHEMA = "slug string, v string, user_actioned boolean"


def test_commits_are_versions(spark, tmp_path):
    table = S.TableStore(spark, tmp_path / "t", keep=2)
    assert table.read() is None
    first = table.upsert(spark.createDataFrame([("a", "1", None), ("b", "1", True)], SCHEMA), "slug", "user_actioned")
    assert first == {"written": 2, "skipped_protected": 0, "total_records": 2}
    old = table.read()
    assert table.upsert(spark.createDataFrame([("a", "2", None), ("b", "2", None)], SCHEMA), "slug", "user_actioned") == {"written": 1, "skipped_protected": 1, "total_records": 2}
    assert {r["v"] for r in old.collect()} == {"1"} and {(r["slug"], r["v"]) for r in table.read().collect()} == {("a", "2"), ("b", "1")}
    assert table.version == 2
    assert table.upsert(spark.createDataFrame([("b", "3", None)], SCHEMA), "slug", "user_actioned")["written"] == 0 and table.version == 2


def test_damaged_pointer_is_an_error(spark, tmp_path):
    (tmp_path / "current").write_text("junk")
    with pytest.raises(ValueError, match="names no version"):
        S.TableStore(spark, tmp_path).read()


def test_lock_times_out_and_no_update_is_lost(spark, tmp_path):
    with S.locked(tmp_path / "x"), pytest.raises(S.LockTimeout), S.locked(tmp_path / "x", 0.1):
        pass
    table = S.TableStore(spark, tmp_path / "t")
    work = [spark.createDataFrame([(f"k{i}", "1", None)], SCHEMA) for i in range(3)]
    threads = [threading.Thread(target=table.upsert, args=(w, "slug", "user_actioned")) for w in work]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert {r["slug"] for r in table.read().collect()} == {"k0", "k1", "k2"}


@pytest.mark.parametrize("bad", ["x", -1, "nan"])
def test_lock_wait_is_checked(bad):
    with pytest.raises(ValueError, match="lock wait"):
        S.effective_wait(bad)


def test_run_state(spark, tmp_path):
    run, df = S.RunState(spark, tmp_path / "r"), spark.createDataFrame([(1,)], "x int")
    assert run.begin("2026-06-01") == []
    for s in ("fetch", "candidates", "verify", "working_set", "verify"):
        run.save(s, df)
    assert run.begin("2026-06-01") == ["fetch", "candidates", "verify", "working_set"]
    assert run.load("verify").count() == 1
    assert run.invalidate("candidates", "other") == ["fetch"]
    with pytest.raises(LookupError):
        run.load("verify")
    with pytest.raises(ValueError, match="no stage name"):
        run.save("../x", df)
    assert run.begin("2026-06-02") == []
    (tmp_path / "r/manifest.json").write_text("{")
    assert run.begin("2026-06-02") == []
    run.done()
    assert not (tmp_path / "r").exists()


def test_cut_at(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "a")], "run int, pos int, stage string")
    assert sorted((r["run"], r["pos"]) for r in S.cut_at(rows, ["b", "c"]).collect()) == [(1, 1), (2, 1)]


def test_state_round_trip_keeps_what_columns_do_not_hold(spark, tmp_path):
    path = tmp_path / "state.json"
    text = {"_cfg": [1], "b": {"name": ["list"], "user_actioned": "true", "odd": {"x": 1}, "status": "open"}, "a": {"user_actioned": True}, "junk": 5}
    path.write_text(json.dumps(text))
    df, config = D.read_state(spark, path)
    rows = df.orderBy("ord").collect()
    assert [r["slug"] for r in rows] == ["b", "a"] and rows[0]["user_actioned"] is None and rows[1]["user_actioned"] is True
    assert json.loads(D.export_state(df, config)) == {k: v for k, v in text.items() if k != "junk"}
    assert D.read_state(spark, tmp_path / "none")[0].count() == 0
    for bad in ("[]", "{", "\ud800"):
        path.write_bytes(bad.encode("utf-8", "surrogatepass"))
        with pytest.raises(ValueError):
            D.read_state(spark, path)


def test_config_readers(tmp_path):
    p = tmp_path / "i.json"
    assert D.read_interests(p) == []
    p.write_text(" ")
    assert D.read_interests(p) == []
    p.write_text('{"priority_interests": [{"id": "a", "keywords": ["x"]}, {"label": "no id"}]}')
    assert [i["id"] for i in D.read_interests(p)] == ["a"]
    p.write_text('{"priority_interests": [{"id": "a", "keywords": "x"}]}')
    with pytest.raises(ValueError, match="no list"):
        D.read_interests(p)
    assert D.read_trips("{")[1] and D.read_trips('[{"uid": "u", "start": "2026-01-01T1", "end": "2026-01-02"}, {"uid": "item-1", "start": "x", "end": "y"}, 3]') == ([("u", "2026-01-01", "2026-01-02")], [])
    with pytest.raises(ValueError, match="entry 0"):
        D.read_cohort('[{"id": "", "cohort": "new"}]')
    assert D.read_cursor(tmp_path / "none") == (None, None)
    p.write_text("{")
    assert D.read_cursor(p)[1]


def test_feeds(spark, tmp_path):
    from pyspark.sql import functions as F

    (tmp_path / "a.json").write_text(json.dumps([{"untilDate": 2000000000000, "link": "", "conf": {"name": "N", "location": None, "hyperlink": "h", "date": [1775689200000, 1775600000000]}}, {"untilDate": 1, "conf": {"name": "old"}}, {"untilDate": 2000000000000, "conf": {"name": " "}}]))
    a = D.feed_a_candidates(D.feed_text(spark, str(tmp_path / "a.json"), D.FEED_A), F.lit(1700000000000)).collect()
    assert [(r["name"], r["city"], r["conf_date"], r["cfp_url"], r["deadline"]) for r in a] == [("N", "", "2026-04-07", "h", "2033-05-18")]
    (tmp_path / "b.json").write_text(json.dumps([{"name": "B", "cfpEndDate": "3 June 2026", "cfpLink": " l "}, {"name": "C", "cfpEndDate": "2026-05-31", "cfpLink": "l"}, {"name": "D", "cfpEndDate": "x", "cfpLink": "l"}]))
    b = D.feed_b_candidates(D.feed_text(spark, str(tmp_path / "b.json"), D.FEED_B), F.lit("2026-06-01").cast("date")).collect()
    assert [(r["name"], r["cfp_url"], r["deadline"]) for r in b] == [("B", "l", "2026-06-03")]
    (tmp_path / "c.json").write_text("no json")
    assert D.feed_text(spark, str(tmp_path / "c.json"), D.FEED_B).count() == 0


def test_stream_upserts_and_resumes(spark, tmp_path):
    land, table = tmp_path / "land", S.TableStore(spark, tmp_path / "t")
    schema = spark.createDataFrame([], SCHEMA + ", n int").schema
    store_rows = lambda: {(r["slug"], r["v"]) for r in table.read().collect()}
    for n, v in ((1, "1"), (2, "2")):
        spark.createDataFrame([("a", v, None, n), ("b", v, n == 1, n)], schema).write.mode("append").parquet(str(land))
        upsert_stream(spark, str(land), schema, table, "slug", "user_actioned", ["n"], str(tmp_path / "ck")).awaitTermination()
    assert store_rows() == {("a", "2"), ("b", "1")}


def test_windows(spark):
    rows = spark.createDataFrame([("2026-01-01 10:05:00", "u", 1.0), ("2026-01-01 10:55:00", "u", 2.0), ("2026-01-01 11:00:00", "u", 4.0)], "at string, k string, v double").selectExpr("cast(at as timestamp) at", "k", "v")
    assert sorted((r["n"], r["total"]) for r in activity_windows(rows, "at", "k", "v").collect()) == [(1, 4.0), (2, 3.0)]
