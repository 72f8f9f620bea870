"""Queries over the operators on records and runs: discovery, events, feedback, notes, merges, markers, commits and stages."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import columns as C
from siftline.operators import discover, gating, maintain, resolve, verify
from siftline.operators.skew import shared_folder
from siftline.plans import core
from siftline.plans.core import AS_OF, AUTHORITY, HOSTS, _DECIDE, _RANKED, as_of, s_infer, s_iso, s_name, s_usable
from siftline.sources.store import RunState, TableStore
from siftline.sources.tables import read
from siftline.streaming import landing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    """Registers a query under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _state(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "cfp_state")


# --- events of an authority --------------------------------------------------------------
BASE = "https://callboard.example/"


def _payload() -> F.Column:
    """Each result as the JSON that the authority sends: nested, groups missing where nothing is in them, no object now and then."""
    text = lambda c: F.col(c).cast("string")
    event = F.struct(
        F.col("organizer"), F.col("website"), F.col("is_online").alias("isOnline"), F.struct(text("cfp_end_local").alias("end"), text("cfp_end_local").alias("endUtc")).alias("cfpDates"),
        F.struct(text("conf_start").alias("start"), text("conf_end").alias("end")).alias("eventDates"), F.struct("city", "country").alias("location"), F.struct(F.col("timezone").alias("iana")).alias("timezone"),
    )
    return F.when(F.coalesce("has_error", F.lit(False)), F.lit("[1]")).otherwise(F.to_json(event))


@query(f"""SELECT check_id, slug, nullif(city, '') AS city, country, conf_start, timezone, CASE WHEN is_online THEN 'yes' WHEN NOT is_online THEN 'no' END AS online, '{BASE}' || slug || '/' AS cfp_url
  FROM (SELECT check_id, slug, CASE WHEN ok THEN city END AS city, CASE WHEN ok THEN country END AS country, CASE WHEN ok THEN conf_start END AS conf_start, CASE WHEN ok THEN timezone END AS timezone, CASE WHEN ok THEN is_online END AS is_online FROM (SELECT *, NOT coalesce(has_error, false) AS ok FROM event_results))""")
def event_normalise(spark, d):
    rows = read(spark, d, "event_results").select("check_id", "slug", _payload().alias("payload"))
    flat = rows.select("check_id", *verify.normalised_event(F.col("payload"), F.col("slug"), F.lit(AS_OF + " 00:00:00").cast("timestamp_ntz"), BASE))
    online = F.when(F.col("is_online"), "yes").when(~F.col("is_online"), "no")
    return flat.select("check_id", "slug", F.nullif("city", F.lit("")).alias("city"), "country", "conf_start", "timezone", online.alias("online"), "cfp_url")


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Results in the shape of a discovery list: flags as texts, of any content."""
    return read(spark, d, "event_results").select(
        F.col("check_id").alias("ord"), F.col("organizer").alias("name"), F.when(F.col("is_online"), "1").otherwise("").alias("isOnline"), F.when(F.col("removed"), "false").alias("isUserGroup"),
        F.concat(F.lit(BASE), F.col("slug"), F.lit("/")).alias("cfpLink"), F.struct(F.col("cfp_end_local").alias("endUtc"), F.lit(None).cast("string").alias("end")).alias("cfpDates"),
        F.struct(F.col("conf_start").alias("start"), F.col("conf_end").alias("end")).alias("eventDates"), F.struct("city", "country", F.lit(None).cast("string").alias("full")).alias("location"),
    )


_FOUND = "SELECT e.*, s.slug IS NOT NULL AS known, NOT coalesce(is_online, false) AND NOT coalesce(removed, false) AS wanted FROM event_results e LEFT JOIN (SELECT DISTINCT slug FROM cfp_state) s ON e.slug = s.slug"
@query(f"SELECT check_id AS ord, slug, left(nullif(cfp_end_local, ''), 10) AS deadline FROM ({_FOUND}) WHERE wanted AND slug IS NOT NULL AND NOT known")
def discovery_candidates(spark, d):
    return discover.open_candidates(_events(spark, d), _state(spark, d))[0].select("ord", "slug", "deadline")


@query(f"""SELECT count(*) AS events_seen, count(*) FILTER (wanted) AS after_filter, count(*) FILTER (wanted AND known) AS skipped_existing, count(*) FILTER (wanted AND slug IS NULL) AS skipped_no_slug,
  count(*) FILTER (wanted AND slug IS NOT NULL AND NOT known) AS candidates_new FROM ({_FOUND})""")
def discovery_counts(spark, d):
    return discover.open_candidates(_events(spark, d), _state(spark, d))[1]


_ROUTED = core._ROUTE
@query(f"WITH {_ROUTED} SELECT fetch_slug, min(arrival_id) AS ord FROM plan WHERE route = 'fetch' GROUP BY fetch_slug")
def keys_to_fetch(spark, d):
    return verify.distinct_slugs(core._plan(spark, d), "arrival_id")


@query(f"WITH {_ROUTED} SELECT DISTINCT fetch_slug AS slug, CASE WHEN length(fetch_slug) % 7 = 0 THEN 'removed' WHEN length(fetch_slug) % 7 = 1 THEN 'failed' ELSE 'found' END AS outcome FROM plan WHERE route = 'fetch'")
def fetch_outcomes(spark, d):
    """Every key asked of a stand-in authority, at most ten at a time; answers are found, removed or failed, row by row."""

    def authority(slug: str) -> tuple[int, str]:
        kind = len(slug) % 7
        return (404, "") if kind == 0 else (500, "") if kind == 1 else (200, json.dumps({"name": slug}))

    got = verify.fetched(keys_to_fetch(spark, d), authority)
    return got.select("slug", F.when(F.col("removed"), "removed").when(F.col("error").isNotNull(), "failed").otherwise("found").alias("outcome"))


# --- records --------------------------------------------------------------------------------
@query(f"SELECT slug, {s_name('slug', 'cfp_url')} AS name FROM cfp_state WHERE NOT {s_usable('name')} AND NOT coalesce(user_actioned, false) AND {s_name('slug', 'cfp_url')} IS NOT NULL")
def names_made(spark, d):
    return maintain.names_made(_state(spark, d))


@query(f"SELECT count(*) FILTER (NOT h AND i IS NOT NULL) AS n_backfilled, count(*) FILTER (h) AS n_skipped_existing, count(*) FILTER (NOT h AND i IS NULL) AS n_unsourced FROM (SELECT coalesce(source <> '', false) AS h, {s_infer('cfp_url')} AS i FROM cfp_state)")
def backfill_source_totals(spark, d):
    return maintain.source_totals(_state(spark, d), HOSTS)


_COMMANDS = "SELECT slug, CASE WHEN arrival_id % 3 = 0 THEN 'sent' WHEN arrival_id % 3 = 1 THEN 'remind' END AS status, CASE WHEN arrival_id % 3 = 1 THEN 5 END AS days, arrival_id % 3 = 2 AS gone, arrival_id AS ord FROM cfp_intake WHERE slug IS NOT NULL"
@query(f"""WITH c AS (SELECT slug, arg_max(status, ord) FILTER (true) AS x, max_by(struct_pack(status := status, days := days, gone := gone), ord) AS c FROM ({_COMMANDS}) GROUP BY slug)
  SELECT s.ord, coalesce(c.c.status, s.status) AS status, CAST(coalesce(c.c.days, s.remind_before_days) AS VARCHAR) AS remind_before_days, CASE WHEN c.slug IS NOT NULL THEN true ELSE s.user_actioned END AS user_actioned FROM cfp_state s LEFT JOIN c ON s.slug = c.slug WHERE NOT coalesce(c.c.gone, false)""")
def user_feedback(spark, d):
    """Users' commands, three kinds of them by the arrival's number: the last one per key counts."""
    kind = F.col("arrival_id") % 3
    commands = read(spark, d, "cfp_intake").where(F.col("slug").isNotNull()).select("slug", F.when(kind == 0, "sent").when(kind == 1, "remind").alias("status"), F.when(kind == 1, 5).alias("remind_before_days"), (kind == 2).alias("drop"), F.col("arrival_id").alias("ord"))
    return maintain.with_feedback(_state(spark, d), commands, "slug").select("ord", "status", F.col("remind_before_days").cast("string").alias("remind_before_days"), "user_actioned")


@query("SELECT ord, bot_notes FROM cfp_state WHERE status = 'dismissed' AND (NOT starts_with(coalesce(bot_notes, ''), 'Dismissed: ') OR contains(lower(coalesce(bot_notes, '')), 'dup'))")
def note_invariants(spark, d):
    return maintain.note_violations(_state(spark, d), "status", "bot_notes", [verify.DISMISSED], ["dup"]).select("ord", "bot_notes")


@query(r"SELECT ord, regexp_replace('[stale since 2026-01-01] ' || bot_notes, '^\[stale since \d{4}-\d{2}-\d{2}\] ?', '') AS stripped FROM cfp_state")
def stale_strip(spark, d):
    warned = C.stale_prefix(F.col("bot_notes"), F.lit("2026-01-01").cast("date"))
    return _state(spark, d).select("ord", F.when(F.col("bot_notes").isNotNull(), C.strip_stale(warned)).alias("stripped"))


@query(f"SELECT ord, CASE WHEN coalesce(user_actioned, false) THEN array_to_string(matched_interests, ',') WHEN m = '' THEN '' ELSE m END AS interests, CASE WHEN coalesce(user_actioned, false) THEN array_to_string(matched_interests, ',') END AS without_policy FROM (SELECT s.*, i.interests AS m FROM cfp_state s JOIN ({core.SQL['interest_match']}) i ON s.ord = i.ord)")
def interests_stored(spark, d):
    state = _state(spark, d)
    found = core.interests.matched(state, "ord", "name", "bot_notes", "source", core.INTERESTS)
    rows = state.select("ord", "matched_interests", "user_actioned").join(found, "ord")
    store = lambda policy: F.array_join(maintain.interests_to_store(F.lit(policy), F.col("interests"), F.col("matched_interests"), F.col("user_actioned")), ",")
    return rows.select("ord", store(True).alias("interests"), store(False).alias("without_policy"))


@query("SELECT ord, coalesce(_verify_failed, false) OR v IS NULL OR date_diff('day', v, DATE '" + AS_OF + f"') > 7 AS held FROM (SELECT *, {s_iso('last_verified')} AS v FROM cfp_state)")
def suppression_log(spark, d):
    shown, held = gating.suppressed(_state(spark, d), "last_verified", "_verify_failed", as_of())
    return held.select("ord", F.lit(True).alias("held")).unionByName(shown.select("ord", F.lit(False).alias("held")))


@query(f"SELECT ord, urgency, CAST(row_number() OVER (PARTITION BY urgency ORDER BY n, ord) AS BIGINT) AS place FROM (SELECT *, CASE WHEN n <= 3 THEN 'now' WHEN n <= 7 THEN 'week' WHEN n <= 31 THEN 'month' ELSE 'later' END AS urgency FROM (SELECT ord, status, coalesce(date_diff('day', DATE '{AS_OF}', {s_iso('deadline')}), 9999) AS n FROM cfp_state)) WHERE n >= 0 AND status IN ('open', 'approved')")
def urgency_order(spark, d):
    return gating.by_urgency(_state(spark, d), C.days_left(F.col("deadline"), as_of()), as_of(), core.EXPIRABLE).select("ord", "urgency", "place")


@query("SELECT event_id, event_type = 'purchase' AND date_diff('second', TIMESTAMP '2024-01-10 00:00:00', date_trunc('second', ts)) BETWEEN 0 AND 172800 AS emphasised, date_trunc('second', ts) >= TIMESTAMP '2024-01-10 00:00:00' AS fresh FROM events")
def emphasis_and_heartbeat(spark, d):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    start = "2024-01-10T00:00:00Z"
    return read(spark, d, "events").select("event_id", gating.emphasised(F.col("event_type") == "purchase", iso, F.to_timestamp(F.lit(start))).alias("emphasised"), gating.heartbeat_fresh(iso, F.lit(start)).alias("fresh"))


@query("""SELECT event_id, reason, reason <> 'within_cadence' AS wakes FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 'cursor_error' WHEN event_type = 'click' THEN 'no_cursor' WHEN t > TIMESTAMP '2024-01-28 12:00:00' THEN 'cursor_future'
  WHEN date_diff('second', t, TIMESTAMP '2024-01-28 12:00:00') >= 216000 THEN 'cadence_elapsed' ELSE 'within_cadence' END AS reason FROM (SELECT *, date_trunc('second', ts) AS t FROM events))""")
def cadence_reasons(spark, d):
    """Every event as a cursor: errors can't be read, clicks have none, the others are as old as they are."""
    error, last = F.when(F.col("event_type") == "error", "unreadable"), F.when(F.col("event_type") != "click", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    rows = read(spark, d, "events").select("event_id", gating.cadence(F.to_timestamp(F.lit("2024-01-28T12:00:00Z")), last, error=error).alias("reason"))
    return rows.select("event_id", "reason", gating.wake(F.col("reason")).alias("wakes"))


_MARK = "SELECT cohort, count(*) AS n, count(*) FILTER (source IS NULL) AS u FROM cfp_intake GROUP BY cohort"
@query(f"SELECT cohort, total, CASE WHEN total = '' THEN CASE WHEN n > 0 THEN 'live' ELSE 'no-evidence' END WHEN total = '0' THEN 'none-required' ELSE CASE WHEN n > 0 THEN 'live' ELSE 'no-evidence' END END AS reason FROM (SELECT cohort, total, CASE WHEN resolved THEN n ELSE 0 END AS n FROM ({_MARK}), (VALUES (''), ('0'), ('9')) t(total), (VALUES (true), (false)) r(resolved))")
def evidence_markers(spark, d):
    """Markers of every kind, with no total, none to verify and some, resolved or not: one without a total is no pass."""
    counts = read(spark, d, "cfp_intake").groupBy("cohort").agg(F.count("*").alias("n"))
    rows = counts.withColumn("total", F.explode(F.array(F.lit(""), F.lit("0"), F.lit("9")))).withColumn("resolved", F.explode(F.array(F.lit(True), F.lit(False))))
    rows = rows.select("cohort", "total", F.lit(AS_OF).alias("run_date"), F.nullif("total", F.lit("")).cast("bigint").alias("cohort_size"), F.lit(None).cast("bigint").alias("slugs_expected"), F.when(F.col("resolved"), F.col("n")).otherwise(0).alias("verified"), F.lit(0).alias("dismissed"), F.lit(0).alias("dropped"))
    return gating.evidence_state(rows, as_of()).select("cohort", "total", "reason")


# --- merges, commits, stages ----------------------------------------------------------------
@query(f"WITH {_RANKED} SELECT g.norm, w.ord AS winner, g.ord AS loser FROM groups g JOIN groups w ON g.norm = w.norm AND w.rn = 1 WHERE NOT g.skipped AND g.rn > 1")
def merge_list(spark, d):
    return resolve.merges(resolve.ranked(core._identified(spark, d), "norm", core._order(), F.col("user_actioned"), "ord"), "norm", "ord")


@query(f"WITH {_RANKED} SELECT s.ord FROM cfp_state s WHERE NOT EXISTS (SELECT 1 FROM groups g WHERE g.ord = s.ord AND NOT g.skipped AND g.rn > 1)")
def losers_deleted(spark, d):
    return _state(spark, d).join(merge_list(spark, d).select(F.col("loser").alias("ord")), "ord", "left_anti").select("ord")


@query(f"""WITH {_DECIDE} SELECT count(*) FILTER (cohort = 'new' AND (route = 'other' OR action = 'verified')) AS new_candidates_added, count(*) FILTER (cohort = 'stored' AND route <> 'other' AND action = 'verified') AS existing_verified,
  count(*) FILTER (cohort = 'stored' AND route <> 'other' AND action = 'verify_failed') AS existing_verify_failed, CASE WHEN count(*) FILTER (route <> 'other' AND action <> 'verify_failed') > 0 THEN 'live' WHEN count(*) FILTER (route <> 'other') = 0 THEN 'none-required' ELSE 'skipped' END AS verification FROM acted""")
def verification_report(spark, d):
    from siftline.plans.pipeline import verification_report as said

    decisions = core._decisions(spark, d)
    gate = gating.evidence_state(verify.evidence(decisions, AS_OF), as_of()).first()
    return spark.createDataFrame([tuple(said(decisions, gate["reason"], gate["advance"], AS_OF).values())[1:]], "new_candidates_added bigint, existing_verified bigint, existing_verify_failed bigint, verification string")


def _work(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "cfp_intake").where(F.col("slug").isNotNull() & F.col("cfp_url").isNotNull())
    return rows.groupBy("slug").agg(F.min_by("cfp_url", "arrival_id").alias("cfp_url")).withColumn("user_actioned", F.lit(None).cast("boolean"))


@query("""WITH i AS (SELECT slug, min_by(cfp_url, arrival_id) AS cfp_url FROM cfp_intake WHERE slug IS NOT NULL AND cfp_url IS NOT NULL GROUP BY slug)
  SELECT step, written, skipped_protected, total_records FROM (SELECT 'first' AS step, (SELECT count(*) FROM cfp_state) AS written, 0 AS skipped_protected, (SELECT count(*) FROM cfp_state) AS total_records
  UNION ALL SELECT 'second', (SELECT count(*) FROM i LEFT JOIN cfp_state s USING (slug) WHERE NOT coalesce(s.user_actioned, false)), (SELECT count(*) FROM i JOIN cfp_state s USING (slug) WHERE coalesce(s.user_actioned, false)), (SELECT count(*) FROM cfp_state FULL JOIN i USING (slug)))""")
def commit_report(spark, d):
    """Two guarded commits into a fresh store: the state, then the intake over it."""
    store = TableStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    first = store.upsert(_state(spark, d).select("slug", "cfp_url", "user_actioned"), "slug", "user_actioned")
    second = store.upsert(_work(spark, d), "slug", "user_actioned")
    return spark.createDataFrame([(n, r["written"], r["skipped_protected"], r["total_records"]) for n, r in (("first", first), ("second", second))], "step string, written bigint, skipped_protected bigint, total_records bigint")


@query("SELECT slug, cfp_url FROM cfp_state UNION ALL SELECT i.slug, i.cfp_url FROM (SELECT slug, min_by(cfp_url, arrival_id) AS cfp_url FROM cfp_intake WHERE slug IS NOT NULL AND cfp_url IS NOT NULL GROUP BY slug) i WHERE NOT EXISTS (SELECT 1 FROM cfp_state s WHERE s.slug = i.slug)")
def snapshot_after_upsert(spark, d):
    """What a reader finds after a commit of new keys beside one that changes nothing: a snapshot, and no new version."""
    store = TableStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    state = _state(spark, d).select("slug", "cfp_url", F.lit(True).alias("user_actioned"))
    store.upsert(state, "slug", "user_actioned")
    store.upsert(_work(spark, d), "slug", "user_actioned")
    version = store.version
    store.upsert(_work(spark, d).limit(0), "slug", "user_actioned")  # nothing to write: the version stays
    return store.read(version).select("slug", "cfp_url")


@query(f"WITH {_ROUTED} SELECT 'routes' AS stage, route AS kind, count(*) AS n_rows FROM plan GROUP BY route UNION ALL SELECT 'sources', coalesce(source, ''), count(*) FROM cfp_intake GROUP BY 2")
def resumed_stages(spark, d):
    """A run that saves two stages and a third, goes back to before the third, and reads what a second session finds to resume after."""
    root = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    stages = RunState(spark, root)
    stages.begin(AS_OF)
    stages.save("routes", core._plan(spark, d).groupBy(F.col("route").alias("kind")).agg(F.count("*").alias("n_rows")), AS_OF)
    for _ in range(2):  # saved again, a stage is listed once
        stages.save("sources", read(spark, d, "cfp_intake").groupBy(F.coalesce("source", F.lit("")).alias("kind")).agg(F.count("*").alias("n_rows")), AS_OF)
    stages.save("verdicts", stages.load("routes"), AS_OF)
    stages.invalidate("verdicts")
    again = RunState(spark, root)
    out = None
    for stage in again.begin(AS_OF):
        one = again.load(stage).select(F.lit(stage).alias("stage"), "kind", "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT user_id, count(*) AS n, CAST(count(DISTINCT event_type) AS BIGINT) AS kinds FROM events GROUP BY user_id")
def landed_events(spark, d):
    """The events as landed files, taken in by a stream that stops when all are read; every key once, the last event of each."""
    folder = f"{shared_folder(spark)}/landing-{uuid.uuid4().hex}"
    rows = read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds")).withColumn("user_actioned", F.lit(False))
    rows.repartition(3).write.parquet(folder + "/in")
    store = TableStore(spark, folder + "/table")
    landing.upsert_stream(spark, folder + "/in", rows.schema, store, "user_id", "user_actioned", ["n"], folder + "/checkpoint", per_batch=2).awaitTermination()
    return store.read().select("user_id", "n", "kinds")
