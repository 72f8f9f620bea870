"""A run from given candidates: expiry, verification with its notes and warnings, resolution, interests, guarded commit, evidence gate and freshness, with one injected clock.

`daily` is the whole of it, from both feeds, trips, interests and the store to the
list that is given out; `listed` are its gates, `run` is what follows them.  An
authority's own discovery (`discover.open_candidates`) gives candidates for `run`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.columns import days_left, infer_source, iso_date, slug_of, source_matches, source_rank, stale_prefix, strip_stale, url_identity
from siftline.operators import gating, interests, maintain, resolve, verify
from siftline.operators.skew import checkpointed
from siftline.sources import documents, markers
from siftline.sources.store import RunState, TableStore


@dataclass
class Settings:
    """What differs between deployments."""

    authority: str
    hosts: list[tuple[str, str]]
    priority: list[str]
    expirable: list[str] = field(default_factory=lambda: ["open", "approved"])
    fills: list[str] = field(default_factory=lambda: ["name", "city", "conf_date"])
    interests: list[dict] | None = None


def listed(rows: DataFrame, state: DataFrame, trips: DataFrame, today: str, regions: list[str], prefixes: list[str], hidden: list[str]) -> DataFrame:
    """Candidates of the feeds that pass every gate, each name once, by deadline; `rows` come from the feed readers, with their `feed`."""
    day = F.lit(today).cast("date")
    rows = rows.withColumns({"slug": slug_of(F.col("name"), F.col("conf_date"), F.col("deadline"), day), "days_left": days_left(F.col("deadline"), day)})
    rows = rows.where(~gating.is_virtual(F.col("name"), F.col("city")) & ~gating.in_regions(F.col("city"), regions) & (F.col("days_left") >= 0))
    rows = gating.overlapping(rows, iso_date(F.col("conf_date")), gating.CONFERENCE_DAYS, trips)
    rows = gating.without_prefixes(rows, "name", rows.sparkSession.createDataFrame([(p,) for p in prefixes], "p string"))
    rows = gating.state_gate(rows, state, "slug", day, hidden, "remind")
    rows = resolve.first_seen(rows, resolve.name_key(F.col("name")), [F.col("feed"), F.col("ord")])
    return rows.select("ord", "name", "city", "conf_date", "cfp_url", "deadline", "slug", "days_left").orderBy(F.coalesce("deadline", F.lit("9999-99-99")), "ord")


def daily(store: TableStore, stages: RunState, fetch_a: Callable, fetch_b: Callable, trips: str | None, interests_file: str, results: DataFrame, now: str, config: dict, s: Settings, regions: list[str], prefixes: list[str], hidden: list[str]) -> tuple[dict, str]:
    """(report, envelope): one day's run from the feeds to the list; a feed or a trip list that fails costs its own rows and a warning."""
    spark, today = store.spark, now[:10]
    ms = int(datetime.fromisoformat(now.replace("Z", "+00:00")).timestamp() * 1000)
    rows, warnings = documents.gathered(spark, fetch_a, fetch_b, ms, today)
    known, more = documents.read_trips(trips)
    busy = spark.createDataFrame(known, "uid string, start string, end string").select(iso_date(F.col("start")).alias("start"), iso_date(F.col("end")).alias("end"))
    state = store.read()
    state = spark.createDataFrame([], documents.STORED) if state is None else state
    out = checkpointed(listed(rows, state, busy, today, regions, prefixes, hidden))
    fresh = out.withColumns({"source": infer_source(F.col("cfp_url"), s.hosts), "status": F.lit("open")})
    fresh = fresh.select(*[F.col(f.name) if f.name in fresh.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in state.schema.fields])
    report = run(store, stages, fresh, results, today, now, config, replace(s, interests=documents.read_interests(interests_file)))
    return report, markers.envelope(out, warnings + more, now)


def merged(state: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(state after identity resolution, keys of the rows that were merged away): winners with filled gaps and merged notes, and all rows of no group."""
    rows = state.withColumn("__norm", url_identity(F.col("cfp_url")))
    order = resolve.winner_order(F.col("user_actioned"), F.col("shown_in_brief"), source_matches(F.col("source"), F.col("cfp_url"), s.hosts), source_rank(F.col("source"), s.priority), F.col("slug"))
    frozen = F.coalesce("user_actioned", F.lit(False)) | F.coalesce("shown_in_brief", F.lit(False))
    groups = resolve.grouped(rows, "__norm", order, "user_actioned", "slug", "slug", s.fills, "bot_notes", frozen)
    lost = resolve.merges(resolve.ranked(rows, "__norm", order, F.col("user_actioned"), "slug"), "__norm", "slug").select(F.col("loser").alias("slug"))
    new = groups.where(~F.col("skipped")).select(
        F.col("w.id").alias("slug"), resolve.folded().alias("__m"),
        *[F.when(~F.col("w").getField("own_" + f) & ~F.col("w.p"), F.col("d_" + f).getField("v")).alias("__" + f) for f in s.fills],
    )
    kept = state.join(lost, "slug", "left_anti").join(new, "slug", "left")
    kept = kept.withColumns({"bot_notes": F.when(F.col("__m.n") > 0, F.col("__m.t")).otherwise(F.col("bot_notes")), **{f: F.coalesce("__" + f, f) for f in s.fills}})
    return kept.select(*state.columns), lost


def applied(decisions: DataFrame, today: str, columns: list[str]) -> DataFrame:
    """The rows that decisions leave, with what each may write: status, dates, the note of a dismissal, the warning of a failed check and its removal."""
    stored, fetch = F.col("cohort") == "stored", F.col("route") == "fetch"
    failed = F.col("action") == "verify_failed"
    # only an authority's rows can fail; any other row, and one that was verified, loses an old warning
    noted = F.when(F.col("writes_status") & (F.col("action") == "dismiss") & fetch, F.coalesce("note", "bot_notes")).when(F.col("writes_status") & failed & (F.col("route") != "other"), stale_prefix(F.col("bot_notes"), F.lit(today).cast("date")))
    noted = noted.when(F.col("writes_status"), strip_stale(F.col("bot_notes"))).otherwise(F.col("bot_notes"))
    new = {
        "status": F.when(fetch, F.coalesce("new_status", F.lit("open"))).otherwise(F.coalesce("status", F.lit("open"))),
        "last_verified": F.when(F.col("route") == "other", F.lit(today)).otherwise(F.col("new_last_verified")),
        "deadline": F.when(F.col("writes_fields"), F.coalesce("new_deadline", "deadline")).otherwise(F.col("deadline")),
        "_verify_failed": F.when(F.col("route") != "other", F.col("new_failed")), "updated": F.lit(today), "bot_notes": noted,
    }
    if "stale" in columns:
        new["stale"] = F.when(F.col("writes_fields"), F.when(failed & (F.col("route") != "other"), True)).otherwise(F.col("stale"))
    rows = decisions.where(F.col("action") != "drop").withColumns(new)
    # a new candidate that could not be verified may come back another day
    return rows.where(stored | (F.col("route") == "other") | (F.col("action") == "verified")).select(*columns)


def run(store: TableStore, stages: RunState, candidates: DataFrame, results: DataFrame, today: str, now: str, config: dict, s: Settings) -> dict:
    """Takes candidates and the authority's results into the store; gives the report with the new config.

    A stage that a broken run of the same day finished is read, not computed again.
    """
    day = F.lit(today).cast("date")
    done = stages.begin(today)
    state = store.read()
    state = candidates.limit(0) if state is None else state
    if "working_set" not in done or "merged_away" not in done:
        state = maintain.expired(maintain.backfilled_name(maintain.backfilled_source(state, s.hosts)[0])[0], day, s.authority, s.hosts, s.expirable)[0].drop("outcome")
        fresh = candidates.join(state.select("slug"), "slug", "left_anti").dropDuplicates(["slug"])
        cohort = state.where(F.col("status").isin(s.expirable)).withColumn("cohort", F.lit("stored")).unionByName(fresh.withColumn("cohort", F.lit("new")))
        stages.save("verify", verify.decided(verify.routed(cohort, s.authority, s.hosts), results), today)
        kept = applied(maintain.prioritised(stages.load("verify"), today), today, state.columns)
        rest = state.join(kept.select("slug"), "slug", "left_anti")
        whole, lost = merged(rest.unionByName(kept), s)
        if s.interests is not None and "matched_interests" in state.columns:
            found = interests.matched(whole, "slug", "name", "bot_notes", "source", s.interests).select("slug", F.col("interests").alias("__i"))
            whole = whole.join(found, "slug", "left").withColumn("matched_interests", maintain.interests_to_store(F.lit(True), F.col("__i"), F.col("matched_interests"), F.col("user_actioned"))).drop("__i")
        stages.save("working_set", whole, today)
        stages.save("merged_away", lost, today)
    decisions = stages.load("verify")
    gate = gating.evidence_state(verify.evidence(decisions, today), day).first()
    report = store.upsert(stages.load("working_set"), "slug", "user_actioned", stages.load("merged_away"))
    report["merged_away"] = report.pop("removed")
    after = store.read()
    _, held = gating.suppressed(after.where(F.col("status").isin(s.expirable)), "last_verified", "_verify_failed", day)
    stages.save("suppressed", held, today)  # the log of what may not be shown
    report["suppressed"] = stages.load("suppressed").count()
    dismissed_now = after.where(F.col("updated") == today)
    report["note_violations"] = maintain.note_violations(dismissed_now, "status", "bot_notes", [verify.DISMISSED], []).count()
    report |= verification_report(decisions, gate["reason"], gate["advance"], now)
    if gate["advance"]:
        stages.done()
    else:
        stages.invalidate("verify")
    return report | {"reason": gate["reason"], "config": gating.freshness_stamp(config, gate["advance"], now)}


def verification_report(decisions: DataFrame, reason: str, advance: bool, now: str) -> dict:
    """What a run says about itself: candidates added, stored rows verified and failed, and whether its work is evidenced."""
    stored, failed = F.col("cohort") == "stored", F.col("action") == "verify_failed"
    ours = F.col("route") != "other"
    counts = decisions.agg(
        F.count_if(~stored & (~ours | (F.col("action") == "verified"))).alias("new_candidates_added"), F.count_if(stored & ours & (F.col("action") == "verified")).alias("existing_verified"),
        F.count_if(stored & ours & failed).alias("existing_verify_failed"),
    ).first()
    return {"checked_at": now, **counts.asDict(), "verification": reason if advance else "skipped"}
