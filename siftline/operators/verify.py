"""Routing rows to an authority, fetching its answers, and deciding on them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.columns import cohort_slug, open_until, source_of_host, url_host
from siftline.operators.skew import known_key


def routed(cohort: DataFrame, authority: str, table: list[tuple[str, str]]) -> DataFrame:
    """Adds `fetch_slug` and `route`: authority rows with a key, without one, and all others."""
    slug = cohort_slug(F.col("cohort"), F.col("slug"), F.col("cfp_url"))
    # step by step: the planner computes what is used more than once only once when it is a column
    rows = cohort.withColumn("__host", url_host(F.col("cfp_url")))
    rows = rows.withColumn("__ours", F.coalesce(F.coalesce(F.nullif("source", F.lit("")), source_of_host(F.col("__host"), table)) == authority, F.lit(False)))
    rows = rows.withColumn("fetch_slug", F.when(F.col("__ours"), slug))
    return rows.withColumn("route", F.when(~F.col("__ours"), "other").when(F.col("fetch_slug").isNull(), "unverifiable").otherwise("fetch")).drop("__host", "__ours")


def distinct_slugs(plan: DataFrame, order: str) -> DataFrame:
    """(fetch_slug, ord): each key to fetch once, by its first row."""
    return plan.where(F.col("route") == "fetch").groupBy("fetch_slug").agg(F.min(order).alias("ord"))


def fetched(slugs: DataFrame, fetch: Callable[[str], tuple[int, str]], parallel: int = 10) -> DataFrame:
    """(slug, payload, removed, error): one answer per key, at most `parallel` requests at a time.

    `fetch` gives (status, body).  404 means removed; any other failure and a
    body that is no JSON object become an error of that row alone.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for slug in batch["fetch_slug"]:
                try:
                    status, body = fetch(slug)
                    good = status == 200 and isinstance(json.loads(body), dict)
                    error = None if good or status == 404 else f"status {status}" if status != 200 else "no object"
                    out.append((slug, body if good else None, True if status == 404 else None, error))
                except Exception as e:  # noqa: BLE001 - one row's failure is that row's result
                    out.append((slug, None, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(out, columns=["slug", "payload", "removed", "error"])

    return slugs.select("fetch_slug").repartition(parallel).mapInPandas(rows, "slug string, payload string, removed boolean, error string")


EVENT = "struct<name:string,isOnline:boolean,cfpLink:string,cfpDates:struct<startUtc:string,endUtc:string,start:string,`end`:string>,eventDates:struct<start:string,`end`:string>,location:struct<city:string,country:string,full:string>,timezone:struct<iana:string>,website:string,organizer:string>"


def normalised_event(payload: Column, slug: Column, as_of: Column, base: str) -> list[Column]:
    """Columns of a flat event from its JSON; missing groups give NULLs, a missing address the key's."""
    e = F.from_json(payload, EVENT)
    g = lambda p: e.getField(p[0]) if len(p) == 1 else e.getField(p[0]).getField(p[1])
    names = {"name": ["name"], "is_online": ["isOnline"], "cfp_start_utc": ["cfpDates", "startUtc"], "cfp_end_utc": ["cfpDates", "endUtc"], "cfp_end_local": ["cfpDates", "end"], "conf_start": ["eventDates", "start"], "conf_end": ["eventDates", "end"], "city": ["location", "city"], "country": ["location", "country"], "timezone": ["timezone", "iana"], "website": ["website"], "organizer": ["organizer"]}
    link = F.coalesce(F.nullif(g(["cfpLink"]), F.lit("")), F.concat(F.lit(base), slug, F.lit("/")))
    return [slug.alias("slug"), *[g(p).alias(n) for n, p in names.items()], link.alias("cfp_url"), open_until(g(["cfpDates", "endUtc"]), as_of).alias("cfp_open")]


def last_results(results: DataFrame, slug: str, order: str) -> DataFrame:
    """Of results delivered again the last one per key; an aggregate with map-side combination."""
    rest = [c for c in results.columns if c != slug]
    return results.where(F.col(slug).isNotNull()).groupBy(slug).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(slug, *[F.col(f"__r.`{c}`").alias(c) for c in rest])


#: Notes of dismissed rows; all begin with DISMISSED, which note_violations asks for.
DISMISSED = "Dismissed: "
REMOVED = DISMISSED + "REMOVED — the authority no longer has the event."
CLOSED = DISMISSED + "MISSED — the call closed on %s."
ONLINE = DISMISSED + "ONLINE — the event is held online only."


def decided(plan: DataFrame, results: DataFrame) -> DataFrame:
    """Adds `action`, `reason`, `new_deadline`, `note` (why a row is dismissed) and `end_local` (of a verified one) to the routed rows, by their key's result.

    The order of the rules decides: no result or an error, removed, closed,
    online, no end date, verified.  Unknown flags are neither true nor false.
    """
    r = results.select(F.col("slug").alias("__slug"), F.lit(True).alias("__hit"), F.col("has_error").alias("__err"), F.col("removed").alias("__removed"), F.col("cfp_open").alias("__open"), F.col("is_online").alias("__online"), F.nullif("cfp_end_local", F.lit("")).alias("__full"), F.left(F.nullif("cfp_end_local", F.lit("")), F.lit(10)).alias("__end"))
    rows = plan.join(r, known_key(F.col("fetch_slug"), *[c for c in plan.columns if c not in ("fetch_slug", "route")]) == F.concat(F.lit("="), F.col("__slug")), "left")
    new = F.col("cohort") == "new"
    gone, shut, online = F.col("__removed").eqNullSafe(True), F.col("__open").eqNullSafe(False), F.col("__online").eqNullSafe(True)
    failed = F.col("__hit").isNull() | F.coalesce("__err", F.lit(False))
    action = (
        F.when(failed, "verify_failed").when(gone, F.when(new, "drop").otherwise("dismiss"))
        .when(shut, F.when(new, "drop").when(F.col("__end").isNull(), "verify_failed").otherwise("dismiss"))
        .when(online, F.when(new, "drop").otherwise("dismiss")).when(F.col("__end").isNull(), "verify_failed").otherwise("verified")
    )
    reason = F.when(failed, None).when(gone, "removed").when(shut, "closed").when(online, "online")
    note = F.when(reason == "removed", REMOVED).when(reason == "closed", F.format_string(CLOSED, F.col("__end"))).when(reason == "online", ONLINE)
    return rows.withColumns({
        "action": action, "reason": F.when(action.isin("drop", "dismiss"), reason), "new_deadline": F.when(action == "verified", F.col("__end")),
        "note": F.when(action == "dismiss", note), "end_local": F.when(action == "verified", F.col("__full")),
    }).drop("__slug", "__hit", "__err", "__removed", "__open", "__online", "__end", "__full")


ACTIONS = ["verified", "dismiss", "drop", "verify_failed"]


def summary(decisions: DataFrame) -> DataFrame:
    """One row with the count of every action, zeros included."""
    return decisions.agg(*[F.count_if(F.col("action") == a).alias("n_" + a) for a in ACTIONS])


def evidence(decisions: DataFrame, run_date: str) -> DataFrame:
    """One row on what a run did: cohort and distinct keys, whether anything was fetched, counts of actions."""
    ours = decisions.where(F.col("route") != "other").groupBy("route", "fetch_slug", "action").agg(F.count("*").alias("n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return ours.agg(
        F.lit(run_date).alias("run_date"), total("n").alias("cohort_size"), F.count_distinct(F.when(F.col("route") == "fetch", F.col("fetch_slug"))).alias("slugs_expected"),
        *[total(F.when(F.col("action") == a, F.col("n"))).alias({"dismiss": "dismissed", "drop": "dropped"}.get(a, a)) for a in ACTIONS],
    ).withColumn("live_call", F.col("slugs_expected") > 0)
