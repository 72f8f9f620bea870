"""Discovery: all open events of an authority, less online ones, user groups and keys already known."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.columns import last_segment, truthy

OPEN = "array<struct<name:string,isOnline:string,isUserGroup:string,cfpLink:string,cfpDates:struct<endUtc:string,`end`:string>,eventDates:struct<start:string,`end`:string>,location:struct<city:string,country:string,full:string>>>"


def fetch_open(spark: SparkSession, fetch: Callable[[], tuple[int, str]]) -> DataFrame:
    """One row per event of the authority's list, in its order; any failure, and a body that is no array, raises.

    The list is one response that the driver receives; everything after it is a DataFrame.
    """
    status, body = fetch()
    if status != 200:
        raise RuntimeError(f"discovery failed with status {status}")
    found = json.loads(body)
    if not isinstance(found, list):
        raise ValueError("discovery: the root is no array")
    # flags may be of any kind; as text they keep what truth test they need
    for e in found:
        for k in ("isOnline", "isUserGroup"):
            if isinstance(e, dict) and k in e:
                e[k] = "1" if e[k] else ""
    good = [e for e in found if isinstance(e, dict)]
    return spark.createDataFrame([(json.dumps(good),)], "body string").select(F.posexplode(F.from_json("body", OPEN)).alias("ord", "e")).select(F.col("ord").cast("bigint").alias("ord"), "e.*")


def _flagged(events: DataFrame, known: DataFrame, key: str) -> DataFrame:
    slug = F.nullif(last_segment(F.col("cfpLink")), F.lit(""))
    rows = events.withColumns({"slug": slug, "__in": ~truthy(F.col("isOnline")) & ~truthy(F.col("isUserGroup"))})
    seen = known.select(F.col(key).alias("slug"), F.lit(True).alias("__known")).where(F.col("slug").isNotNull() & ~F.col("slug").startswith("_")).distinct()
    return rows.join(seen, "slug", "left").withColumn("__known", F.coalesce("__known", F.lit(False)))


def open_candidates(events: DataFrame, known: DataFrame, key: str = "slug") -> tuple[DataFrame, DataFrame]:
    """(candidates, counts): events to take in, and how many were seen, kept, known, without a key, and new.

    Past deadlines and repeated keys stay, as later steps deal with them.
    """
    rows = _flagged(events, known, key)
    kept, new = F.col("__in"), F.col("__in") & F.col("slug").isNotNull() & ~F.col("__known")
    counts = rows.agg(
        F.count("*").alias("events_seen"), F.count_if(kept).alias("after_filter"), F.count_if(kept & F.col("slug").isNotNull() & F.col("__known")).alias("skipped_existing"),
        F.count_if(kept & F.col("slug").isNull()).alias("skipped_no_slug"), F.count_if(new).alias("candidates_new"),
    )
    day: Column = F.left(F.nullif(F.coalesce("cfpDates.end", "cfpDates.endUtc"), F.lit("")), F.lit(10))
    out = rows.where(new).select("ord", "slug", "name", F.coalesce("location.full", "location.city").alias("city"), F.col("eventDates.start").alias("conf_date"), F.col("cfpLink").alias("cfp_url"), day.alias("deadline"))
    return out, counts
