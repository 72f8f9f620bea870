"""Reading JSON documents and feeds: strict where a mistake would lose records, lenient row by row elsewhere."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions.columns import epoch_ms_date, flexible_date, strip, usable

RECORD = T.StructType([
    T.StructField("ord", T.LongType()), T.StructField("slug", T.StringType()), T.StructField("schema_version", T.IntegerType()),
    *[T.StructField(n, T.StringType()) for n in ("status", "name", "city", "conf_date", "deadline", "cfp_url", "source", "updated", "last_verified")],
    T.StructField("matched_interests", T.ArrayType(T.StringType())), T.StructField("bot_notes", T.StringType()),
    T.StructField("user_actioned", T.BooleanType()), T.StructField("shown_in_brief", T.BooleanType()),
    T.StructField("remind_before_days", T.IntegerType()), T.StructField("raw", T.StringType()),
])


#: The same as a store keeps it: without the place and the text of a document, with the marks of a run.
STORED = T.StructType([*RECORD.fields[1:-1], T.StructField("stale", T.BooleanType()), T.StructField("_verify_failed", T.BooleanType())])


def _typed(value: object, kind: T.DataType) -> object:
    """The value when it is of the column's kind exactly; "true" and 1 are no booleans."""
    if isinstance(kind, T.BooleanType):
        return value if isinstance(value, bool) else None
    if isinstance(kind, T.IntegerType):
        return value if isinstance(value, int) and not isinstance(value, bool) else None
    if isinstance(kind, T.ArrayType):
        return [v for v in value if isinstance(v, str)] if isinstance(value, list) else None
    return value if isinstance(value, str) else None


def read_state(spark: SparkSession, path: str | Path) -> tuple[DataFrame, dict]:
    """(records, config) of one state document, in its order; a missing file is an empty table, a bad one an error.

    The document is one small file that the driver reads; keys with an
    underscore are config; `raw` keeps each record whole, so that nothing the
    columns don't hold is lost on the way out.
    """
    path = Path(path)
    if not path.exists():
        return spark.createDataFrame([], RECORD), {}
    found = json.loads(path.read_bytes().decode("utf-8"))
    if not isinstance(found, dict):
        raise ValueError(f"{path}: the root is no object")
    rows, config = [], {}
    for n, (k, v) in enumerate(found.items()):
        if k.startswith("_"):
            config[k] = v
        elif isinstance(v, dict):
            rows.append((n, k, *[_typed(v.get(f.name), f.dataType) for f in RECORD.fields[2:-1]], json.dumps(v, ensure_ascii=False)))
    return spark.createDataFrame(rows, RECORD), config


def export_state(df: DataFrame, config: dict) -> str:
    """The state document again: columns laid over each raw record where they differ from it; small, for the driver."""
    out = dict(config)
    for r in df.orderBy("ord").toLocalIterator():
        record = json.loads(r["raw"]) if r["raw"] else {}
        for f in RECORD.fields[2:-1]:
            if r[f.name] != _typed(record.get(f.name), f.dataType):
                record[f.name] = r[f.name]
        out[r["slug"]] = record
    return json.dumps(out, ensure_ascii=False, indent=2)


def read_interests(path: str | Path) -> list[dict]:
    """The interest list; missing or blank gives none, a malformed one is an error, entries without an id are dropped."""
    path = Path(path)
    text = path.read_text() if path.exists() else ""
    if not text.strip():
        return []
    found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError("interests: the root is no object")
    rows = found.get("priority_interests") or []
    if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
        raise ValueError("interests: no list of objects")
    for r in rows:
        for field in ("keywords", "sources"):
            if not isinstance(r.get(field, []), list):
                raise ValueError(f"interests: {field} is no list")
    return [r for r in rows if isinstance(r.get("id"), str) and r["id"]]


COHORT = ("id", "cohort", "cfp_url", "source", "slug")


def read_cohort(text: str) -> list[dict]:
    """Entries to verify from a JSON array; any wrong entry is an error that names it."""
    found = json.loads(text)
    if not isinstance(found, list):
        raise ValueError("cohort: the root is no array")
    for n, e in enumerate(found):
        if not isinstance(e, dict) or not isinstance(e.get("id"), str) or not e["id"] or e.get("cohort") not in ("new", "stored"):
            raise ValueError(f"cohort: entry {n} lacks an id or a cohort of new or stored")
        if any(e.get(f) is not None and not isinstance(e[f], str) for f in COHORT):
            raise ValueError(f"cohort: entry {n} has a field that is no text")
    return found


def read_trips(text: str | None, most: int | None = None) -> tuple[list[tuple[str, str, str]], list[str]]:
    """(trips, warnings) from a JSON array; bad input degrades to a warning, bad rows are left out."""
    try:
        found = json.loads(text or "")
        if not isinstance(found, list):
            raise ValueError("no array")
    except ValueError as e:
        return [], [f"trips: {e}"]
    ok = [t for t in found if isinstance(t, dict) and all(isinstance(t.get(k), str) for k in ("uid", "start", "end")) and "item-" not in t["uid"]]
    return [(t["uid"], t["start"][:10], t["end"][:10]) for t in ok[:most]], []


def read_cursor(path: str | Path) -> tuple[str | None, str | None]:
    """(last run, error): no file is no error."""
    path = Path(path)
    if not path.exists():
        return None, None
    try:
        found = json.loads(path.read_text())
    except (OSError, ValueError) as e:
        return None, str(e)
    if not isinstance(found, dict) or found.get("schema_version") != 1:
        return None, "not a cursor of version 1"
    return found.get("last_run") if isinstance(found.get("last_run"), str) else None, None


FEED_A = "array<struct<untilDate:bigint,link:string,conf:struct<name:string,location:string,hyperlink:string,date:array<bigint>>>>"
FEED_B = "array<struct<name:string,locationName:string,date:string,cfpEndDate:string,cfpLink:string>>"


def feed_text(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Entries of landed feed documents, one row each with `ord`; a document that is no such array gives none."""
    docs = spark.read.text(path, wholetext=True)
    return docs.select(F.posexplode(F.from_json("value", schema)).alias("ord", "e")).select(F.col("ord").cast("bigint").alias("ord"), "e.*")


def http_get(url: str, timeout: float = 15.0) -> bytes:
    """The body of one response; whatever is not a success raises."""
    with urllib.request.urlopen(url, timeout=timeout) as response:
        return response.read()


def fetch_feed(spark: SparkSession, label: str, fetch: Callable[[], bytes | str], schema: str, warnings: list[str]) -> DataFrame:
    """Entries of one feed, which is one response; a feed that fails or is no array gives no rows and one warning, an entry that is no object none."""
    try:
        found = json.loads(body.decode("utf-8", errors="replace") if isinstance(body := fetch(), bytes) else body)
    except Exception as e:  # noqa: BLE001 - whatever fails, the other feed still counts
        warnings.append(f"{label} unreachable: {e}")
        found = []
    if not isinstance(found, list):
        warnings.append(f"{label}: unexpected format (not a list)")
        found = []
    good = [(n, json.dumps(e)) for n, e in enumerate(found) if isinstance(e, dict)]
    entry = schema.removeprefix("array<").removesuffix(">")
    rows = spark.createDataFrame(good, "ord bigint, body string")
    return rows.select("ord", F.from_json("body", entry).alias("e")).select("ord", "e.*")


def gathered(spark: SparkSession, fetch_a: Callable[[], bytes | str], fetch_b: Callable[[], bytes | str], now_ms: int, today: str) -> tuple[DataFrame, list[str]]:
    """(candidates of both feeds, warnings): a feed that fails costs its own candidates only; none at all is a warning of its own."""
    warnings: list[str] = []
    a = feed_a_candidates(fetch_feed(spark, "feed A", fetch_a, FEED_A, warnings), F.lit(now_ms)).withColumn("feed", F.lit(0))
    b = feed_b_candidates(fetch_feed(spark, "feed B", fetch_b, FEED_B, warnings), F.lit(today).cast("date")).withColumn("feed", F.lit(1))
    both = a.unionByName(b)
    if both.isEmpty():
        warnings.append("both feeds are empty: look elsewhere")
    return both, warnings


def feed_a_candidates(entries: DataFrame, now_ms: Column, order: str = "ord") -> DataFrame:
    """Candidates of the first feed: still open at the instant, named, in one flat shape."""
    rows = entries.where((F.col("untilDate") > now_ms) & usable(F.col("conf.name")))
    return rows.select(
        F.col(order).alias("ord"), F.col("conf.name").alias("name"), F.coalesce("conf.location", F.lit("")).alias("city"),
        epoch_ms_date(F.array_min("conf.date")).cast("string").alias("conf_date"), F.coalesce(F.nullif("link", F.lit("")), "conf.hyperlink").alias("cfp_url"),
        epoch_ms_date(F.col("untilDate")).cast("string").alias("deadline"),
    )


def feed_b_candidates(entries: DataFrame, today: Column, order: str = "ord") -> DataFrame:
    """Candidates of the second feed: named, with an end date that reads and has not passed."""
    due = flexible_date(F.col("cfpEndDate"))
    rows = entries.where(usable(F.col("name")) & usable(F.col("cfpLink")) & (due >= today))
    return rows.select(
        F.col(order).alias("ord"), F.col("name"), F.coalesce("locationName", F.lit("")).alias("city"), flexible_date(F.col("date")).cast("string").alias("conf_date"),
        strip(F.col("cfpLink")).alias("cfp_url"), due.cast("string").alias("deadline"),
    )
