"""Small documents of a run that the driver reads and writes: evidence marker, cursor, wake-up decision, list envelope."""

from __future__ import annotations

import json
from datetime import UTC, datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.gating import evidence_state
from siftline.sources.documents import read_cursor
from siftline.sources.store import write_atomically

COUNTS = ("cohort_size", "slugs_expected", "verified", "dismissed", "dropped", "verify_failed")
CURSOR_VERSION = 1
CADENCE = timedelta(hours=60)


def write_evidence(path: str | Path, evidence: DataFrame) -> dict:
    """The one row of `verify.evidence` as a marker file; a failure to write is an error, never silence."""
    row = evidence.first().asDict()
    write_atomically(path, json.dumps(row, indent=2) + "\n")
    return row


def read_evidence(spark: SparkSession, path: str | Path) -> DataFrame:
    """A marker file as one row, none when it is missing, unreadable or no object; what is no whole number counts as missing."""
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        found = None
    rows = []
    if isinstance(found, dict):
        count = lambda v: v if isinstance(v, int) and not isinstance(v, bool) else None
        day = found.get("run_date")
        rows = [(day if isinstance(day, str) else None, *[count(found.get(n)) for n in COUNTS])]
    return spark.createDataFrame(rows, "run_date string, " + ", ".join(f"{n} bigint" for n in COUNTS))


def may_advance(spark: SparkSession, path: str | Path, today: str) -> tuple[bool, str]:
    """Whether the freshness marker may move on, and why: without a marker it may not."""
    row = evidence_state(read_evidence(spark, path), F.lit(today).cast("date")).first()
    return (row["advance"], row["reason"]) if row else (False, "no-marker")


def stamp_cursor(path: str | Path, now: datetime) -> str:
    """Writes the instant of a finished run, whole or not at all."""
    iso = now.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    write_atomically(path, json.dumps({"schema_version": CURSOR_VERSION, "last_run": iso}, indent=2) + "\n")
    return iso


def heartbeat(config: dict | None, since: datetime) -> tuple[bool, str]:
    """Whether the freshness marker of the state is from this run, which began at `since`."""
    last = (config or {}).get("_last_checked")
    if not isinstance(last, str):
        return False, "no freshness marker"
    try:
        at = datetime.fromisoformat(last.replace("Z", "+00:00"))
    except ValueError:
        return False, f"the freshness marker is no instant: {last!r}"
    at = at if at.tzinfo else at.replace(tzinfo=UTC)
    return (True, "fresh") if at >= since else (False, f"the freshness marker {last} is from before this run")


def wake(path: str | Path, now: datetime) -> dict:
    """Whether a run starts, and why; whatever goes wrong, it starts."""
    try:
        last, error = read_cursor(path)
        if error is not None:
            return _said("cursor_error", error=error)
        if not last:
            return _said("no_cursor")
        try:
            at = datetime.fromisoformat(last.replace("Z", "+00:00"))
        except ValueError:
            return _said("cursor_unparseable", last_run=last)
        if at.tzinfo is None:
            return _said("cursor_naive_datetime", last_run=last)
        age = now - at
        reason = "cursor_future" if age < timedelta(0) else "cadence_elapsed" if age >= CADENCE else "within_cadence"
        return _said(reason, last_run=last, age_hours=round(age.total_seconds() / 3600, 2))
    except Exception as e:  # noqa: BLE001 - a fault here must never keep runs from starting
        return _said("precheck_error", error=f"{type(e).__name__}: {e}")


def _said(reason: str, **data: object) -> dict:
    return {"wake": reason != "within_cadence", "reason": reason, **data}


def envelope(cfps: DataFrame, warnings: list[str], checked_at: str) -> str:
    """The list that a run gives out, in the order of its rows, with its warnings and its instant; one short document for people."""
    rows = [json.loads(r[0]) for r in cfps.select(F.to_json(F.struct(*cfps.columns), {"ignoreNullFields": "false"})).toLocalIterator()]
    return json.dumps({"cfps": rows, "warnings": warnings, "checked_at": checked_at}, ensure_ascii=False, indent=2)
