"""Filters and gates that need a second table or a clock: states, intervals, prefixes, freshness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.columns import days_left, iso_date, usable
from siftline.operators.skew import PART_ROWS, known_key

#: Words that make a place or a name virtual, and days a conference is taken to last: fixed values.
VIRTUAL = ["online", "virtual", "remote", "hybrid"]
CONFERENCE_DAYS = 4
#: A prefix list is a config table; a longer one is refused, not cut.
MAX_PREFIXES = 10_000


def is_virtual(name: Column, city: Column) -> Column:
    """Whether a record is online only by its words, or names no place."""
    words = "|".join(VIRTUAL)
    hit = lambda c: F.coalesce(F.lower(c).rlike(words), F.lit(False))
    return hit(city) | hit(name) | ~usable(city)


def in_regions(city: Column, regions: list[str]) -> Column:
    """Whether a place text contains one of the region names."""
    low = F.lower(F.coalesce(city, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(r.lower())) for r in regions], F.lit(False))


def without_prefixes(df: DataFrame, name: str, prefixes: DataFrame) -> DataFrame:
    """Rows whose name starts with none of the prefixes, whatever its case."""
    few = [r[0].lower() for r in prefixes.limit(MAX_PREFIXES + 1).collect() if r[0]]
    if len(few) > MAX_PREFIXES:
        raise ValueError("more prefixes than a config table may hold")
    starts = reduce(lambda a, b: a | b, [F.lower(F.col(name)).startswith(p) for p in few], F.lit(False))
    return df.where(~F.coalesce(starts, F.lit(False)))


def state_gate(candidates: DataFrame, state: DataFrame, key: str, as_of: Column, hidden: list[str], remind: str, remind_default: int = 7) -> DataFrame:
    """Candidates that the state doesn't hide: hidden statuses go, reminders wait until their days are left.

    `candidates` has `key` and `deadline`; `state` has `key`, `status` and `remind_before_days`.
    """
    known = state.select(F.col(key).alias("__k"), F.col("status").alias("__s"), F.col("remind_before_days").alias("__r"))
    joined = candidates.join(known, known_key(F.col(key), *candidates.columns) == F.concat(F.lit("="), F.col("__k")), "left")
    due = days_left(F.col("deadline"), as_of) <= F.coalesce("__r", F.lit(remind_default))
    keep = F.when(F.col("__s").isin(hidden), False).when(F.col("__s") == remind, due).otherwise(True)
    return joined.where(keep).drop("__k", "__s", "__r")


def _months(start: Column, end: Column) -> Column:
    """Every month that an interval of dates touches, as numbers; a reversed interval touches none."""
    n = lambda d: F.year(d) * 12 + F.month(d)
    return F.when(end >= start, F.sequence(n(start), n(end)))


def overlapping(df: DataFrame, start: Column, days: int, intervals: DataFrame, on: list[str] = (), how: str = "left_anti") -> DataFrame:
    """Rows whose [start, start + days] meets (left_semi) or doesn't meet (left_anti) an interval of the other table.

    `intervals` has `start` and `end`, both inclusive.  Whether a row meets one
    depends on its day and its `on` columns only, so each of those is asked
    once.  The months that both touch are an equality key, so that the join is
    no nested loop.  Rows without a start, or with a NULL in `on`, meet nothing.
    """
    left = df.withColumn("__a", start)
    asked = left.where(F.col("__a").isNotNull()).select("__a", *on).distinct()
    probe = asked.select("__a", *[F.col(c).alias("__on_" + c) for c in on], F.explode(_months(F.col("__a"), F.date_add("__a", days))).alias("__m"))
    other = intervals.select(*[F.col(c).alias("__i_" + c) for c in on], F.col("start").alias("__s"), F.col("end").alias("__e"), F.explode(_months(F.col("start"), F.col("end"))).alias("__n"))
    cond = (F.col("__m") == F.col("__n")) & (F.col("__a") <= F.col("__e")) & (F.date_add("__a", days) >= F.col("__s"))
    for c in on:
        cond &= F.col("__on_" + c) == F.col("__i_" + c)
    met = probe.join(other, cond, "left_semi").select("__a", *[F.col("__on_" + c).alias(c) for c in on]).distinct()
    return left.join(met, ["__a", *on], how).select(*df.columns)


def first_overlap(df: DataFrame, row_id: str, start: Column, days: int, intervals: DataFrame, label: str) -> DataFrame:
    """(row_id, label): the earliest interval that each row meets."""
    left = df.select(F.col(row_id), start.alias("__a"), F.date_add(start, days).alias("__b")).where(F.col("__a").isNotNull())
    left = left.withColumn("__m", F.explode(_months(F.col("__a"), F.col("__b"))))
    other = intervals.select(label, F.col("start").alias("__s"), F.col("end").alias("__e"), F.explode(_months(F.col("start"), F.col("end"))).alias("__n"))
    met = left.join(other, (F.col("__m") == F.col("__n")) & (F.col("__a") <= F.col("__e")) & (F.col("__b") >= F.col("__s")))
    return met.groupBy(row_id).agg(F.min_by(label, F.struct("__s", label)).alias(label))


def evidence_state(row: DataFrame, today: Column) -> DataFrame:
    """Adds `advance` and `reason` to evidence rows: whether a run shows that it did its work; a row without a total shows nothing."""
    total = F.coalesce("cohort_size", "slugs_expected")
    done = F.coalesce("verified", F.lit(0)) + F.coalesce("dismissed", F.lit(0)) + F.coalesce("dropped", F.lit(0))
    reason = F.when(~F.col("run_date").eqNullSafe(today.cast("string")), "other-date").when(total == 0, "none-required").when(done >= 1, "live").otherwise("no-evidence")
    return row.withColumns({"reason": reason, "advance": reason.isin("none-required", "live")})


def cadence(now: Column, last_run: Column, hours: int = 60, error: Column | None = None) -> Column:
    """Why a run should start: cursor_error, no_cursor, cursor_unparseable, cursor_naive_datetime, cursor_future, cadence_elapsed; or within_cadence."""
    zoned = last_run.rlike(r"(?:[zZ]|[+-]\d{2}:?\d{2})$")
    t = F.unix_timestamp(F.try_to_timestamp(last_run))
    n = F.unix_timestamp(now)
    return (
        F.when(F.lit(False) if error is None else error.isNotNull(), "cursor_error").when(last_run.isNull() | (last_run == ""), "no_cursor").when(t.isNull(), "cursor_unparseable").when(~zoned, "cursor_naive_datetime")
        .when(t > n, "cursor_future").when(n - t >= hours * 3600, "cadence_elapsed").otherwise("within_cadence")
    )


def wake(reason: Column) -> Column:
    """Whether a run starts: for every reason but a run within its cadence, unknown ones included."""
    return F.coalesce(reason != "within_cadence", F.lit(True))


def is_stale(last_verified: Column, failed: Column, as_of: Column, days: int = 7) -> Column:
    """Whether a row may not be shown: its check failed, or the last one is missing or too old."""
    seen = iso_date(last_verified)
    return F.coalesce(failed, F.lit(False)) | seen.isNull() | (F.datediff(as_of, seen) > days)


def urgency(days: Column) -> Column:
    """now, week, month or later, by the days left."""
    return F.when(days <= 3, "now").when(days <= 7, "week").when(days <= 31, "month").otherwise("later")


def by_urgency(df: DataFrame, days: Column, as_of: Column, statuses: list[str]) -> DataFrame:
    """Live rows with `urgency` and `place`, their rank within it by days left and `ord`; what has passed is left out.

    Ranks are counted in ranges of `ord` of a day, whose totals are few and shift the
    numbers that each part gives its own rows; so rows of one day, or without
    any, are ranked by many tasks.
    """
    rows = df.where(F.coalesce(F.col("status").isin(statuses), F.lit(False)) & (days >= 0)).withColumns({"__d": days, "__p": F.floor(F.col("ord") / PART_ROWS), "urgency": urgency(days)})
    totals = rows.groupBy("urgency", "__d", "__p").agg(F.count("*").alias("__n"))
    before = totals.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy("urgency").orderBy("__d", "__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__d", "__p", "__before")
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy("__d", "__p").orderBy("ord")))
    return ranked.join(before, ["__d", "__p"]).withColumn("place", F.col("__r") + F.col("__before")).drop("__d", "__p", "__r", "__before")


def suppressed(df: DataFrame, last_verified: str, failed: str, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(shown, held back): rows that may be shown, and those for the suppression log."""
    stale = is_stale(F.col(last_verified), F.col(failed), as_of)
    return df.where(~stale), df.where(stale)


def emphasised(verified_this_run: Column, end: Column, now: Column, hours: int = 48) -> Column:
    """Whether a row deserves emphasis: verified in this run and ending within the hours."""
    left = F.unix_timestamp(F.try_to_timestamp(end)) - F.unix_timestamp(now)
    return F.coalesce(verified_this_run, F.lit(False)) & F.coalesce(left.between(0, hours * 3600), F.lit(False))


def heartbeat_fresh(last_checked: Column, since: Column) -> Column:
    """Whether the freshness marker reads and is not before `since`."""
    return F.coalesce(F.try_to_timestamp(last_checked) >= F.try_to_timestamp(since), F.lit(False))


def freshness_stamp(config: dict, advance: bool, now: str) -> dict:
    """The config with its freshness marker moved on, or with the mark of a refused run."""
    rest = {k: v for k, v in config.items() if k != "_last_checked_skipped"}
    return rest | {"_last_checked": now} if advance else rest | {"_last_checked_skipped": now}
