"""Maintenance of a stored table: each pass gives the new rows and a one-row report, and a second pass changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.columns import append_note, effective_source, first_segment, infer_source, iso_date, name_of, usable



def expire_outcome(as_of: Column, authority: str, table: list[tuple[str, str]], statuses: list[str]) -> Column:
    """What expiry does to a row: other, skipped_protected, skipped_authority, skipped_no_deadline, kept or expired."""
    due = iso_date(F.col("deadline"))
    ours = F.coalesce(effective_source(F.col("source"), F.col("cfp_url"), table) == authority, F.lit(False))
    return (
        F.when(~F.coalesce(F.col("status").isin(statuses), F.lit(False)), "other").when(F.coalesce("user_actioned", F.lit(False)), "skipped_protected")
        .when(ours, "skipped_authority").when(due.isNull(), "skipped_no_deadline").when(due >= as_of, "kept").otherwise("expired")
    )


def expired(state: DataFrame, as_of: Column, authority: str, table: list[tuple[str, str]], statuses: list[str]) -> tuple[DataFrame, DataFrame]:
    """(state, report): rows past their deadline get the status and one note, once."""
    state = state.withColumn("outcome", expire_outcome(as_of, authority, table, statuses))
    out = F.col("outcome") == "expired"
    marker = F.concat(F.lit("Expired: deadline "), F.left("deadline", F.lit(10)), F.lit(" passed."))
    new = state.withColumns({"bot_notes": F.when(out, append_note(F.col("bot_notes"), marker)).otherwise(F.col("bot_notes")), "status": F.when(out, "expired").otherwise(F.col("status"))})
    kinds = ["expired", "skipped_protected", "skipped_authority", "skipped_no_deadline"]
    return new, state.agg(*[F.count_if(F.col("outcome") == k).alias("n_" + k) for k in kinds])


def backfilled_source(state: DataFrame, table: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(state, report per source): missing sources told by the address."""
    had = F.coalesce(F.col("source") != "", F.lit(False))
    new = state.withColumn("source", F.when(had, F.col("source")).otherwise(infer_source(F.col("cfp_url"), table)))
    told = state.select(had.alias("had"), F.when(had, F.col("source")).otherwise(infer_source(F.col("cfp_url"), table)).alias("source"))
    report = told.groupBy("source").agg(F.count("*").alias("n_rows"), F.count_if("had").alias("n_existing"), F.count_if(~F.col("had") & F.col("source").isNotNull()).alias("n_filled"))
    return new, report


def source_totals(state: DataFrame, table: list[tuple[str, str]]) -> DataFrame:
    """One row: sources told by the address, stated before, and still missing."""
    had, told = F.coalesce(F.col("source") != "", F.lit(False)), infer_source(F.col("cfp_url"), table)
    return state.agg(F.count_if(~had & told.isNotNull()).alias("n_backfilled"), F.count_if(had).alias("n_skipped_existing"), F.count_if(~had & told.isNull()).alias("n_unsourced"))


def names_made(state: DataFrame) -> DataFrame:
    """(slug, name): the names that `backfilled_name` makes."""
    made = name_of(F.col("slug"), F.col("cfp_url"))
    return state.where(~usable(F.col("name")) & ~F.coalesce("user_actioned", F.lit(False)) & made.isNotNull()).select("slug", made.alias("name"))


def backfilled_name(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, report): missing names made from the key, else the address; protected rows stay as they are."""
    had, safe = usable(F.col("name")), F.coalesce("user_actioned", F.lit(False))
    made = name_of(F.col("slug"), F.col("cfp_url"))
    new = state.withColumn("name", F.when(had | safe, F.col("name")).otherwise(F.coalesce(made, F.col("name"))))
    report = state.agg(
        F.count_if(~had & ~safe & made.isNotNull()).alias("n_filled"), F.count_if(had).alias("n_named"),
        F.count_if(~had & safe).alias("n_protected"), F.count_if(~had & ~safe & made.isNull()).alias("n_remaining"),
    )
    return new, report


def key_audit(state: DataFrame, authority: str) -> DataFrame:
    """Rows of the authority with `finding`: drifted when the address names another key, missing when it names none, else ok."""
    rows = state.where(F.col("source") == authority)
    named = F.nullif(first_segment(F.col("cfp_url")), F.lit(""))
    return rows.withColumns({"url_key": named, "finding": F.when(named.isNull(), "missing").when(named != F.col("slug"), "drifted").otherwise("ok")})


def stamped(state: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """(state, report): every row gets the schema version."""
    other = ~F.col("schema_version").eqNullSafe(F.lit(version))
    return state.withColumn("schema_version", F.lit(version)), state.agg(F.count("*").alias("n_rows"), F.count_if(other).alias("n_stamped"))


def guarded_upsert(disk: DataFrame, work: DataFrame, key: str, protected: str) -> DataFrame:
    """Disk rows replaced by work rows of their key, new keys added; protected disk rows win.  Adds `outcome`.

    Keys that begin with an underscore are config, no records, and are refused.
    """
    columns = [c for c in disk.columns if c != key]
    work = work.where(~F.col(key).startswith("_"))
    a = disk.select(F.col(key), F.lit(True).alias("__a"), F.struct(*columns).alias("__d"))
    b = work.select(F.col(key), F.lit(True).alias("__b"), F.struct(*columns).alias("__w"))
    both = a.join(b, key, "full_outer")
    safe = F.coalesce(F.col("__d").getField(protected), F.lit(False))
    outcome = F.when(F.col("__b").isNull(), "untouched").when(F.col("__a").isNull(), "inserted").when(safe, "skipped_protected").otherwise("updated")
    kept = F.when(outcome.isin("untouched", "skipped_protected"), F.col("__d")).otherwise(F.col("__w"))
    return both.select(key, kept.alias("__k"), outcome.alias("outcome")).select(key, *[F.col("__k").getField(c).alias(c) for c in columns], "outcome")


def prioritised(decisions: DataFrame, as_of: str) -> DataFrame:
    """Which fields a decision may write to a stored row: protected rows none, shown rows all but status and notes unless closed."""
    frozen, shown = F.coalesce("user_actioned", F.lit(False)), F.coalesce("shown_in_brief", F.lit(False))
    shut = (F.col("action") == "dismiss") & F.col("reason").isin("closed", "online")
    writes = ~frozen & (~shown | shut)
    verified = ~frozen & (F.col("action") != "verify_failed")
    return decisions.withColumns({
        "writes_status": writes, "writes_fields": ~frozen,
        "new_status": F.when(writes & (F.col("action") == "dismiss"), "dismissed").otherwise(F.col("status")),
        "new_last_verified": F.when(verified, F.lit(as_of)).otherwise(F.col("last_verified")),
        "new_failed": F.when(frozen, F.col("_verify_failed")).when(F.col("action") == "verify_failed", True),
    })


def tier(source: Column, name: Column, trusted: list[str], blocked: Column) -> Column:
    """approved for trusted sources, dismissed for blocked names, else left to judgement."""
    return F.when(source.isin(trusted), "approved").when(F.coalesce(blocked, F.lit(False)), "dismissed").otherwise("judge")


def interests_to_store(policy: Column, matched: Column, stored: Column, protected: Column) -> Column:
    """NULL without a policy, an empty list for no match, protected rows as they were."""
    return F.when(F.coalesce(protected, F.lit(False)), stored).when(policy, F.coalesce(matched, F.expr("cast(array() as array<string>)")))


def with_feedback(state: DataFrame, commands: DataFrame, key: str) -> DataFrame:
    """The state after users' commands (key, status, remind_before_days, drop), the last per key by `ord`.

    A command marks its row as decided by a user; `drop` deletes it; unknown keys do nothing.
    """
    last = commands.groupBy(key).agg(F.max_by(F.struct("status", "remind_before_days", "drop"), "ord").alias("__c"))
    rows = state.join(last, key, "left").where(~F.coalesce(F.col("__c.drop"), F.lit(False)))
    told = F.col("__c").isNotNull()
    return rows.withColumns({
        "status": F.coalesce("__c.status", "status"), "remind_before_days": F.coalesce("__c.remind_before_days", "remind_before_days"),
        "user_actioned": F.when(told, True).otherwise(F.col("user_actioned")),
    }).drop("__c").select(*state.columns)


def note_violations(state: DataFrame, status: str, notes: str, prefixes: list[str], banned: list[str]) -> DataFrame:
    """Dismissed rows whose note begins with no approved prefix or names a banned reason."""
    text = F.coalesce(F.col(notes), F.lit(""))
    starts, has = F.lit(False), F.lit(False)
    for p in prefixes:
        starts |= text.startswith(p)
    for b in banned:
        has |= F.contains(F.lower(text), F.lit(b.lower()))
    return state.where((F.col(status) == "dismissed") & (~starts | has))
