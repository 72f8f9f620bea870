"""Entity resolution by an exact identity: winners, losers, gap filling, note merging, lookups.

Groups, winners, fills and notes are min-aggregates with map-side combination, so
a hot identity costs one row per map task.  Notes of a group come together, each
text once, in the one text that they become: a task holds what it returns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.columns import strip, usable
from siftline.operators.skew import known_key, salted_join


def winner_order(protected: Column, sticky: Column, matches: Column, rank: Column, key: Column) -> list[Column]:
    """Sort key of a group's rows: protected, sticky, source of the host, best source, smallest key."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return [~yes(protected), ~yes(sticky), ~yes(matches), rank, key]


def ranked(df: DataFrame, identity: str, order: list[Column], protected: Column, row_id: str) -> DataFrame:
    """Rows of groups of two and more with `winner`, `is_winner`, `n_group` and `skipped` (several protected rows).

    The winner is a min-aggregate over (order, id); a group too large for one
    task is spread over several when its rows get their flags.
    """
    rows = df.where(F.col(identity).isNotNull())
    first = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(row_id).alias("id"))
    groups = rows.groupBy(identity).agg(F.min(first).getField("id").alias("__w"), F.count("*").alias("n_group"), F.count_if(F.coalesce(protected, F.lit(False))).alias("__p"))
    groups = groups.where(F.col("n_group") > 1).select(identity, "__w", "n_group", (F.col("__p") > 1).alias("skipped"))
    return salted_join(rows, groups, [identity], "n_group", spread=F.xxhash64(row_id)).withColumn("is_winner", F.col(row_id) == F.col("__w")).withColumnRenamed("__w", "winner")


def first_seen(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key in `order`; rows without a key are one key."""
    best = df.groupBy(key.alias("__k")).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("__r"))
    return best.select(*[F.col(f"__r.`{c}`").alias(c) for c in df.columns])


def name_key(name: Column) -> Column:
    return strip(F.lower(name))


def grouped(df: DataFrame, identity: str, order: list[Column], protected: str, row_id: str, key: str, fields: list[str], notes: str | None = None, frozen: Column | None = None) -> DataFrame:
    """One row per group of two and more: what its survivor, fills and notes are made of, for `inherited`, `folded_notes` and `merge_report`.

    Rows with equal notes are combined first, so that a group brings each text
    of its notes once; the two aggregates are all the shuffles there are.
    """
    safe = F.coalesce(F.col(protected), F.lit(False))
    own = F.struct(F.col(row_id).alias("id"), safe.alias("p"), F.coalesce(F.lit(False) if frozen is None else frozen, F.lit(False)).alias("frozen"), (F.lit("") if notes is None else F.coalesce(notes, F.lit(""))).alias("notes"), *[usable(F.col(f)).alias("own_" + f) for f in fields])
    pick = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(row_id).alias("id"))
    donor = lambda f: F.min(F.when(usable(F.col(f)), F.struct(F.col(key).alias("k"), F.col(row_id).alias("id"), F.col(f).alias("v"))))
    rows = df.where(F.col(identity).isNotNull())
    if notes is None:
        groups = rows.groupBy(identity).agg(F.count("*").alias("n_group"), F.count_if(safe).alias("__p"), F.min_by(own, pick).alias("w"), *[donor(f).alias("d_" + f) for f in fields])
    else:
        text = F.nullif(F.coalesce(notes, F.lit("")), F.lit(""))
        parts = rows.groupBy(identity, text.alias("__t")).agg(F.count("*").alias("n"), F.count_if(safe).alias("p"), F.min(F.struct(pick.alias("pick"), own.alias("own"))).alias("w"), F.min(key).alias("k"), *[donor(f).alias("d_" + f) for f in fields])
        groups = parts.groupBy(identity).agg(
            F.sum("n").alias("n_group"), F.sum("p").alias("__p"), F.min_by("w.own", "w.pick").alias("w"), *[F.min("d_" + f).alias("d_" + f) for f in fields],
            F.array_sort(F.collect_list(F.when(F.col("__t").isNotNull(), F.struct("k", F.col("__t").alias("t"))))).alias("texts"),
        )
    return groups.where(F.col("n_group") > 1).withColumn("skipped", F.col("__p") > 1).drop("__p")


def _told(fields: list[str]) -> Column:
    told = [F.struct(F.lit(f).alias("field_name"), F.when(F.col("w").getField("own_" + f), F.col("w.id")).when(~F.col("w.p"), F.col("d_" + f).getField("id")).alias("donor")) for f in fields]
    return F.array(*told)


def inherited(groups: DataFrame, identity: str, fields: list[str]) -> DataFrame:
    """(identity, survivor, field_name, donor): where each field of each winner comes from; protected winners inherit nothing."""
    rows = groups.where(~F.col("skipped")).select(identity, F.col("w.id").alias("survivor"), F.explode(_told(fields)).alias("x"))
    return rows.select(identity, "survivor", "x.*").where(F.col("donor").isNotNull())


def folded() -> Column:
    """The winner's notes with each text of the others, in key order, unless already contained; and how many were added."""
    start = F.struct(F.col("w.notes").alias("t"), F.lit(0).cast("bigint").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        more = F.concat(acc["t"], F.when(acc["t"] == "", F.lit("")).otherwise(F.lit(" | ")), F.lit("[merged from "), x["k"], F.lit("]: "), x["t"])
        has = F.contains(acc["t"], x["t"])
        return F.struct(F.when(has, acc["t"]).otherwise(more).alias("t"), F.when(has, acc["n"]).otherwise(acc["n"] + 1).alias("n"))

    # the winner's own text is contained from the start, whoever else has it too
    return F.aggregate(F.when(~F.col("w.frozen"), F.col("texts")).otherwise(F.filter("texts", lambda x: F.lit(False))), start, step)


def folded_notes(groups: DataFrame, identity: str) -> DataFrame:
    """(identity, survivor, notes, n_merged): the winner's notes with each loser's, in key order, unless already contained."""
    rows = groups.where(~F.col("skipped")).select(identity, F.col("w.id").alias("survivor"), folded().alias("m"))
    return rows.select(identity, "survivor", F.col("m.t").alias("notes"), F.col("m.n").alias("n_merged"))


def merge_report(groups: DataFrame, fields: list[str]) -> DataFrame:
    """One row of counters: groups merged and skipped, rows dropped, notes merged, fields inherited; one pass over the groups."""
    live = ~F.col("skipped")
    rows = groups.select("skipped", "n_group", F.when(live, folded().getField("n")).alias("noted"), F.when(live, F.size(F.filter(_told(fields), lambda x: x["donor"].isNotNull() & (x["donor"] != F.col("w.id"))))).alias("filled"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return rows.agg(
        F.count_if(live).alias("groups_merged"), total(F.when(live, F.col("n_group") - 1)).alias("rows_dropped"), F.count_if("skipped").alias("groups_skipped"),
        total("noted").alias("notes_merged"), total("filled").alias("fields_inherited"),
    )


def merges(ranked_rows: DataFrame, identity: str, row_id: str) -> DataFrame:
    """(identity, winner, loser): what each merged group loses, one row per loser, from the output of `ranked`."""
    return ranked_rows.where(~F.col("skipped") & ~F.col("is_winner")).select(identity, F.col("winner"), F.col(row_id).alias("loser"))


def lookup(probes: DataFrame, probe_identity: str, table: DataFrame, identity: str, key: str, out: str) -> DataFrame:
    """Probes with the smallest key of their identity, NULL when nothing has it."""
    built = table.where(F.col(identity).isNotNull()).groupBy(F.col(identity).alias("__id")).agg(F.min(key).alias(out))
    return probes.join(built, known_key(F.col(probe_identity), *[c for c in probes.columns if c != probe_identity]) == F.concat(F.lit("="), F.col("__id")), "left").drop("__id")


def most_complete(df: DataFrame, key: str, fields: list[str], order: list[Column]) -> DataFrame:
    """Of rows with one key the one with most usable fields, the first in `order` among equals."""
    score = sum((usable(F.col(f)).cast("int") for f in fields), F.lit(0))
    return first_seen(df, F.col(key), [-score, *order])
