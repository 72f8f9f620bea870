"""Problem 2: one surviving record per group of duplicates, with the origin of each field.

Two kinds of field:

* *inherited* fields (name, city, conf_date here): the survivor's own value when
  usable, else the first usable one in key order; protected survivors inherit
  nothing.  The survivor is the first row in the declared precedence.
* *current* fields (status, source, ...): currency reasoning.  Timestamped rows
  of all groups teach which value follows which; a value seen right before
  another in clearly more groups than after it precedes it, and all that comes
  after that one.  In each group
  timestamps order the timed rows and learned precedence relates the untimed
  ones to them; a value that some value of its group follows is out, and of the
  topologically latest ones the last timed one is taken, then the survivor's.

Rows meet in aggregates with map-side combination only, so a group of any size,
even a third of all rows, never meets in one task; what does meet, one row per
distinct value of a group, is put in order for its lessons.

Defined results: rows without a group key are in no group; a group of one row,
and one with several protected rows, gives no record; null or blank values are
no values; ties end with the smallest key, then the smallest id; timestamps that
are no ISO dates count as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions.columns import iso_date, source_matches, source_rank, url_identity, usable
from siftline.operators.skew import checkpointed
from siftline.sources.tables import read

#: A precedence is learned from at least this many groups, of which this share must agree.
LEAST_GROUPS, AGREEMENT = 5, 0.75
#: Config tables are small by nature; a larger one is refused, not cut.
MAX_SOURCES = 1_000


def precedence(values: DataFrame) -> DataFrame:
    """(field, earlier, later) learned from (g, field, value, first_at, last_at): which value comes after which.

    `values` has one row per group, field and value.  Each value teaches only
    the next one in its group, so that the lessons are as many as the values,
    not as their pairs; what follows from lesson to lesson is closed under
    transitivity, so that a value two steps behind another is known to be
    behind it where the one between is absent.
    """
    timed = values.where(F.col("first_at").isNotNull())
    after = lambda c: F.lead(c).over(Window.partitionBy("g", "field").orderBy("first_at", "last_at", "value"))
    steps = timed.withColumns({"y": after("value"), "y_at": after("first_at")}).where(F.col("last_at") < F.col("y_at"))
    seen = steps.groupBy("field", F.col("value").alias("x"), "y").agg(F.count("*").alias("n"))
    back = seen.select("field", F.col("x").alias("y"), F.col("y").alias("x"), F.col("n").alias("m"))
    both = seen.join(back, ["field", "x", "y"], "left").withColumn("m", F.coalesce("m", F.lit(0)))
    learned = checkpointed(both.where((F.col("n") + F.col("m") >= LEAST_GROUPS) & (F.col("n") >= AGREEMENT * (F.col("n") + F.col("m")))).select("field", "x", "y"))
    known = learned.count()
    while True:  # each round doubles the steps between
        longer = learned.join(learned.select("field", F.col("x").alias("y"), F.col("y").alias("z")), ["field", "y"]).where(F.col("x") != F.col("z")).select("field", "x", F.col("z").alias("y"))
        learned = checkpointed(learned.union(longer).distinct())
        if (now := learned.count()) == known:
            return learned.select("field", F.col("x").alias("earlier"), F.col("y").alias("later"))
        known = now


def current_values(rows: DataFrame, fields: list[str], learned: list[str]) -> DataFrame:
    """(g, field_name, value, donor): the topologically latest value of each field in each group.

    `rows` has (g, id, at, pick) and the fields; `pick` orders rows where
    nothing else does.  The precedence of values is learned for the `learned`
    fields: those of few values, such as states; of a field whose values never
    come again, such as dates, there is nothing to learn.
    """
    long = rows.select("g", "id", "at", "pick", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x"))
    long = long.select("g", "id", "at", "pick", "x.*").where(usable(F.col("value")))
    values = long.groupBy("g", "field", "value").agg(
        F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count_if(F.col("at").isNull()).alias("untimed"),
        F.min(F.struct("pick", "id")).alias("best"), F.max_by("id", F.struct("at", F.negative("id"))).alias("latest"),
    )
    values = checkpointed(values)
    order = precedence(values.where(F.col("field").isin(learned)))
    top = values.groupBy("g", "field").agg(F.max("last_at").alias("top"))
    # still in the running: the value last timed, and every value of an untimed row
    live = values.join(top, ["g", "field"]).where((F.col("untimed") > 0) | F.col("last_at").eqNullSafe(F.col("top")))
    followed = live.alias("v").join(order.alias("o"), (F.col("v.field") == F.col("o.field")) & (F.col("v.value") == F.col("o.earlier")))
    followed = followed.join(live.select("g", "field", F.col("value").alias("later_value")).alias("w"), (F.col("v.g") == F.col("w.g")) & (F.col("v.field") == F.col("w.field")) & (F.col("o.later") == F.col("w.later_value")))
    beaten = followed.select("v.g", "v.field", "v.value").distinct()
    kept = live.join(beaten, ["g", "field", "value"], "left_anti").unionByName(
        # should learned precedence go round in a circle, timestamps alone decide
        live.join(live.join(beaten, ["g", "field", "value"], "left_anti").select("g", "field").distinct(), ["g", "field"], "left_anti")
    )
    first = F.struct(F.col("last_at").isNull().alias("a"), (-F.unix_date("last_at")).alias("b"), "best", "value")
    won = kept.groupBy("g", "field").agg(F.min_by(F.struct("value", F.when(F.col("last_at").isNotNull(), F.col("latest")).otherwise(F.col("best.id")).alias("donor")), first).alias("w"))
    return won.select("g", F.col("field").alias("field_name"), F.col("w.value").alias("value"), F.col("w.donor").alias("donor"))


def survivors(df: DataFrame, group: Column, row_id: str, key: str, at: Column, protected: Column, order: list[Column], inherited: list[str], current: list[str], learned: list[str] | None = None) -> DataFrame:
    """(g, survivor, field_name, value, donor, origin): the surviving record of each group, one row per field it has.

    `protected` rows come before the `order` and inherit nothing.  `origin` is
    ``own``, ``inherited`` or ``current``.  Of the `current` fields those in
    `learned`, by default all, teach which of their values follows which.
    """
    protected = F.coalesce(protected, F.lit(False))
    id_, text = F.col(f"`{row_id}`"), F.coalesce(F.col(f"`{key}`"), F.lit(""))
    pick = F.struct((~protected).alias("p0"), *[c.alias(f"p{i + 1}") for i, c in enumerate(order)], text.alias("key"), id_.alias("id"))
    rows = df.select(group.alias("g"), id_.alias("id"), at.alias("at"), pick.alias("pick"), protected.alias("protected"), text.alias("key"), *[F.col(f"`{f}`").alias(f"f_{f}") for f in dict.fromkeys([*inherited, *current])])
    rows = rows.where(F.col("g").isNotNull())
    own = F.struct("id", "protected", *[F.when(usable(F.col(f"f_{f}")), F.col(f"f_{f}")).alias(f) for f in inherited])
    firsts = [F.min(F.when(usable(F.col(f"f_{f}")), F.struct("key", "id", F.col(f"f_{f}").alias("value")))).alias("i_" + f) for f in inherited]
    groups = rows.groupBy("g").agg(F.count("*").alias("n"), F.count_if("protected").alias("n_protected"), F.min_by(own, "pick").alias("w"), *firsts)
    groups = checkpointed(groups.where((F.col("n") > 1) & (F.col("n_protected") <= 1)))
    told = []
    for f in inherited:
        mine, other = F.col("w").getField(f), F.when(~F.col("w.protected"), F.col("i_" + f))
        told.append(F.struct(F.lit(f).alias("field_name"), F.coalesce(mine, other["value"]).alias("value"), F.when(mine.isNotNull(), F.col("w.id")).otherwise(other["id"]).alias("donor"), F.when(mine.isNotNull(), "own").otherwise("inherited").alias("origin")))
    kept = groups.select("g", F.col("w.id").alias("survivor"), F.explode(F.array(*told)).alias("x")).select("g", "survivor", "x.*").where(F.col("donor").isNotNull())
    if not current:
        return kept
    inside = rows.join(groups.select("g"), "g", "left_semi").select("g", "id", "at", "pick", *[F.col(f"f_{f}").alias(f) for f in current])
    latest = current_values(inside, current, current if learned is None else learned).join(groups.select("g", F.col("w.id").alias("survivor")), "g")
    return kept.unionByName(latest.select("g", "survivor", "field_name", "value", "donor", F.when(F.col("donor") == F.col("survivor"), "own").otherwise("current").alias("origin")))


def _state_survivors(spark: SparkSession, d: str, current: list[str], learned: list[str] | None = None) -> DataFrame:
    config = read(spark, d, "feed_sources").orderBy("prio").limit(MAX_SOURCES + 1).collect()  # a config table
    if len(config) > MAX_SOURCES:
        raise ValueError("feed_sources is larger than a config table may be")
    table = [(r["host_suffix"], r["source"]) for r in config]
    state = read(spark, d, "cfp_state")
    true = lambda n: F.coalesce(F.col(n), F.lit(False))
    order = [~true("shown_in_brief"), ~source_matches(F.col("source"), F.col("cfp_url"), table), source_rank(F.col("source"), [t for _, t in table])]
    return survivors(state, url_identity(F.col("cfp_url")), "ord", "slug", iso_date(F.col("updated")), true("user_actioned"), order, ["name", "city", "conf_date"], current, learned)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Which row each inherited field of each survivor comes from."""
    found = _state_survivors(spark, d, [])
    return found.select(F.col("survivor").alias("survivor_ord"), "field_name", F.col("donor").alias("donor_ord"))


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    """The surviving records in full: inherited fields and those chosen by currency."""
    found = _state_survivors(spark, d, ["status", "source", "deadline", "user_actioned", "shown_in_brief"], ["status", "source", "user_actioned", "shown_in_brief"])
    return found.select(F.col("g").alias("identity"), F.col("survivor").alias("survivor_ord"), "field_name", "value", F.col("donor").alias("donor_ord"), "origin")


QUERIES = {"p2_found": p2_found, "p2_records": p2_records}
