"""Problem 2 against brute force, and currency reasoning."""

import random

from pyspark.sql import functions as F

from siftline.llm import survivors as V

SCHEMA = "g string, id bigint, slug string, at date, protected boolean, rank int, name string, city string, status string"


def run(spark, rows, inherited=("name", "city"), current=()):
    df = spark.createDataFrame(rows, SCHEMA.replace("at date", "at string")).withColumn("at", F.to_date("at"))
    return V.survivors(df, F.col("g"), "id", "slug", F.col("at"), F.col("protected"), [F.col("rank")], list(inherited), list(current))


def test_inheritance_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(f"g{i % 37 if i % 3 else 0}", i, f"s{rng.randrange(10**6):06d}", None, rng.random() < 0.01 or None, rng.randrange(3), rng.choice([None, " ", "n", "m"]), rng.choice([None, "", "c"]), None) for i in range(300)]
    got = {(r["survivor"], r["field_name"], r["donor"]) for r in run(spark, rows).collect()}
    expected = set()
    for g in {r[0] for r in rows}:
        group = [r for r in rows if r[0] == g]
        if len(group) < 2 or sum(r[4] is True for r in group) > 1:
            continue
        group.sort(key=lambda r: (r[4] is not True, r[5], r[2], r[1]))
        w, rest = group[0], sorted(group[1:], key=lambda r: (r[2], r[1]))
        for k, f in ((6, "name"), (7, "city")):
            ok = [r for r in [w, *([] if w[4] else rest)] if r[k] and r[k].strip()]
            if ok:
                expected.add((w[1], f, ok[0][1]))
    assert got == expected


def lessons(n=8):
    """Groups that show open -> sent -> expired by their dates."""
    return [(f"l{i}", 1000 + 10 * i + k, f"l{i}-{k}", f"2026-0{k + 1}-01", None, 0, "n", "c", s) for i in range(n) for k, s in enumerate(("open", "sent", "expired"))]


def status_of(spark, rows, g):
    got = run(spark, rows, ["name"], ["status"]).where((F.col("g") == g) & (F.col("field_name") == "status")).collect()
    return [(r["value"], r["donor"]) for r in got]


def test_learned_precedence_settles_missing_timestamps(spark):
    rows = [*lessons(), ("x", 1, "a", None, None, 0, "n", "c", "open"), ("x", 2, "b", None, None, 0, "n", "c", "expired"), ("x", 3, "c", None, None, 0, "n", "c", "sent")]
    assert status_of(spark, rows, "x") == [("expired", 2)]


def test_what_was_learned_is_closed(spark):
    # open -> sent and sent -> expired are each seen, open before expired never; sent is absent
    pairs = [(f"l{i}{k}", 1000 + 100 * i + 10 * k + j, f"l{i}{k}{j}", f"2026-0{j + 1}-01", None, 0, "n", "c", s) for i in range(8) for k, p in enumerate((("open", "sent"), ("sent", "expired"))) for j, s in enumerate(p)]
    assert status_of(spark, [*pairs, ("x", 1, "a", None, None, 0, "n", "c", "open"), ("x", 2, "b", None, None, 0, "n", "c", "expired")], "x") == [("expired", 2)]


def test_hidden_timestamps_are_told_by_what_other_groups_teach(spark):
    rng, states = random.Random(5), ["new", "open", "sent", "done"]
    rows, truth = [], {}
    for g in range(200):
        chain = sorted(rng.sample(range(4), 3))
        if rng.random() < 0.1:  # a tenth of the groups goes another way
            rng.shuffle(chain)
        hide = g % 2
        truth[f"g{g}"] = states[chain[-1]]
        rows += [(f"g{g}", 10 * g + k, f"s{rng.random()}", None if hide else f"2026-0{k + 1}-01", None, 0, "n", "c", states[x]) for k, x in enumerate(chain)]
    got = {r["g"]: r["value"] for r in run(spark, rows, ["name"], ["status"]).where("field_name = 'status'").collect()}
    assert all(got[g] == v for g, v in truth.items() if int(g[1:]) % 2 == 0)
    assert sum(got[g] == v for g, v in truth.items() if int(g[1:]) % 2) >= 85


def test_a_group_of_very_many_values_teaches_in_one_pass(spark):
    rows = [("big", i, f"s{i}", f"20{i % 50 + 10}-0{i % 9 + 1}-0{i % 8 + 1}", None, 0, "n", "c", f"v{i}") for i in range(20_000)]
    assert len(status_of(spark, rows, "big")) == 1


def test_timestamps_come_first(spark):
    rows = [*lessons(), ("x", 1, "a", "2026-05-01", None, 0, "n", "c", "open"), ("x", 2, "b", "2026-04-01", None, 0, "n", "c", "expired")]
    assert status_of(spark, rows, "x") == [("open", 1)]
    rows = [*lessons(), ("x", 1, "a", "2026-05-01", None, 0, "n", "c", "open"), ("x", 2, "b", None, None, 0, "n", "c", "sent")]
    assert status_of(spark, rows, "x") == [("sent", 2)]


def test_without_lessons_the_last_timed_value_then_the_survivor(spark):
    rows = [("x", 1, "b", None, None, 0, "n", "c", "p"), ("x", 2, "a", None, None, 0, "n", "c", "q"), ("y", 3, "a", "2026-01-01", None, 1, "n", "c", "p"), ("y", 4, "b", None, None, 0, "n", "c", "q"), ("z", 5, "a", None, None, 0, "n", "c", None), ("z", 6, "b", None, None, 0, "n", "c", " ")]
    assert status_of(spark, rows, "x") == [("q", 2)] and status_of(spark, rows, "y") == [("p", 3)] and status_of(spark, rows, "z") == []


def test_circles_and_empty_tables(spark):
    rows = [(f"c{i}{d}", 100 * i + 10 * d + k, f"c{i}{d}{k}", f"2026-01-0{k + 1}", None, 0, "n", "c", s) for i in range(8) for d, pair in enumerate((("a", "b"), ("b", "c"), ("c", "a"))) for k, s in enumerate(pair)]
    rows += [("x", 1, "a", None, None, 0, "n", "c", "a"), ("x", 2, "b", None, None, 0, "n", "c", "b"), ("x", 3, "c", None, None, 0, "n", "c", "c")]
    assert status_of(spark, rows, "x") == [("a", 1)]
    assert run(spark, [], current=["status"]).count() == 0


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(None, 1, "a", None, None, 0, "n", "c", "s"), ("g", 2, None, None, None, None, None, None, None), ("g", 2, None, None, None, None, None, None, None), ("g", 3, "k", "2026-01-01", None, None, "x" * 200_000, None, "s")]
    got = run(spark, rows, current=["status"]).collect()
    assert {(r["field_name"], r["donor"]) for r in got} == {("name", 3), ("status", 3)}
    df = spark.createDataFrame([("g", 1, "a", "n1", "w"), ("g", 2, "b", "n2", "w")], "id string, pick bigint, key string, value string, donor string")
    got = V.survivors(df, F.col("id"), "pick", "key", F.lit(None).cast("date"), F.lit(False), [], ["value", "donor"], []).collect()
    assert {(r["field_name"], r["donor"]) for r in got} == {("value", 1), ("donor", 1)}
