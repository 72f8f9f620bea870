"""Problem 8: budgets, caps, order of the draw, and weights."""

import math

from pyspark.sql import functions as F

from siftline.llm import mixing as X

ROWS = "row_id bigint, source string, n_tokens bigint, weight double"
TARGETS = "source string, target_share double, max_repeats int"


def run(spark, rows, targets, **more):
    chosen, report = X.mixed(spark.createDataFrame(rows, ROWS), spark.createDataFrame(targets, TARGETS), **more)
    return {r["row_id"]: r["n_repeats"] for r in chosen.collect()}, {r["source"]: r for r in report.collect()}


def test_shares_and_caps(spark):
    rows = [(i, "big", 10, 1.0) for i in range(800)] + [(1000 + i, "mid", 10, 0.5) for i in range(150)] + [(2000 + i, "tiny", 10, 1.0) for i in range(5)] + [(3000, None, 10, 1.0), (3001, "other", 10, 1.0), (3002, "big", 0, 1.0)]
    chosen, report = run(spark, rows, [("big", 0.5, 1), ("mid", 0.3, 3), ("tiny", 0.1, 2), ("none", 0.1, 4)])
    total = 9560
    assert report["big"]["reached_tokens"] == 4780 and report["mid"]["target_tokens"] == round(0.3 * total)
    assert abs(report["mid"]["reached_tokens"] - 0.3 * total) < 10 and report["tiny"]["reached_tokens"] == 100 and report["none"]["reached_tokens"] == 0
    # complete passes come first: every text of mid once before any twice
    assert {chosen[1000 + i] for i in range(150)} == {1, 2} and all(chosen[2000 + i] == 2 for i in range(5))
    assert not {3000, 3001, 3002} & set(chosen) and all(chosen.get(i, 0) <= 1 for i in range(800))
    assert abs(sum(r["reached_share"] for r in report.values()) - 1) < 1e-5


def test_draw_equals_brute_force_in_parts(spark, monkeypatch):
    monkeypatch.setattr(X, "PART_ROWS", 20)
    rows = [(i, "s", 1 + i % 7, 0.1 + (i % 10) / 10) for i in range(500)]
    df = spark.createDataFrame(rows, ROWS)
    key = {r["row_id"]: r["k"] for r in df.select("row_id", (-F.log(X.uniform(F.col("row_id"), 42)) / F.col("weight")).alias("k")).collect()}
    chosen, _ = run(spark, rows, [("s", 0.5, 1)])
    budget, expected = 0.5 * sum(r[2] for r in rows), set()
    left = rows
    for _ in range(X.FILLS):
        at, taken = 0, set()
        for r in sorted((r for r in left if r[2] <= budget), key=lambda r: (key[r[0]], r[0])):
            at += r[2]
            if at <= budget:
                taken.add(r[0])
        budget -= sum(r[2] for r in rows if r[0] in taken)
        left = [r for r in left if r[0] not in taken]
        expected |= taken
    assert set(chosen) == expected


def test_heavier_texts_are_drawn_more_often(spark):
    rows = [(i, "s", 1, 1.0 if i % 2 else 0.1) for i in range(2000)]
    chosen, _ = run(spark, rows, [("s", 0.3, 1)])
    heavy = sum(i % 2 for i in chosen)
    assert heavy > 0.75 * len(chosen)


def test_large_text_does_not_stop_the_draw(spark):
    rows = [(i, "s", 5000 if i == 3 else 10, 1.0) for i in range(200)]
    _, report = run(spark, rows, [("s", 0.2, 1)])
    assert 0.95 * 0.2 * 6990 <= report["s"]["reached_tokens"] <= 0.2 * 6990


def test_empty_and_null(spark):
    assert run(spark, [], [("s", 1.0, 1)])[0] == {}
    assert run(spark, [(1, "s", None, None)], [("s", 1.0, 1)])[0] == {}
    assert run(spark, [(1, "s", 5, None)], [("s", 0.4, 1)], total=100)[0] == {1: 1}
    assert run(spark, [(1, "s", 5, 1.0)], [])[0] == {}


def test_quality(spark):
    df = spark.createDataFrame([("plain words " * 40,), ("",), (None,), ("1234567890" * 40,), ("a" * 100_000,)], "t string").select(X.quality(F.coalesce("t", F.lit(""))).alias("q"))
    q = [r["q"] for r in df.collect()]
    assert q[0] == 1.0 and q[1] == q[2] == q[3] == 0.05 and q[4] == 1.0 and not any(math.isnan(v) for v in q)


def test_extra_columns_with_clashing_names(spark):
    rows = spark.createDataFrame([(1, "s", 5, 1.0, "a", "b", "c"), (2, "s", 5, 1.0, "a", "b", "c")], ROWS + ", key string, rest string, parts string")
    targets = spark.createDataFrame([("s", 1.0, 1, "x")], TARGETS + ", weight string")
    assert {r["row_id"] for r in X.mixed(rows, targets)[0].collect()} == {1, 2}
