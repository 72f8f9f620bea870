"""Problem 7 against a brute-force packer."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.llm import packing as P
from siftline.llm.sizes import with_sizes


def brute(lengths, capacity):
    """One text at a time, longest first, into the pack with the most room, else a new one."""
    packs = []
    for n in sorted(lengths, reverse=True):
        best = max((p for p in packs if capacity - sum(p) >= n), key=lambda p: capacity - sum(p), default=None)
        if best is None:
            packs.append([n])
        else:
            best.append(n)
    return len(packs)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.sampled_from([40, 64]))
def test_plan_places_all_and_matches_brute_force(lengths, capacity):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    entries, packs = P.plan(histogram, capacity)
    filled, seats = {}, set()
    for n, mine in entries.items():
        starts = [m[0] for m in mine] + [histogram[n]]
        for (first, pack, position, offset), end in zip(mine, starts[1:], strict=True):
            for r in range(first, end):
                no = pack + r - first
                filled.setdefault(no, []).append((position, offset, n))
                assert (no, position) not in seats
                seats.add((no, position))
    assert len(seats) == len(lengths) and set(filled) == set(range(packs))
    for contents in filled.values():
        at = 0
        for position, offset, n in sorted(contents):
            assert offset == at
            at += n
        assert at <= capacity
    assert packs == brute(lengths, capacity)


def packed(spark, sizes, capacity):
    df = spark.createDataFrame(list(enumerate(sizes)), "row_id bigint, n_tokens bigint")
    return [r.asDict() for r in P.packed(df, capacity, 16 * capacity)[capacity].collect()]


def test_every_text_once_and_only_large_ones_split(spark, monkeypatch):
    monkeypatch.setattr(P, "PART_ROWS", 7)  # ranks in several parts
    rng = random.Random(2)
    sizes = [rng.choice([0, 3, 3, 3, 9, 31, 64, 65, 200]) for _ in range(300)]
    rows = packed(spark, sizes, 64)
    assert len({(r["row_id"], r["part"]) for r in rows}) == len(rows) and {r["row_id"] for r in rows} == set(range(300))
    assert len({(r["pack_no"], r["position"]) for r in rows}) == len(rows)
    for i, n in enumerate(sizes):
        mine = sorted((r["token_from"], r["n_tokens"]) for r in rows if r["row_id"] == i)
        assert sum(x for _, x in mine) == n and len(mine) == max(1, -(-n // 64)) and all(a == 64 * k for k, (a, _) in enumerate(mine))
    room = {}
    for r in rows:
        room[r["pack_no"]] = room.get(r["pack_no"], 0) + r["n_tokens"]
    assert max(room.values()) <= 64 and sum(sizes) / (64 * len(room)) > 0.95


@pytest.mark.parametrize("sizes", [[], [0, 0, 0], [5]])
def test_small_tables(spark, sizes):
    assert len(packed(spark, sizes, 8)) == len(sizes)


def test_sizes_of_texts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "a" * 20_000 + " b")], "i int, text string")
    got = {r["i"]: r["n_tokens"] for r in with_sizes(df, "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] > 100
