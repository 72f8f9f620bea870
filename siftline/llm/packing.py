"""Problem 7: texts combined into packs of fixed capacity with little unused space.

Shortest-pack-first over the length histogram: lengths are placed longest first,
each into the packs with the most room left, and only counts of packing patterns
are updated, so the plan costs the same for a thousand texts and a billion.  A
plan entry covers an interval of ranks of one length and an interval of pack
numbers; texts find theirs by their rank among the texts of their length.

The histogram has at most `capacity` rows.  Ranks are counted in parts of a
length, so a length that a third of all texts share is ranked by many tasks.

Defined results: a text longer than a pack is cut into full packs and one rest,
every other text stays whole; texts without tokens (null, empty) take no room
and are dealt out evenly to the packs; equal texts are packed one by one; an
empty table gives no packs; without any token there is one pack.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm.sizes import with_sizes
from siftline.operators.skew import PART_ROWS, checkpointed
from siftline.sources.tables import read


def plan(histogram: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """({length: [(first rank, first pack, position, token offset)]}, packs): where the texts of each length go.

    Intervals of packs with equal contents stay together; the packs with the most
    room come first, the lowest numbers among equals.
    """
    room: list[tuple[int, int, int, int]] = []  # (-room left, first pack, packs, texts in each)
    packs, entries = 0, {}
    for length in sorted((x for x in histogram if x > 0), reverse=True):
        left, rank, mine = histogram[length], 0, []
        while left and room and -room[0][0] >= length:
            free, first, count, depth = heapq.heappop(room)
            free, used = -free, min(left, count)
            mine.append((rank, first, depth, capacity - free))
            if free > length:
                heapq.heappush(room, (length - free, first, used, depth + 1))
            if used < count:
                heapq.heappush(room, (-free, first + used, count - used, depth))
            rank, left = rank + used, left - used
        # no room anywhere: as many of this length as a new pack holds, in full packs and one rest
        most = capacity // length
        for each, count in ((most, left // most), (left % most, 1)):
            if each and count:
                mine += [(rank + j * count, packs, j, j * length) for j in range(each)]
                if capacity > each * length:
                    heapq.heappush(room, (each * length - capacity, packs, count, each))
                rank, packs = rank + each * count, packs + count
        entries[length] = mine
    return entries, packs


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """(row_id, part, token_from, n_tokens): one row per text, more for texts longer than a pack."""
    n = F.col("n_tokens")
    parts = F.greatest(F.ceil(n / capacity), F.lit(1)).cast("int")
    cut = sizes.select("row_id", n.alias("n"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    start = (F.col("part") * F.lit(capacity)).cast("bigint")
    return cut.select("row_id", "part", start.alias("token_from"), F.least(F.lit(capacity), F.col("n") - start).cast("int").alias("n_tokens"))


def ranked(items: DataFrame, order: list[str], first: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """(items with `rank`, their histogram): numbers among items of one `n_tokens` from `first` on, in parts so that no length is sorted by one task."""
    counts = {r[0]: r[1] for r in items.groupBy("n_tokens").count().collect()}  # lengths of packed pieces: at most capacity + 1 rows
    split = items.sparkSession.createDataFrame([(n, -(-c // PART_ROWS), first.get(n, 0)) for n, c in counts.items()], "n_tokens int, __parts int, __first bigint")
    items = items.join(F.broadcast(split), "n_tokens").withColumn("__p", F.pmod(F.xxhash64(*order), F.col("__parts")))
    totals = items.groupBy("n_tokens", "__p").agg(F.count("*").alias("__n"))
    before = totals.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy("n_tokens").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    items = items.withColumn("__r", F.row_number().over(Window.partitionBy("n_tokens", "__p").orderBy(*order)) - 1)
    items = items.join(before, ["n_tokens", "__p"]).withColumn("rank", F.col("__r") + F.col("__before") + F.col("__first"))
    return items.drop("__parts", "__first", "__p", "__r", "__before"), counts


def packed(sizes: DataFrame, *capacities: int) -> dict[int, DataFrame]:
    """Per capacity (pack_no, position, token_offset, row_id, part, token_from, n_tokens) of every text; `sizes` has (row_id, n_tokens).

    Texts are ranked among equal lengths once, for all capacities; only what a
    capacity splits gets further ranks behind those.
    """
    most = max(capacities)
    whole, counts = ranked(sizes.where(F.col("n_tokens") <= most).select("row_id", F.col("n_tokens").cast("int").alias("n_tokens")), ["row_id"], {})
    whole = checkpointed(whole)
    out = {}
    for capacity in dict.fromkeys(capacities):
        mine = {n: c for n, c in counts.items() if n <= capacity}
        cut, more = ranked(pieces(sizes.where(F.col("n_tokens") > capacity), capacity), ["row_id", "part"], mine)
        kept = whole.where(F.col("n_tokens") <= capacity).select("row_id", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("token_from"), "n_tokens", "rank")
        items = kept.unionByName(cut.select(kept.columns)) if more else kept
        out[capacity] = _placed(items, {n: mine.get(n, 0) + more.get(n, 0) for n in {*mine, *more}}, capacity)
    return out


def _placed(items: DataFrame, counts: dict[int, int], capacity: int) -> DataFrame:
    """Each piece at the place that the plan of the histogram has for its length and rank."""
    entries, packs = plan(counts, capacity)
    packs = max(packs, 1)
    spark = items.sparkSession
    depth = {}
    for n in entries:
        for _, _, position, _ in entries[n]:
            depth[position] = True
    deepest = max(depth, default=-1) + 1
    shared = spark.sparkContext.broadcast({n: np.array(e, dtype=np.int64) for n, e in entries.items()})  # bounded by the capacity

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for b in batches:
            pack, pos, off = (np.zeros(len(b), dtype=np.int64) for _ in range(3))
            length, rank = b["n_tokens"].to_numpy(), b["rank"].to_numpy()
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                if n == 0:
                    pack[at], pos[at] = rank[at] % packs, deepest + rank[at] // packs
                    continue
                e = table[int(n)]
                k = np.searchsorted(e[:, 0], rank[at], side="right") - 1
                pack[at], pos[at], off[at] = e[k, 1] + rank[at] - e[k, 0], e[k, 2], e[k, 3]
            yield pd.DataFrame({"pack_no": pack, "position": pos, "token_offset": off, "row_id": b["row_id"], "part": b["part"], "token_from": b["token_from"], "n_tokens": b["n_tokens"]})

    return items.select("row_id", "part", "token_from", "n_tokens", "rank").mapInPandas(place, "pack_no bigint, position bigint, token_offset bigint, row_id bigint, part int, token_from bigint, n_tokens int")


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "text")
    return checkpointed(with_sizes(docs, "text").select("row_id", "n_tokens"))


def p7_packs(spark: SparkSession, d: str) -> DataFrame:
    """Pack and position of every text, for each capacity of pack_sizes."""
    out = None
    wanted = read(spark, d, "pack_sizes").orderBy("pack_id").collect()  # a fixed, tiny table
    packs = packed(_sizes(spark, d), *[r["capacity_tokens"] for r in wanted])
    for row in wanted:
        one = packs[row["capacity_tokens"]].withColumn("pack_id", F.lit(row["pack_id"]))
        out = one if out is None else out.unionByName(one)
    return out.select("pack_id", "pack_no", "position", "token_offset", F.col("row_id").alias("doc_id"), "part", "token_from", "n_tokens")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity: packs, tokens, the share of room used, and texts split."""
    rows = p7_packs(spark, d).join(F.broadcast(read(spark, d, "pack_sizes")), "pack_id")
    rows = rows.groupBy("pack_id", "capacity_tokens").agg(
        (F.max("pack_no") + 1).alias("n_packs"), F.sum("n_tokens").alias("n_tokens"), F.count_if((F.col("part") == 1)).alias("n_split")
    )
    return rows.withColumn("fill", F.round(F.col("n_tokens") / (F.col("n_packs") * F.col("capacity_tokens")), 6))


QUERIES = {"p7_packs": p7_packs, "p7_fill": p7_fill}
