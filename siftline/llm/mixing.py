"""Problem 8: records of several sources combined so that each gives a target share of the total size.

Per source: the budget is its share of the total, whole passes over the source
come first, at most `max_repeats` of them, and the rest is drawn by
Efraimidis-Spirakis sampling: each text gets an exponential key scaled by its
quality weight, texts are ordered by key within their source, and a running sum
of their sizes is cut at the budget.  Where a large text crosses it, the texts
after it in key order that still fit fill the rest, again and again until none fits.

The running sum works in ranges of keys, so a source with a third of all rows is
summed by many tasks.

Defined results: texts of no target source, and null sources, are not chosen;
texts without tokens are never chosen; a missing weight is 1; a source that cannot reach its share
gives all it has `max_repeats` times and the report shows what it reached; no
budget is exceeded; ties of keys go to the smaller id; ids are unique; the draw depends on `seed` and id only.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.sizes import with_sizes
from siftline.operators.skew import PART_ROWS, checkpointed, running_sum
from siftline.sources.tables import read

#: Target sources come from a config table; a larger one is refused, not cut.
MAX_TARGETS = 10_000
#: Rounds of filling that are drawn without asking whether the last one took anything.
FILLS = 3


def quality(text: Column) -> Column:
    """A plain quality weight from 0.05 to 1: the share of letters and blanks, lowered for very short texts."""
    n = F.length(text)
    clean = F.length(F.regexp_replace(text, r"[^\p{L}\s]", "")) / F.greatest(n, F.lit(1))
    return F.greatest(F.lit(0.05), clean * F.least(F.lit(1.0), n / 200))


def uniform(row_id: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 from an id."""
    return (F.pmod(F.xxhash64(F.lit(seed), row_id), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def mixed(rows: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(chosen, report): `rows` has (row_id, source, n_tokens, weight), `targets` (source, target_share, max_repeats).

    chosen: (row_id, source, n_tokens, n_repeats); report: one row per target
    source.  `total` is the size aimed at, by default that of all rows.
    """
    config = targets.limit(MAX_TARGETS + 1).collect()
    if len(config) > MAX_TARGETS:
        raise ValueError("more target sources than a config table may hold")
    rows = rows.select("row_id", "source", "n_tokens", "weight")
    targets = targets.select("source", "target_share", "max_repeats")
    known = rows.where((F.col("n_tokens") > 0) & F.col("source").isNotNull()).withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    stats = {r["source"]: r for r in known.join(F.broadcast(targets.select("source").distinct()), "source").groupBy("source").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("n"), F.avg("weight").alias("w")).collect()}
    total = total if total is not None else (known.agg(F.sum("n_tokens")).first()[0] or 0)
    budgets = []
    for t in config:
        s = stats.get(t["source"])
        size, n = (s["size"], s["n"]) if s else (0, 0)
        aim = t["target_share"] * total
        passes = min(t["max_repeats"], int(aim // size)) if size else 0
        rest = aim - passes * size if size and passes < t["max_repeats"] else 0.0
        budgets.append((t["source"], float(t["target_share"]), t["max_repeats"], size, float(aim), passes, float(rest), max(1, -(-n // PART_ROWS)), float(s["w"]) if s else 1.0))
    table = rows.sparkSession.createDataFrame(budgets, "source string, target_share double, max_repeats int, available_tokens bigint, target_tokens double, passes int, rest double, parts int, mean_weight double")
    rows = known.join(F.broadcast(table.select("source", "passes", "rest", "parts", "mean_weight")), "source")
    rows = rows.withColumn("key", -F.log(uniform(F.col("row_id"), seed)) / F.greatest("weight", F.lit(1e-9)))
    # a rising function of the key cuts each source into ranges of about equal size
    bucket = F.least(F.floor((1 - F.exp(-F.col("key") * F.col("mean_weight"))) * F.col("parts")), F.col("parts") - 1)
    rows = checkpointed(rows.withColumn("__range", bucket))
    drawn = rows.where(F.col("rest") > 0).select("row_id", "source", "n_tokens", "key", "rest", "__range")
    takes = []
    for k in count(1):
        summed = running_sum(drawn.where(F.col("n_tokens") <= F.col("rest")), ["source"], [F.col("key"), F.col("row_id")], F.col("n_tokens"), "__sum", F.col("__range"))
        take = checkpointed(summed.where(F.col("__sum") <= F.col("rest")).select("row_id", "source", "n_tokens"))
        takes.append(take)
        if k >= FILLS and take.isEmpty():  # no text is left that fits
            break
        # where a large text crossed the budget, those after it in key order fill what is left
        spent = take.groupBy("source").agg(F.sum("n_tokens").alias("__spent"))
        drawn = drawn.join(take.select("row_id"), "row_id", "left_anti").join(F.broadcast(spent), "source").withColumn("rest", F.col("rest") - F.col("__spent")).drop("__spent")
    extra = reduce(DataFrame.unionByName, takes).select("row_id", F.lit(1).alias("__one"))
    chosen = rows.join(extra, "row_id", "left").select("row_id", "source", "n_tokens", (F.col("passes") + F.coalesce("__one", F.lit(0))).alias("n_repeats")).where(F.col("n_repeats") > 0)
    chosen = checkpointed(chosen)
    reached = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_repeats")).alias("reached_tokens"), F.count("*").alias("n_texts"), F.max("n_repeats").alias("most_repeats"))
    whole = F.lit(chosen.agg(F.sum(F.col("n_tokens") * F.col("n_repeats"))).first()[0] or 1)
    report = table.select("source", "target_share", "max_repeats", "available_tokens", F.round("target_tokens").cast("bigint").alias("target_tokens")).join(reached, "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    report = report.select("source", "target_share", "max_repeats", "available_tokens", "target_tokens", zero("reached_tokens").alias("reached_tokens"), zero("n_texts").alias("n_texts"), zero("most_repeats").alias("most_repeats"), F.round(zero("reached_tokens") / whole, 6).alias("reached_share"))
    return chosen, report


def _rows(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "source", "text")
    return checkpointed(with_sizes(docs, "text").select("row_id", "source", "n_tokens", quality(F.coalesce("text", F.lit(""))).alias("weight")))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The chosen texts and how often each is used."""
    chosen, _ = mixed(_rows(spark, d), read(spark, d, "mix_targets"))
    return chosen.withColumnRenamed("row_id", "doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source."""
    return mixed(_rows(spark, d), read(spark, d, "mix_targets"))[1]


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares}
