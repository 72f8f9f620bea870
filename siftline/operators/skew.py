"""Helpers that keep a hot key from landing in one task, and that cut lineage safely."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key that a single task takes; a larger key is split into this many rows a part.
PART_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, the session's spark.checkpoint.dir; only a local session without it, as in tests, gets one of its own."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local"):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    return folder or _own_folder()


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="siftline-")


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` as a compressed table in the shared folder, so that a lost executor costs no recomputation and its size is known to the planner."""
    place = f"{shared_folder(df.sparkSession)}/siftline-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def removed(spark: SparkSession, place: str) -> None:
    """Deletes a folder of intermediate data, on whatever file system it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def salted_join(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, how: str = "inner", part: int = PART_ROWS, spread: Column | None = None) -> DataFrame:
    """Joins many `rows` to one row per key of `groups`; keys of more than `part` rows are spread over several tasks.

    `count` names the column of `groups` with the key's number of rows.  Only
    the keys beyond `part` are broadcast: at most (rows / part) of them.
    `spread` gives the part of a row; by default a hash of all its columns.
    """
    hot = groups.where(F.col(count) > part).select(*keys, F.ceil(F.col(count) / part).cast("int").alias("__parts"))
    spread = F.xxhash64(*rows.columns) if spread is None else spread
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(spread, F.col("__parts"))).cast("int")).drop("__parts")
    last = F.greatest(F.ceil(F.col(count) / part).cast("int"), F.lit(1)) - 1
    right = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), last)))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def known_key(key: Column, *spread: str) -> Column:
    """A text key for the left side of a left join: rows without one, which match nothing, get made-up keys instead of all meeting in one task."""
    return F.coalesce(F.concat(F.lit("="), key), F.concat(F.lit("?"), F.pmod(F.xxhash64(*spread), F.lit(1 << 20)).cast("string")))


def salted_pairs(left: DataFrame, right: DataFrame, key: str, part: int = 2_000) -> DataFrame:
    """Joins two sides on `key`; the left rows of a key beyond `part` rows are split over several tasks, each with all right rows of it.

    The table of such keys has at most (left rows / part) rows; it is written
    first, so that the planner broadcasts it only when its size allows.
    """
    hot = left.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > part).select(key, F.ceil(F.col("__n") / part).cast("int").alias("__parts"))
    hot = checkpointed(hot)
    salt = F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*left.columns), F.col("__parts"))).cast("int")
    left = left.join(hot, key, "left").withColumn("__salt", salt).drop("__parts")
    right = right.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return left.join(right, [key, "__salt"]).drop("__salt")


def running_sum(df: DataFrame, group: list[str], order: list[Column], value: Column, out: str, bucket: Column) -> DataFrame:
    """Column `out`: the sum of `value` over the rows before and up to this one in `group`, without a window over a whole group.

    `bucket` splits each group into ordered ranges (a smaller bucket's rows all
    come first); a window runs inside a bucket only, and bucket totals, which
    are few, give the offsets.
    """
    from pyspark.sql import Window

    df = df.withColumn("__b", bucket)
    totals = df.groupBy(*group, "__b").agg(F.sum(value).alias("__t"))
    before = totals.withColumn("__o", F.coalesce(F.sum("__t").over(Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__t")
    inner = F.sum(value).over(Window.partitionBy(*group, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("__i", inner).join(before, [*group, "__b"])
    return df.withColumn(out, F.col("__i") + F.col("__o")).drop("__b", "__i", "__o")
