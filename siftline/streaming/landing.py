"""A landing folder as a stream: each micro-batch is upserted into the versioned store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftline.sources.store import TableStore


def newest(batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key of a micro-batch, the last in `order`: an aggregate with map-side combination."""
    best = batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), F.struct(*order)).alias("__r"))
    return best.select(*[F.col(key) if c == key else F.col(f"__r.`{c}`").alias(c) for c in batch.columns])


def upsert_stream(spark: SparkSession, folder: str, schema: StructType, store: TableStore, key: str, protected: str, order: list[str], checkpoint: str, per_batch: int = 100):
    """Takes in all files landed so far and stops; a restart goes on after the last finished batch.

    A batch that is replayed after a failure upserts the same rows again, which
    changes nothing.
    """

    def take(batch: DataFrame, _: int) -> None:
        store.upsert(newest(batch, key, order), key, protected)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity_windows(events: DataFrame, at: str, key: str, value: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums per key and window of event time; rows later than the watermark are left out of closed windows."""
    return (
        events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")
    )
