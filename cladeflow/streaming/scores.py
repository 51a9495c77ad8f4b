"""Streaming forms of best-score reduction and of running clade counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def best_so_far(scores: DataFrame, sample: str, ident: str, value: str, order: str) -> DataFrame:
    """The best id of each sample as scores arrive; a later score wins only if it is higher. The same
    for a stream and a table."""
    return scores.groupBy(sample).agg(F.max_by(ident, F.struct(value, -F.col(order))).alias("best"), F.max(value).alias("score"))


def running_counts(scores: DataFrame, clade: str, weight: str) -> DataFrame:
    """Count, weight and mean by clade as records arrive."""
    w = F.col(weight).cast("decimal(18,2)")
    return scores.groupBy(clade).agg(F.count("*").alias("n"), F.sum(w).cast("double").alias("weight"), (F.sum(w).cast("double") / F.count("*")).alias("mean"))


def drained(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Run a complete-mode stream until its input is read, and return its last result from ``out``."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def upserted(stream: DataFrame, out: str, checkpoint: str) -> int:
    """Run an update-mode stream until its input is read: each batch writes only the keys that it changed, into a folder of
    its own, which a repeated batch writes again. Returns how many batches ran; see latest()."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    q = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return len(q.recentProgress)


def latest(spark: SparkSession, out: str, keys: list[str], schema: StructType) -> DataFrame:
    """The last row of each key in ``out``."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("epoch", LongType())])).parquet(out)
    others = F.struct(*[c for c in schema.names if c not in keys])
    last = rows.groupBy(*keys).agg(F.max_by(others, "epoch").alias("_r"))
    return last.select(*[c if c in keys else F.col(f"_r.{c}").alias(c) for c in schema.names])


def compacted(spark: SparkSession, out: str, to: str, keys: list[str], schema: StructType) -> None:
    """The same table with one row for each key, as the first batch of a new folder; for when no stream writes."""
    latest(spark, out, keys, schema).write.mode("overwrite").parquet(f"{to}/epoch=-1")
