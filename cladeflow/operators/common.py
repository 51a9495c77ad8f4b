"""Helpers of all operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeflow.functions.columns import seeded


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Where it names none, a local session gets a
    folder of this process; a cluster, whose machines don't share one, gets an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df``, hinted for broadcast if it is counted to have at most ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def summed(df: DataFrame) -> DataFrame:
    """small() of an aggregate that is written first, so that what it sums up isn't read twice."""
    return small(cut(df))


def first_by(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; Spark cuts groups down before the shuffle."""
    at = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_at", F.row_number().over(at)).filter(F.col("_at") <= n).drop("_at")


def range_bucket(df: DataFrame, key: str, n: int = 256) -> Column:
    """About ``n`` ranges of a key with as many rows each, numbered in its order, with bounds from a sample of rows: a
    key of very many rows fills a range of its own, and doesn't crowd out others."""
    rows = df.select(key).filter(F.col(key).isNotNull())
    # which rows are drawn only moves the bounds
    found = sorted(r[0] for r in rows.orderBy(F.xxhash64(key, F.monotonically_increasing_id())).limit(16 * n).collect())
    bounds = F.array(*[F.lit(x) for x in dict.fromkeys(found[15::16])])
    return F.size(F.filter(bounds, lambda b: b <= F.col(key))) if len(found) > 15 else F.lit(0)


def in_seeded_order(df: DataFrame, group: str, ident: str, seed: int | str, value: Column) -> DataFrame:
    """running() in the order of a seeded hash of ``ident``, in buckets of that hash."""
    h = seeded(ident, seed)
    return running(df, group, F.coalesce(F.substring(h, 1, 2), F.lit("")), [h, F.col(ident)], value)


def running(df: DataFrame, group: str, bucket: Column, order: list, value: Column) -> DataFrame:
    """``df`` with _run, the sum of ``value`` in its group up to each row in ``order``, and _total, the
    group's. ``bucket`` rises with ``order``, and equal keys share one: buckets are summed up, the few sums
    are added along each group, and rows are put in order within buckets, so that no task holds a group."""
    x = df.withColumn("_b", bucket).withColumn("_v", value)
    sums = x.groupBy(group, "_b").agg(F.sum("_v").alias("_n"))
    of = Window.partitionBy(group)
    before = F.sum("_n").over(of.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    start = sums.select(F.col(group).alias("_g"), F.col("_b").alias("_c"), F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(of).alias("_total"))
    own = F.sum("_v").over(Window.partitionBy(group, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    # both null-safe: from a plain equality Spark infers a filter of _c by the columns that _b is made of
    # the sums are written once, at most a row for each group and bucket
    placed = x.join(summed(start), F.col(group).eqNullSafe(F.col("_g")) & F.col("_b").eqNullSafe(F.col("_c")))
    return placed.withColumn("_run", own + F.col("_before")).drop("_b", "_v", "_g", "_c", "_before")
