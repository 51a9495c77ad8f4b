"""Connected components of links that no single machine needs to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.llm.common import Tables


#: Up to so many links (of 16 bytes or two names) a round is one task without a shuffle.
ROWS = 200_000


def components(links: DataFrame, tables: Tables | None = None) -> DataFrame:
    """``links`` (a, b) of any ordered type, to a row (node, component) for each node in a link between
    different nodes; the component is its smallest node.

    Large and small stars by turns: every node hands its larger neighbours, then its smaller ones, to
    the smallest node that it knows. Sums are taken before they are shuffled and joins are plain
    equi-joins, so that a node with very many links is split as any other skewed key. Each round is
    written as a table, and the round before deleted. Nulls link nothing; repeated and reversed
    links are one.
    """
    tables = tables or Tables(links.sparkSession)
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b AND a IS NOT NULL AND b IS NOT NULL").distinct()
    links, before = tables.put(links), None
    while True:
        r = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if r[0] == 0 or tuple(r) == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = tuple(r)
        few = links.coalesce(1) if r[0] <= ROWS else links
        both = few.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*")
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select("a", "b", "low")
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))).alias("x")).select("x.*").filter("a <> b").distinct()
        done = tables.put(small)
        tables.drop(links)
        links = done
