"""What the two vector searches share: usable vectors, equal vectors as one, dealing out, and results by query.

A search asks for the ``k`` best of all rows but the query's own, ties to the smaller id. Rows with equal
vectors score alike everywhere, so they are searched as one, under their ``k + 1`` smallest ids: no
query can need more of them, as it leaves out at most itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there, has components, and none is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """An Arrow column of arrays of one length as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def dealt(sizes: list[tuple[int, int]], most: int) -> list[tuple[int, int, int]]:
    """(key, size) to (key, first, parts): neighbouring keys share a bin while it holds ``most`` rows; a larger
    key has bins of its own, over which its rows are dealt."""
    out, at, held = [], 0, 0
    for key, size in sizes:
        parts = -(-size // most)
        if held and (parts > 1 or held + size > most):
            at, held = at + 1, 0
        out.append((key, at, parts))
        at, held = (at + parts, 0) if parts > 1 else (at, held + size)
    return out


def grouped(rows: DataFrame, k: int) -> DataFrame:
    """(id, v) to a row for each distinct vector: group (its smallest id), v, ids (its k + 1 smallest).

    Spark cuts each group down to k + 1 rows before the shuffle, so that a vector that very many rows
    share isn't gathered.
    """
    some = rows.withColumn("_place", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("_place") <= k + 1)
    return some.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("group"), "v", "ids")


def ranked(found: DataFrame, asking: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """From (ask, group, score), the best groups found for each distinct query vector, to the rows of each
    query: query_id, rank, id, score.

    ``asking``: (query_id, ask); ``members``: (group, ids).
    """
    best = Window.partitionBy("ask").orderBy(F.desc("score"), "group")
    top = found.withColumn("_place", F.row_number().over(best)).filter(F.col("_place") <= k + 1)
    rows = top.join(members.select("group", "ids"), "group").select("ask", "score", F.explode("ids").alias("id"))
    order = Window.partitionBy("ask").orderBy(F.desc("score"), "id")
    rows = rows.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= k + 1)
    lists = rows.groupBy("ask").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id"))).alias("list"))
    # a query's own row is left out, and the first k of the others stay
    mine = asking.join(lists, "ask").select("query_id", F.slice(F.filter("list", lambda x: x["id"] != F.col("query_id")), 1, k).alias("list"))
    out = mine.select("query_id", F.posexplode("list").alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias("id"), (-F.col("hit.minus")).alias("score"))
