"""Shards as runs of a Hilbert curve over several metadata dimensions.

Neighbours on the curve are near in every dimension, so that a run of it spans few values of each and
a reader that filters by any of them skips most files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.llm.common import cut, within
from cladeflow.operators.common import range_bucket, running

#: Levels of each dimension: 2 to this power.
BITS = 6
#: Rows at most that one group of the last sort should hold, where the curve has few points or a text many copies.
GROUP = 1_000_000
#: Texts of more copies that are broadcast at most.
BROADCAST_ROWS = 100_000


def hilbert(point: str, dims: int, bits: int = BITS) -> Column:
    """Index on the Hilbert curve of a point: an array<bigint> expression of ``dims`` levels.

    Transposed axes are untangled from the high bit down, Gray-coded and interleaved.
    """
    undo = f"""aggregate(sequence({bits - 1}, 1, -1), {point}, (p, q) -> aggregate(sequence(0, {dims - 1}), p, (x, i) ->
        IF((x[i] & shiftleft(1L, q)) <> 0,
           transform(x, (v, k) -> IF(k = 0, v ^ (shiftleft(1L, q) - 1), v)),
           transform(x, (v, k) -> IF(k = 0 OR k = i, v ^ IF(i = 0, 0L, (x[0] ^ x[i]) & (shiftleft(1L, q) - 1)), v)))))"""
    h = f"""aggregate(array({undo}), 0L, (none, u) -> aggregate(array(transform(u, (v, k) -> aggregate(slice(u, 1, k + 1), 0L, (a, b) -> a ^ b))), 0L, (no, g) ->
        aggregate(array(aggregate(sequence({bits - 1}, 1, -1), 0L, (t, q) -> IF((g[{dims - 1}] & shiftleft(1L, q)) <> 0, t ^ (shiftleft(1L, q) - 1), t))), 0L, (nil, t) ->
        aggregate(sequence({bits - 1}, 0, -1), 0L, (h, q) -> aggregate(g, h, (s, v) -> s * 2 + (shiftright(v ^ t, q) & 1L))))))"""
    return F.expr(h)


def size_level(size: Column, bits: int = BITS) -> Column:
    """Two levels for each power of two of a size of 1 or more."""
    whole = F.length(F.bin(size)) - 1
    half = F.when(size * 2 >= F.pow(F.lit(2.0), whole) * 3, 1).otherwise(0)
    return F.least(whole * 2 + half, F.lit(2**bits - 1)).cast("long")


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, str] = ("source", "lang")) -> DataFrame:
    """Put all rows into ``shards`` runs of the Hilbert curve over ``dims`` and the text's size.

    Law ``rows``: the shards' row counts are at most one apart. Returns id, size (UTF-8 bytes of the text
    plus 1), text_crc32, curve (the index), law, shard, slot (gapless from 0), grown_shard (null).

    A row's place is the number of rows before its point of the curve, plus those of the same point
    with a smaller salt (a hash of the text), plus its place among those few in the order of texts, so that no task
    sorts more than a salted part of a point, however many rows share it. Equal texts of a point are
    neighbours: only the borders between shards may divide one. A text of more than ``GROUP`` copies is
    salted by their ids as well, in parts that follow each other. Values of the dimensions and points are put in
    order within ranges of them, however many there are. The text itself is not shuffled.

    Defined results: a null text has size 1 and the CRC of no bytes; null dimensions are a value of
    their own, after all others; equal rows are neighbours; an empty table has no rows;
    other columns are not read.
    """
    text = F.col(text_col).cast("string")
    key = [F.when(F.col(d).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(d).cast("string"))).alias(f"key{k}") for k, d in enumerate(dims)]
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    crc = F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))
    total = docs.count()
    salts = max(64, total // GROUP)
    rows = docs.select(F.col(id_col).alias("id"), size.alias("size"), crc.alias("crc"), *key)
    rows = rows.withColumn("level", size_level(F.col("size"))).withColumn("salt", F.pmod(F.xxhash64("crc", "size"), F.lit(salts)))
    keys = [f"key{k}" for k in range(len(dims))]
    counts = cut(rows.groupBy(*keys, "level", "salt").agg(F.count("*").alias("n")))
    rows, apart = rows.withColumn("own", F.lit(0).cast("long")).withColumn("sub", F.lit(-1).cast("long")), [*keys, "level", "salt", "own", "sub"]
    hot = counts.filter(F.col("n") > GROUP)
    if hot.isEmpty():
        counts = counts.withColumn("own", F.lit(0).cast("long")).withColumn("sub", F.lit(-1).cast("long"))
    else:  # texts of very many copies get groups of their own
        texts = rows.join(within(hot.drop("n"), BROADCAST_ROWS), [*keys, "level", "salt"], "left_semi").groupBy(*keys, "level", "crc", "size").agg(F.count("*").alias("n"))
        heavy = cut(texts.filter(F.col("n") > GROUP).withColumn("parts", F.ceil(F.col("n") / GROUP)).drop("n"))
        rows = rows.join(within(heavy, BROADCAST_ROWS), [*keys, "level", "crc", "size"], "left")
        rows = rows.withColumn("own", F.when(F.col("parts").isNotNull(), F.xxhash64("crc", "size")).otherwise(0)).withColumn("sub", F.coalesce(F.pmod(F.xxhash64("id"), "parts"), F.lit(-1)))
        counts = cut(rows.groupBy(*apart).agg(F.count("*").alias("n")))
    cells = counts.groupBy(*keys, "level").agg(F.sum("n").alias("n"))
    levels = []
    for k in keys:  # the values of a dimension, in order, spread over its levels
        values = cells.groupBy(k).agg(F.lit(0).alias("all"))
        values = running(values, "all", range_bucket(values, k), [k], F.lit(1))
        cells = cells.join(values.select(k, F.floor((F.col("_run") - 1) * 2**BITS / F.col("_total")).cast("long").alias(f"at_{k}")), k)
        levels.append(f"at_{k}")
    cells = cut(cells.withColumn("curve", hilbert(f"array({', '.join(levels)}, level)", len(dims) + 1)).withColumn("all", F.lit(0)))
    cells = running(cells, "all", range_bucket(cells, "curve"), ["curve", *keys, "level"], F.col("n"))
    cells = cells.select(*keys, "level", "curve", (F.col("_run") - F.col("n")).alias("cell_start"))
    here = Window.partitionBy(*keys, "level").orderBy("salt", "own", "sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("among", F.coalesce(F.sum("n").over(here), F.lit(0))).join(cells, [*keys, "level"])
    starts = starts.select(*apart, "curve", (F.col("cell_start") + F.col("among")).alias("start"))
    placed = rows.join(starts, apart)
    rank = F.col("start") + F.row_number().over(Window.partitionBy(*apart).orderBy("crc", "size", "id")) - 1
    out = placed.withColumn("rank", rank).withColumn("shard", F.expr(f"(rank * {shards}) div {max(total, 1)}"))
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "curve", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
