"""Exact top-k by inner product: vectors in buckets of like length, pruned by local cosine thresholds.

A first look at the longest vectors gives each query a score that its k-th best can't fall below. In
a bucket whose longest vector has the length l, a vector can only reach that score t if its cosine
with the query is t / (|q| l) or more. Above 1, the bucket is not visited; for a high threshold, each of
a few large coordinates of a unit vector must lie near the query's own, which leaves few vectors;
for a low one, only length decides. What is left is verified by products of the whole vectors.
Buckets are taken longest first, and what a query finds in one raises its threshold for the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.llm.common import Tables, release
from cladeflow.llm.vectors import finite, grouped, matrix, ranked

#: Vectors in a bucket; buckets in a cell at most, and queries in a block, which meet in one task; cells at least.
BUCKET, BUCKETS, ASK, CELLS = 2048, 16, 8192, 12
#: Longest vectors that every query looks at first.
FIRST = 2048
#: From this local threshold on, coordinates prune; and so many of them.
COORDINATES_FROM, COORDINATES = 0.4, 4
#: Relative allowance for rounding in thresholds; scores themselves are sums of integers.
ALLOWANCE = 1e-9


def by_coordinates(unit: np.ndarray, x: np.ndarray, length: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of ``x`` (of the lengths given) may have the cosine with the unit vector or more."""
    keep = np.ones(len(x), dtype=bool)
    for f in np.argsort(-np.abs(unit))[:COORDINATES]:
        middle, reach = unit[f] * cosine, np.sqrt(max(0.0, (1 - unit[f] ** 2) * (1 - cosine**2)))
        # a coordinate of the other unit vector can't leave this range without losing the cosine
        low = -1.0 if unit[f] <= -cosine else middle - reach
        high = 1.0 if unit[f] >= cosine else middle + reach
        y = x[:, f] / length
        keep &= (y >= low - ALLOWANCE) & (y <= high + ALLOWANCE)
    return np.flatnonzero(keep)


def best(scores: np.ndarray, groups: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller group."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
        return some[np.lexsort((groups[some], -scores[some]))[:k]]
    return np.lexsort((groups, -scores))[:k]


def search(rows: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row with ``is_query`` the ``k`` rows with the highest integer inner product of
    floor(``scale`` * component), the row itself left out: query_id, rank (from 1), the other's id under
    ``id_col``, score.

    Buckets hold about ``BUCKET`` vectors of like length; up to ``BUCKETS`` that follow one another form a cell.
    Queries come in blocks of ``ASK``; a query is sent once to each cell down to the last bucket that it
    may need. Equal vectors are searched as one.

    Scores are exact: sums below 2^53 are made in double precision, larger ones in 64-bit integers, and a
    table whose scores might not fit in those raises ``ValueError``.

    Defined results: null vectors, those with null or non-finite components and rows with null ids
    take no part, nor do vectors that aren't as long as most are; zero vectors do; of rows with one id
    each takes part; queries have as many rows as there are others, if fewer than ``k``; an empty table
    gives no rows; other columns are not read.
    """
    spark, tables = rows.sparkSession, Tables(rows.sparkSession)
    v = F.col(vector_col).cast("array<double>")
    usable = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter(finite(F.col("x")) & F.col("id").isNotNull())
    width = usable.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("x", F.abs))).alias("most")).orderBy(F.desc("n"), "d").first()
    if width is None:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    d, most = width.d, width.most * scale + 1
    if d * most**2 >= 2**63:
        raise ValueError("scores may not fit in 64 bits")
    exact = np.float64 if d * most**2 < 2**53 else np.int64
    kind = "int" if most < 2**31 else "long"
    whole = tables.put(usable.filter(F.size("x") == d).select("id", F.transform("x", lambda x: F.floor(x * scale).cast(kind)).alias("v"), "asks"))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    sized = grouped(whole.select("id", "v"), k).withColumn("length", F.sqrt(squares))
    distinct = tables.put(sized.withColumn("class", F.when(F.col("length") > 0, F.floor(F.log2("length") * 64)).otherwise(-100_000)))
    asking = tables.put(whole.filter("asks").select(F.col("id").alias("query_id"), "v").join(distinct.select("v", F.col("group").alias("ask")), "v").select("query_id", "ask"))
    asks = distinct.join(asking.select(F.col("ask").alias("group")).distinct(), "group", "left_semi").select(F.col("group").alias("ask"), "v")

    longest = distinct.orderBy(F.desc("length"), "group").limit(FIRST).select("v").toArrow()
    first = spark.sparkContext.broadcast(matrix(longest["v"], d))

    spans = _spans(distinct)
    classes = spans.orderBy("start", F.desc("class")).collect()
    longest_of, last_of = np.array([r.longest for r in classes]), np.array([r.start + r.parts - 1 for r in classes])
    together = max(1, min(BUCKETS, (int(last_of.max()) + 1) // CELLS))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = matrix(b.column("v"), d)
            scores = q @ first.value.T
            # the query's own vector may be among them, once
            at = scores.shape[1] - k - 1
            least = np.partition(scores, at, axis=1)[:, at] if at >= 0 else np.full(len(q), -np.inf)
            least -= np.abs(least) * ALLOWANCE
            norm = np.sqrt((q**2).sum(axis=1))
            # classes come longest first: how many may reach the score
            n = (norm[:, None] * longest_of[None, :] * (1 + ALLOWANCE) + ALLOWANCE >= least[:, None]).sum(axis=1)
            last = last_of[np.maximum(n, 1) - 1]
            yield pa.RecordBatch.from_arrays([b.column("ask"), b.column("v"), pa.array(least), pa.array(last.astype(np.int32))], ["ask", "v", "least", "last"])
        release()

    placed = distinct.join(F.broadcast(spans), "class").withColumn("bucket", F.col("start") + F.pmod(F.xxhash64("group"), F.col("parts")).cast("int"))
    wants = tables.put(asks.mapInArrow(floors, f"ask long, v array<{kind}>, least double, last int"))
    blocks = max(1, -(-wants.count() // ASK))
    cell_of = lambda bucket: F.floor(bucket / together).cast("int")
    right = wants.withColumn("block", F.pmod(F.xxhash64("ask"), F.lit(blocks)).cast("int"))
    reach = right.groupBy("block").agg(F.max("last").alias("last"))
    met = reach.select(F.col("block").alias("of_block"), F.explode(F.sequence(F.lit(0), cell_of(F.col("last")))).alias("of_cell"))
    right = right.withColumn("cell", F.explode(F.sequence(F.lit(0), cell_of(F.col("last")))))
    left = placed.select(cell_of(F.col("bucket")).alias("of_cell"), "bucket", "group", "v", "length").join(met, "of_cell")

    def verified(have: pa.Table, want: pa.Table) -> pa.Table:
        asks, groups, found = [], [], []
        if have.num_rows and want.num_rows:
            order = np.lexsort((-have["length"].to_numpy(), have["bucket"].to_numpy()))
            bucket, length, group = have["bucket"].to_numpy()[order], have["length"].to_numpy()[order], have["group"].to_numpy()[order]
            x, q = matrix(have["v"], d)[order], matrix(want["v"], d)
            ask, least, last = want["ask"].to_numpy(), want["least"].to_numpy().copy(), want["last"].to_numpy()
            norm = np.sqrt((q**2).sum(axis=1))
            held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in ask]
            names, starts = np.unique(bucket, return_index=True)
            for b, lo, hi in zip(names.tolist(), starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=True):
                _visit(x[lo:hi], length[lo:hi], group[lo:hi], q, norm, least, np.flatnonzero(last >= b), held, k + 1, exact)
            for j, parts in enumerate(held):
                if parts:
                    scores, some = np.concatenate([s for s, _ in parts]), np.concatenate([g for _, g in parts])
                    take = best(scores, some, k + 1)
                    asks.append(np.full(len(take), ask[j]))
                    groups.append(some[take])
                    found.append(scores[take])
        flat = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else [], pa.int64())
        return pa.table({"ask": flat(asks), "group": flat(groups), "score": flat(found)})

    found = left.groupBy("of_cell", "of_block").cogroup(right.groupBy("cell", "block")).applyInArrow(verified, "ask long, group long, score long")
    out = ranked(found, asking, distinct, k)
    return out.select("query_id", "rank", F.col("id").alias(id_col), "score")


def _visit(x: np.ndarray, length: np.ndarray, group: np.ndarray, q: np.ndarray, norm: np.ndarray, least: np.ndarray, who: np.ndarray, held: list, n: int, exact: type) -> None:
    """One bucket (longest first) and the queries ``who``: what reaches a query's threshold ``least`` goes to
    its part of ``held``, and its ``n``-th best so far becomes the threshold where that is higher."""
    # local thresholds: the cosine with the bucket's longest vector, and the length that is needed
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(least > 0, least / (norm * length[0]), -1.0) * (1 - ALLOWANCE)
        needed = np.where(least > 0, least / norm * (1 - ALLOWANCE), 0.0)
    within = np.searchsorted(-length, -needed, side="right")
    who = who[(within[who] > 0) & ~(cosine[who] > 1)]
    whole, asked = x.astype(exact), q.astype(exact)

    def keep(j: int, some: np.ndarray, scores: np.ndarray) -> None:
        some, scores = some[scores >= least[j]], scores[scores >= least[j]]
        if len(some):
            take = best(scores, group[some], n)
            held[j].append((scores[take], group[some[take]]))
            if len(held[j]) > 1 or len(take) == n:
                so_far = np.concatenate([s for s, _ in held[j]])
                if len(so_far) >= n:
                    edge = float(np.partition(so_far, len(so_far) - n)[len(so_far) - n])
                    least[j] = max(least[j], edge - abs(edge) * ALLOWANCE)

    low = who[cosine[who] < COORDINATES_FROM]
    for at in range(0, len(low), 128):
        part = low[at : at + 128]
        scores = asked[part] @ whole[: within[part].max()].T
        for i, j in enumerate(part):
            keep(j, np.arange(within[j]), scores[i, : within[j]])
    for j in who[cosine[who] >= COORDINATES_FROM]:
        m = within[j]
        some = by_coordinates(q[j] / norm[j], x[:m], length[:m], cosine[j])
        if len(some):
            keep(j, some, whole[some] @ asked[j])


def _spans(distinct: DataFrame) -> DataFrame:
    """For each class of lengths: its longest, the first of its buckets and how many it has (rows of one
    class are dealt out by hash; small classes in a row share a bucket). A class is a 64th of a
    power of two, so that there are at most 131,072 of them, however many vectors."""
    n = distinct.groupBy("class").agg(F.count("*").alias("n"), F.max("length").alias("longest"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = F.greatest(F.lit(1), F.floor((before + F.col("n")) / BUCKET) - F.col("start"))
    return n.withColumn("start", F.floor(before / BUCKET).cast("int")).select("class", "longest", "start", parts.cast("int").alias("parts"))
