"""Exact nearest neighbours by distances to pivots.

Points are kept in cells around a few of their own number. What is nearer to a query than its bound lies, by the
triangle inequality, in cells and at distances from their pivots that the query's own distances to
the pivots tell. A query visits its own cell first, which gives the bound for all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.operators.common import cut, first_by

#: Pivots at most; points and queries of a cell that meet in one task.
PIVOTS, POINTS, QUERIES = 256, 16_384, 2048
#: Distances are sums of rounded squares: what a bound is widened by.
SLACK = 1e-9


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equal lists of numbers as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Row by pivot."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def nearest_points(queries: DataFrame, points: DataFrame, k: int, ident: str, vector: str, label: str, most: float | None = None, counter=None, itself: bool = False) -> DataFrame:
    """(id_q, id_p, label, dist): the ``k`` points of other ids that are nearest to each query, ties to smaller ids, within
    ``most`` if that is given; ``itself``: of any ids. ``counter``, an accumulator, is told how many distances were worked out.

    Cells are cut into parts of ``POINTS``, and the queries that visit a cell into blocks of ``QUERIES``, so that
    no task holds more, however many points share a cell. Points and queries with null
    vectors or components take no part; vectors of different lengths raise an error.
    """
    ok = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())
    vectors = lambda df, i, v: df.filter(ok).select(F.col(ident).alias(i), F.transform(vector, lambda x: x.cast("double")).alias(v))
    p = points.filter(ok).select(F.col(ident).alias("id_p"), F.transform(vector, lambda x: x.cast("double")).alias("v_p"), F.col(label).alias("label"))
    q = vectors(queries, "id_q", "v_q")
    kinds = {c: t.simpleString() for c, t in [("id_p", p.schema["id_p"].dataType), ("label", p.schema["label"].dataType), ("id_q", q.schema["id_q"].dataType)]}
    n, lengths = p.count(), p.select(F.size("v_p").alias("d")).union(q.select(F.size("v_q"))).distinct().limit(2).collect()
    if len(lengths) > 1:
        raise ValueError("vectors of different lengths")
    found = f"id_q {kinds['id_q']}, id_p {kinds['id_p']}, label {kinds['label']}, dist double"
    if not n:
        return queries.sparkSession.createDataFrame([], found)
    pivots = int(np.clip(np.sqrt(n) / 2, 1, PIVOTS))
    centres = np.array([x.v_p for x in p.orderBy(F.xxhash64("id_p", "v_p"), "id_p").limit(pivots).select("v_p").collect()], dtype=np.float64).reshape(-1, lengths[0].d)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = _distances(_matrix(b.column("v_p")), centres)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], [*b.schema.names, "cell", "r"])

    placed = cut(p.mapInArrow(place, f"id_p {kinds['id_p']}, v_p array<double>, label {kinds['label']}, cell int, r double"))
    # a row for each pivot
    sizes = {x.cell: (x.n, x.r) for x in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("r").alias("r")).collect()}
    held = np.array([sizes.get(c, (0, 0.0))[0] for c in range(len(centres))])
    radius = np.array([sizes.get(c, (0, -np.inf))[1] for c in range(len(centres))])

    def first_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nearest cells that hold k others at least."""
        for b in batches:
            order = np.argsort(_distances(_matrix(b.column("v_q")), centres), axis=1, kind="stable")
            many = 1 + (np.cumsum(held[order], axis=1) < min(k + 1, n)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([row[:m].tolist() for row, m in zip(order, many, strict=True)], pa.list_(pa.int32()))], ["id_q", "v_q", "cells"])

    def other_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All further cells that may hold a nearer point than the bound."""
        for b in batches:
            d, bound = _distances(_matrix(b.column("v_q")), centres), b.column("bound").to_numpy()
            near = (d - radius <= (bound + SLACK * (1 + bound))[:, None]) & (held > 0)
            yield pa.RecordBatch.from_arrays([b.column("id_q"), b.column("v_q"), b.column("bound"), pa.array([sorted(set(np.flatnonzero(row).tolist()) - set(seen)) for row, seen in zip(near, b.column("cells").to_pylist(), strict=True)], pa.list_(pa.int32()))], ["id_q", "v_q", "bound", "cells"])

    def compare(have: pa.Table, want: pa.Table) -> pa.Table:
        rows, who, dist, done = [], [], [], 0
        if have.num_rows and want.num_rows:
            have = have.sort_by("r")
            x, r, ids = _matrix(have["v_p"]).T.copy(), have["r"].to_numpy(), have["id_p"].to_numpy()
            mine, bounds = want["id_q"].to_numpy(), want["bound"].to_numpy()
            vectors, centre = _matrix(want["v_q"]), centres[have["cell"][0].as_py()]
            for i, v in enumerate(vectors):
                far = np.sqrt(((v - centre) ** 2).sum())
                reach = bounds[i] + SLACK * (1 + bounds[i])
                lo, hi = np.searchsorted(r, far - reach), np.searchsorted(r, far + reach, side="right")
                done += int(hi - lo)
                d = np.sqrt(((x[:, lo:hi] - v[:, None]) ** 2).sum(axis=0))
                at = np.flatnonzero(((ids[lo:hi] != mine[i]) | itself) & (d <= reach))
                if len(at) > k:
                    at = at[d[at] <= np.partition(d[at], k - 1)[k - 1]]
                at = sorted(at.tolist(), key=lambda j: (d[j], ids[lo + j]))[:k]
                rows += [lo + j for j in at]
                who += [i] * len(at)
                dist += d[at].tolist()
        if counter is not None:
            counter.add(done)
        take = lambda t, c, rows: t[c].combine_chunks().take(pa.array(rows, pa.int64())) if t.num_rows else pa.array([], t.schema.field(c).type)
        return pa.table({"id_q": take(want, "id_q", who), "id_p": take(have, "id_p", rows), "label": take(have, "label", rows), "dist": pa.array(dist, pa.float64())})

    def visited(asked: DataFrame) -> DataFrame:
        asked = cut(asked.select("id_q", "v_q", "bound", F.explode("cells").alias("cell")))
        many = {x.cell: x.n for x in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        facts = [(c, -(-int(held[c]) // POINTS), -(-m // QUERIES)) for c, m in many.items() if held[c]]
        if not facts:
            return queries.sparkSession.createDataFrame([], found)
        facts = F.broadcast(queries.sparkSession.createDataFrame(facts, "cell int, parts int, blocks int"))
        each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = placed.join(facts, "cell").withColumn("part", F.pmod(F.xxhash64("id_p", "v_p"), "parts").cast("int")).withColumn("block", each("blocks"))
        right = asked.join(facts, "cell").withColumn("block", F.pmod(F.xxhash64("id_q"), "blocks").cast("int")).withColumn("part", each("parts"))
        by = ["cell", "part", "block"]
        return left.drop("parts", "blocks").groupBy(*by).cogroup(right.drop("parts", "blocks").groupBy(*by)).applyInArrow(compare, found)

    limit = float("inf") if most is None else float(most)
    begun = cut(q.mapInArrow(first_cells, f"id_q {kinds['id_q']}, v_q array<double>, cells array<int>"))
    one = cut(visited(begun.withColumn("bound", F.lit(limit))))
    # one id may have several rows, whose bounds are its widest
    kth = one.withColumn("_at", F.row_number().over(Window.partitionBy("id_q").orderBy("dist", "id_p"))).filter(F.col("_at") == k).select("id_q", F.col("dist").alias("kth"))
    again = begun.join(kth, "id_q", "left").withColumn("bound", F.least(F.coalesce("kth", F.lit(float("inf"))), F.lit(limit))).select("id_q", "v_q", "bound", "cells")
    two = visited(again.mapInArrow(other_cells, f"id_q {kinds['id_q']}, v_q array<double>, bound double, cells array<int>"))
    near = one.union(two)
    near = near.filter(F.col("dist") <= most) if most is not None else near
    return first_by(near, ["id_q"], [F.col("dist"), F.col("id_p")], k)
