"""Approximate nearest neighbours: an inverted file with product-quantised residuals.

Vectors are listed under the nearest of a few coarse centroids, and what is left after the centroid is
kept as a byte for each of several groups of dimensions. A query looks into the lists that promise
most; there, tables of its products with all codewords give each vector's approximate score by
additions. Only the codes travel to meet the queries; the original vectors of a query's best by
approximate score, over all lists, are then joined and scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeflow.llm.common import Tables, release
from cladeflow.llm.vectors import dealt, finite, grouped, matrix, ranked

#: Coded vectors (of neighbouring lists), and queries, that meet in one task; cells at least, if they hold ``SMALL``.
CELL, ASK = 65_536, 4096
CELLS, SMALL = 12, 2048


@dataclass
class Index:
    """coarse: centroids by dimension; books: group by codeword by dimension; probes: lists to look into."""

    coarse: np.ndarray
    books: np.ndarray
    probes: int

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The nearest centroid of each row."""
        return nearest(x, self.coarse)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """A byte for each group of dimensions."""
        left = (x - self.coarse[lists]).reshape(len(x), len(self.books), -1)
        return np.stack([nearest(np.ascontiguousarray(left[:, g]), b) for g, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products of each query with all codewords: group by query by codeword."""
        parts = q.reshape(len(q), len(self.books), -1)
        return np.stack([parts[:, g] @ b.T for g, b in enumerate(self.books)]).astype(np.float32)


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest center of each row, a few rows at a time."""
    half, step = (centers**2).sum(axis=1) / 2, max(1, 4_000_000 // len(centers))
    return np.concatenate([(x[at : at + step] @ centers.T - half).argmax(axis=1) for at in range(0, len(x), step)] or [np.empty(0, np.int64)])


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centers)
        n = np.bincount(near, minlength=len(centers))
        order = np.argsort(near, kind="stable")
        starts = (np.cumsum(n) - n)[n > 0]
        centers[n > 0] = np.add.reduceat(x[order], starts) / n[n > 0, None]
        if (n == 0).any():  # an empty centroid moves to a random vector
            centers[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return centers


def fit(sample: np.ndarray, lists: int, groups: int, aim: float, k: int, seed: int = 1) -> Index:
    """Train on a sample, and choose as many lists to look into as hold the share ``aim`` of the sample's
    own ``k`` nearest neighbours."""
    rng = np.random.default_rng(seed)
    coarse = kmeans(sample, lists, rng)
    index = Index(coarse, np.empty((0, 0, 0)), len(coarse))
    near = index.assign(sample)
    left = (sample - coarse[near]).reshape(len(sample), groups, -1)
    index.books = np.stack([_padded(kmeans(np.ascontiguousarray(left[:, g]), 256, rng)) for g in range(groups)])
    asked = sample[: min(256, len(sample))]
    scores = asked @ sample.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    # however small they are, the lists looked into hold k + 1 vectors of the sample at least
    few = np.cumsum(np.sort(np.bincount(near, minlength=len(coarse))))
    least = min(int(np.searchsorted(few, k + 1)) + 1, len(coarse))
    k = min(k, len(sample) - 1)
    if k > 0:
        top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        order = np.argsort(np.argsort(-(asked @ coarse.T), axis=1), axis=1)
        place = np.sort(np.take_along_axis(order, near[top], axis=1).ravel())
        index.probes = max(least, int(place[min(len(place) - 1, int(np.ceil(aim * len(place))))]) + 1)
    return index


def _padded(book: np.ndarray) -> np.ndarray:
    """256 codewords; the last is repeated where a small sample gave fewer."""
    return np.concatenate([book, np.repeat(book[-1:], 256 - len(book), axis=0)])


def search(
    rows: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample: int = 16_384,
    lists: int | None = None,
    groups: int = 16,
    aim: float = 0.99,
    rerank: int = 768,
) -> DataFrame:
    """For each row with ``is_query`` the ``k`` rows found with the largest inner product, the row itself left
    out: query_id, rank (from 1), the other's id under ``id_col``, score (exact, in double precision).

    ``lists``: coarse centroids (default: the number of vectors to the power 0.4, 16 to 4096). ``sample``:
    vectors at most (or 8 for each list, if that is more), by a hash of the id, that centroids and
    codebooks are trained on and that the number of lists to look into is chosen by (``aim``); every
    vector is indexed. ``rerank``: a query's best by approximate score, over all the lists that it looks
    into, that are scored exactly.

    Neighbouring lists form cells of ``CELL`` vectors at most, of which only ids and codes are sent, and
    queries near each other form blocks of ``ASK`` at most; a query goes once to each cell with a list that
    it looks into. A longer list is dealt over several cells. Equal vectors are searched as one.

    Defined results: null and zero vectors, and those with null or non-finite components, neither ask
    nor are found, nor do rows with null ids; vectors are as long as most are (others take no part); of
    rows with one id each takes part; queries have as many rows as there are others, if fewer than
    ``k``; an empty table gives no rows; other columns are not read.
    """
    spark, tables = rows.sparkSession, Tables(rows.sparkSession)
    single = isinstance(rows.schema[vector_col].dataType, T.ArrayType) and isinstance(rows.schema[vector_col].dataType.elementType, T.FloatType)
    kind = "array<float>" if single else "array<double>"
    v = F.col(vector_col).cast(kind)
    usable = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter(finite(F.col("v")) & F.exists("v", lambda x: x != 0) & F.col("id").isNotNull())
    width = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if width is None:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    d, total = width
    usable = tables.put(usable.filter(F.size("v") == d))
    distinct = tables.put(grouped(usable.select("id", "v"), k))
    asking = tables.put(usable.filter("asks").select(F.col("id").alias("query_id"), "v").join(distinct.select("v", F.col("group").alias("ask")), "v").select("query_id", "ask"))
    tables.drop(usable)

    n_lists = lists or int(np.clip(total**0.4, 16, 4096))
    chosen = distinct.orderBy(F.xxhash64("group"), "group").limit(max(sample, 8 * n_lists)).select("v").toArrow()
    parts = next(g for g in range(min(groups, d), 0, -1) if d % g == 0)
    index = spark.sparkContext.broadcast(fit(matrix(chosen["v"], d), n_lists, parts, aim, k))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("v"), d)
            near = index.value.assign(x)
            codes = index.value.encode(x, near)
            width = pa.array(np.arange(len(x) + 1, dtype=np.int32) * parts).buffers()[1]
            yield pa.RecordBatch.from_arrays([b.column("group"), pa.array(near.astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(x), [None, width, pa.py_buffer(codes.tobytes())])], ["group", "list", "codes"])
        release()

    indexed = tables.put(distinct.select("group", "v").mapInArrow(listed, "group long, list int, codes binary"))
    # as many rows as there are lists
    sizes = sorted((r["list"], r["n"]) for r in indexed.groupBy("list").agg(F.count("*").alias("n")).collect())
    cells = dealt(sizes, min(CELL, max(SMALL, -(-sum(n for _, n in sizes) // CELLS))))
    of_list = {a: range(first, first + n) for a, first, n in cells}

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = np.argsort(-(matrix(b.column("v"), d) @ index.value.coarse.T), axis=1, kind="stable")[:, : index.value.probes]
            found = [sorted({c for a in row if a in of_list for c in of_list[a]}) for row in near.tolist()]
            yield pa.RecordBatch.from_arrays([b.column("group"), b.column("v"), pa.array(near[:, 0].astype(np.int32)), pa.array(found, pa.list_(pa.int32()))], ["ask", "v", "near", "cells"])
        release()

    asks = distinct.join(asking.select(F.col("ask").alias("group")).distinct(), "group", "left_semi").select("group", "v")
    asks = tables.put(asks.mapInArrow(probed, f"ask long, v {kind}, near int, cells array<int>"))
    blocks = dealt(sorted((r["near"], r["n"]) for r in asks.groupBy("near").agg(F.count("*").alias("n")).collect()), ASK)
    bins = lambda found, key: F.broadcast(spark.createDataFrame(found, f"{key} int, first int, parts int"))
    bin_of = lambda key: (F.col("first") + F.pmod(F.xxhash64(key), F.col("parts"))).cast("int")
    right = asks.join(bins(blocks, "near"), "near").select(bin_of("ask").alias("block"), F.explode("cells").alias("cell"), "ask", "v")
    met = right.select(F.col("cell").alias("of_cell"), F.col("block").alias("of_block")).distinct()
    left = indexed.join(bins(cells, "list"), "list").select(bin_of("group").alias("of_cell"), "group", "list", "codes").join(met, "of_cell")

    def scored(have: pa.Table, want: pa.Table) -> pa.Table:
        """Each query's best by approximate score among the lists of a cell that it looks into."""
        ix, asks, groups, scores = index.value, [], [], []
        if have.num_rows and want.num_rows:
            where = have["list"].to_numpy()
            order = np.argsort(where, kind="stable")
            group, where = have["group"].to_numpy()[order], where[order]
            codes = np.frombuffer(b"".join(have["codes"].to_pylist()), dtype=np.uint8).reshape(len(where), -1)[order].T.astype(np.intp)
            names, starts = np.unique(where, return_index=True)
            ends = [*starts[1:].tolist(), len(where)]
            ask, vectors = want["ask"].to_numpy(), matrix(want["v"], d)
            for at in range(0, len(ask), 64):
                q = vectors[at : at + 64]
                near = q @ ix.coarse.T
                looks = np.zeros(near.shape, dtype=bool)
                np.put_along_axis(looks, np.argsort(-near, axis=1, kind="stable")[:, : ix.probes], True, axis=1)
                table, about = ix.tables(q), np.full((len(q), len(where)), -np.inf, dtype=np.float32)
                for a, lo, hi in zip(names.tolist(), starts.tolist(), ends, strict=True):
                    who = np.flatnonzero(looks[:, a])
                    if who.size:
                        part = np.repeat(near[who, a, None].astype(np.float32), hi - lo, axis=1)
                        for g in range(len(table)):
                            part += np.take(table[g][who], codes[g, lo:hi], axis=1)
                        about[who, lo:hi] = part
                n = min(rerank + 1, len(where))
                best = np.argpartition(-about, n - 1, axis=1)[:, :n]
                value = np.take_along_axis(about, best, axis=1)
                some = np.isfinite(value)
                asks.append(np.repeat(ask[at : at + 64], some.sum(axis=1)))
                groups.append(group[best[some]])
                scores.append(value[some])
        flat = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
        return pa.table({"ask": flat(asks, pa.int64()), "group": flat(groups, pa.int64()), "about": flat(scores, pa.float32())})

    found = left.groupBy("of_cell", "of_block").cogroup(right.groupBy("cell", "block")).applyInArrow(scored, "ask long, group long, about float")
    best = Window.partitionBy("ask").orderBy(F.desc("about"), "group")
    near = tables.put(found.withColumn("_place", F.row_number().over(best)).filter(F.col("_place") <= rerank + 1).select("ask", "group"))
    tables.drop(indexed)
    product = F.aggregate(F.zip_with("v", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    exact = near.join(distinct.select("group", "v"), "group").join(asks.select("ask", F.col("v").alias("q")), "ask").select("ask", "group", product.alias("score"))
    out = ranked(exact, asking, distinct, k)
    return out.select("query_id", "rank", F.col("id").alias(id_col), "score")
