"""Interval operators across bins against plain versions."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from cladeflow.operators import intervals


def spans(r, n, keys=(1, 2, None)):
    out = []
    for _ in range(n):
        s = r.randrange(-50, 400)
        out.append((r.choice(keys), s, s + r.choice([0, 1, 2, 7, 30, 200])))
    return out


def frame(spark, rows, *more):
    return spark.createDataFrame(rows, ", ".join(["k int, start int, end int", *more]))


@pytest.mark.parametrize("width", [1 << 16, 16])
def test_unions_totals_pairs_and_gaps(spark, monkeypatch, width):
    monkeypatch.setattr(intervals, "WIDTH", width)
    r = random.Random(width)
    a, b = spans(r, 60), spans(r, 50)
    kinds = [r.choice("xy") for _ in a]
    places = lambda rows, k: [p for key, s, e in rows if key == k for p in range(s, e)]
    want = []
    for k in (1, 2, None):
        at = sorted(set(places(a, k)))
        for p in at:
            if p - 1 in at:
                want[-1][2] = p + 1
            else:
                want.append([k, p, p + 1])
    got = [list(x) for x in intervals.merged(frame(spark, a), ["k"]).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)

    asked = frame(spark, [(*x, c) for x, c in zip(a, kinds, strict=True)], "kind string")
    totals, covered = {}, {}
    for (k, s, e), c in zip(a, kinds, strict=True):
        for j, t, u in b:
            if k == j:
                totals[k, c] = totals.get((k, c), 0) + max(0, min(e, u) - max(s, t))
    for k, c in itertools.product((1, 2, None), "xy"):
        covered[k, c] = len({p for (key, s, e), x in zip(a, kinds, strict=True) if (key, x) == (k, c) for p in range(s, e)} & set(places(b, k)))
    some = lambda d: {k: v for k, v in d.items() if v}
    assert {(x.k, x.kind): x.overlap for x in intervals.overlap_totals(asked, frame(spark, b), ["k"], ["kind"]).collect()} == some(totals)
    assert {(x.k, x.kind): x.covered for x in intervals.coverage(asked, frame(spark, b), ["k"], "kind").collect()} == some(covered)

    pairs = sorted((k, s, e, t, u) for (k, s, e), (j, t, u) in itertools.product(a, b) if k is not None and k == j and s < u and t < e and s < e and t < u)
    got = sorted(tuple(x) for x in intervals.overlapping(frame(spark, a), frame(spark, b), ["k"], 16).collect())
    assert got == pairs

    gaps = {}
    for (k, s, e), (j, t, u) in itertools.product(a, b):
        if k == j:
            gaps[k] = min(gaps.get(k, math.inf), abs((s + e) / 2 - (t + u) / 2) - (e - s) / 2 - (u - t) / 2)
    assert {x.k: x.gap for x in intervals.nearest(frame(spark, a), frame(spark, b), "k").collect()} == gaps


def test_one_key_is_many_tasks(spark):
    """A million intervals of one key: no task of the sorted steps sees a large part of them."""
    n = 1_000_000
    df = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 40 + F.pmod(F.xxhash64("id"), F.lit(20))).alias("start")).withColumn("end", F.col("start") + 25)
    assert df.groupBy(intervals._bin(F.col("start"))).count().agg(F.max("count")).first()[0] < n / 500
    out = intervals.merged(df, ["k"])
    total = out.agg(F.sum(F.col("end") - F.col("start"))).first()[0]
    assert total == intervals.coverage(df.withColumn("kind", F.lit("x")), df, ["k"], "kind").first().covered
