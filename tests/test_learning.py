"""Learning operators, linear k-mers, and edges of trees and intervals, against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeflow.operators import annotation, intervals, kmers, learning, models, relational, sampling, tree


def test_kmers_across_windows(spark):
    r = random.Random(2)
    seqs = [(i, "".join(r.choices("ACGTNacgt", k=n))) for i, n in enumerate([0, 1, 3, 4, 29, 30, 31, 90, 200])] + [(99, None)]
    df = spark.createDataFrame(seqs, "id long, seq string")
    want = {}
    for i, s in seqs:
        for at in range(len(s or "") - 3):
            k = s[at : at + 4]
            if set(k) <= set("ACGT"):
                want[i, k] = want.get((i, k), 0) + 1
    assert {(x.id, x.kmer): x.n for x in kmers.kmer_counts(df, "id", "seq", 4).collect()} == want
    parts = [x.seq for x in kmers.windows(df.filter("id = 8"), "id", "seq", 4, step=30).collect()]
    assert [len(p) for p in parts] == [33] * 6 + [20]
    k1 = kmers.windows(df.filter("id = 8"), "id", "seq", 1, step=30).collect()
    assert "".join(x.seq for x in k1) == seqs[8][1]


def test_concatenation_in_parts(spark):
    r = random.Random(4)
    rows = [(g, i, "".join(r.choices("ACGT", k=r.choice([0, 1, 5, 40])))) for i, g in enumerate("aabbbccccccccc")]
    whole = {g: "NNNNNNN".join(s for h, _, s in rows if h == g) for g in "abc"}
    for size in (1, 7, 10, 1000):
        got = kmers.concatenated_parts(spark.createDataFrame(rows, "g string, id long, seq string"), "g", "id", "seq", size).collect()
        for g, text in whole.items():
            parts = sorted((x.part, x.seq) for x in got if x.g == g)
            assert [p for p, _ in parts] == list(range(-(-len(text) // size))) and "".join(s for _, s in parts) == text


def test_labels_are_numbered_in_order(spark):
    rows = [("b",), ("a",), (None,), ("b",), ("c",)]
    got = kmers.renumber(spark.createDataFrame(rows, "l string"), "l").collect()
    assert sorted((x.l, x.number) for x in got) == [("a", 0), ("b", 1), ("b", 1), ("c", 2)]


def test_nearest_gap_and_spacers(spark):
    r = random.Random(6)
    make = lambda n: [(r.randrange(5), s, s + r.randrange(1, 20)) for s in (r.randrange(100) for _ in range(n))]
    a, b = make(40), [*make(25), (9, 1, 2)]
    frame = lambda x: spark.createDataFrame(x, "k long, start int, end int")
    want = {}
    for (k, s, e), (j, t, u) in itertools.product(a, b):
        if k == j:
            gap = abs((s + e) / 2 - (t + u) / 2) - (e - s) / 2 - (u - t) / 2
            want[k] = min(want.get(k, math.inf), gap)
    assert {x.k: x.gap for x in intervals.nearest(frame(a), frame(b), "k").collect()} == want
    spacers = spark.createDataFrame([(1, 1, "ACGT"), (1, 2, "TTTTTTTT"), (1, 4, "ACGA"), (1, 9, "ACGA"), (2, 1, "A")], "array long, place int, seq string")
    assert {x.array: x.share for x in intervals.similar_spacers(spacers, "array", "place", "seq").collect()} == {1: 0.25, 2: 0.0}


def test_odd_trees(spark):
    none = spark.createDataFrame([], "id long, idpar long, rank string, name string, v long")
    pairs = tree.closure(none)
    assert pairs.count() == 0
    assert tree.reduce_up(none, pairs, "v", F.sum("x")).count() == 0
    assert models.allocate_down(none, tree.depths(pairs), 1, 5, 1).count() == 0
    assert sampling.representatives_up(none, tree.depths(pairs), spark.createDataFrame([], "id long, item long"), 1, 3).count() == 0
    ring = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "id long, idpar long")
    with pytest.raises(ValueError, match="cycle"):
        tree.closure(ring)


def test_scores_fall_back_to_children(spark):
    nodes = [(1, 0), (2, 1), (3, 1), (4, 2), (5, 2), (6, 5), (7, 3)]
    scores = [(4, 1.0), (4, 3.0), (5, 10.0), (6, 100.0), (3, 7.0)]
    below = {i: [c for c, p in nodes if p == i] for i, _ in nodes}

    def sums(i):
        own = [s for j, s in scores if j == i]
        if own:
            return sum(own), len(own)
        got = [sums(c) for c in below[i]]
        return sum(a for a, _ in got), sum(n for _, n in got)

    pairs = tree.closure(spark.createDataFrame(nodes, "id long, idpar long"))
    got = {x.id: (x.score, x.n) for x in tree.scores_with_fallback(pairs, spark.createDataFrame(scores, "id long, score double")).collect()}
    assert got == {i: (sums(i)[0] / sums(i)[1], sums(i)[1]) for i, _ in nodes if sums(i)[1]}


def test_reports_do_not_lose_columns(spark, monkeypatch):
    df = spark.range(5).select(F.lit(1).alias("r"), "id")
    monkeypatch.setattr(relational, "MAX_COLUMNS", 5)
    assert len(relational.pivot_report(df, "r", "id", F.count(F.lit(1))).columns) == 6
    monkeypatch.setattr(relational, "MAX_COLUMNS", 4)
    with pytest.raises(ValueError, match="columns"):
        relational.pivot_report(df, "r", "id", F.count(F.lit(1)))


def test_scales_scan_and_best(spark):
    assert learning.linear_scale(0.5, 3, 1) == [0.5, 1.5, 2.5] and learning.linear_scale(2, 2) == []
    assert learning.power_scale(2, -1, 4, 2) == [0.5, 2.0, 8.0]
    grid = models.grid(spark, {"c": [1.0, 2.0], "g": [1, 3]})
    found = learning.scan(spark.createDataFrame([(1,), (4,), (5,)], "x int"), grid, {"m": F.sum(F.when(F.col("x") > F.col("c") * F.col("g"), 1).otherwise(0))})
    assert {(x.c, x.g): x.m for x in found.collect()} == {(1.0, 1): 2, (1.0, 3): 2, (2.0, 1): 2, (2.0, 3): 0}
    assert [(x.c, x.g) for x in learning.best_set(found, "m").collect()] == [(1.0, 1)]


def test_decisions_with_masks_and_reliability(spark):
    d = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (1, 3, 9.0), (2, 1, -2.0), (2, 2, -1.0)], "id long, label int, y double")
    known = spark.createDataFrame([(1,), (2,)], "label int")
    assert sorted(tuple(x) for x in learning.classified(d, "id", "label", [0.0, 0.6], known).collect()) == [(1, 0.0, 1), (1, 0.6, 0), (2, 0.0, 0), (2, 0.6, 0)]
    truth = spark.createDataFrame([(1, 2), (2, 1)], "id long, label int")
    norms = spark.createDataFrame([(1, 0.2), (2, 0.4)], "label int, wf double")
    got = {x.label: x.srm for x in learning.reliability(d, truth, norms, "id", "label", 2.0).collect()}
    assert got == pytest.approx({1: math.exp(-(0.2 + 2 * (1.5 + 3)) / 4), 2: math.exp(-(0.4 + 2 * (0.5 + 0)) / 4)})
    soft = learning.classified(d, "id", "label", [-5.0], trust=spark.createDataFrame([(1, 0.1), (2, 1.0)], "label int, srm double"))
    assert sorted((x.id, x.pred) for x in soft.collect()) == [(1, 2), (2, 1)]


def test_models_of_labels_and_folds(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(size=4) + 4 * np.eye(4)[i % 3]], i % 3) for i in range(90)] + [(900, [0.0] * 4, 7)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    found, norms = learning.one_vs_rest(df, df, "id", "v", "label", least=5, maxIter=10)
    assert sorted(x.label for x in norms.collect()) == [0, 1, 2]
    told = {x.id: x.pred for x in learning.classified(found, "id", "label", [-100.0]).collect()}
    assert sum(told[i] == l for i, _, l in rows) >= 85

    def predict(known, asked):
        d, _ = learning.one_vs_rest(known, asked, "id", "v", "label", least=5, maxIter=5)
        return learning.classified(d, "id", "label", [-100.0])

    cv = learning.cross_validated(df.filter("label < 5"), "id", 3, 1, predict).collect()
    assert len(cv) == 90 and {x.fold for x in cv} == {0, 1, 2} and sum(x.pred == x.id % 3 for x in cv) >= 80


def test_confidence_fit_finds_the_sign(spark):
    rows = [(float(s), 100 + s, 20, s % 10 > 3) for s in range(200)]
    df = spark.createDataFrame(rows, "score double, len int, level int, ok boolean").withColumn("score", F.when(F.col("ok"), 80.0).otherwise(20.0) + F.col("score") / 100)
    got = learning.fit_confidence(df, F.col("ok"), F.col("score"), F.col("len"), F.col("level"))
    assert set(got) == {"b0", "b1", "b2", "b3", "b4", "e"}
    sure = df.select("ok", models.confidence(F.col("score"), F.col("len"), F.col("level"), got).alias("c")).groupBy("ok").agg(F.avg("c")).collect()
    by = {x.ok: x[1] for x in sure}
    assert by[True] > 0.9 > 0.1 > by[False]


def test_components_up_to_sign(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(80, 5)) @ np.diag([5, 3, 1, 1, 1])
    x[:, 4] = 2.0
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "id long, v array<double>")
    z = learning.standardised(df, "v").orderBy("id").collect()
    deviation = np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    assert np.array([r.v for r in z]) == pytest.approx((x - x.mean(axis=0)) / deviation)
    got = np.array([r.components for r in learning.principal_components(df, "v", 2, scale_before=True).orderBy("id").collect()])
    s = (x - x.mean(axis=0)) / deviation
    want = s @ np.linalg.svd(s, full_matrices=False)[2][:2].T
    assert np.abs(got) == pytest.approx(np.abs(want), abs=1e-6)
    after = np.array([r.components for r in learning.principal_components(df, "v", 2, scale_after=True).collect()])
    assert after.std(axis=0) == pytest.approx([1, 1])
    shuffled = learning.null_features(df, "id", "v", "shuffled", 1).orderBy("id").collect()
    assert all(sorted(r.v) == sorted(v) for r, v in zip(shuffled, x.tolist(), strict=True)) and [r.v for r in shuffled] != x.tolist()
    assert all(0 <= y < 1 for r in learning.null_features(df, "id", "v", "random", 1).collect() for y in r.v)


def test_full_rows_keep_rejects(spark):
    nodes = spark.createDataFrame([(1, 0, "root", "r"), (2, 1, "family", "f"), (3, 2, None, "x"), (4, 3, "species", "s")], "id long, idpar long, rank string, name string")
    pairs = tree.closure(nodes)
    preds = spark.createDataFrame([("a", 100, "m1", 50.0), ("b", 100, "m0", 50.0), ("c", 9, "m1", 5.0), ("d", 100, "m2", 50.0)], "id string, len int, idscore string, score double")
    meta = spark.createDataFrame([("m1", "one", 4), ("m0", "none", 0), ("m2", "two", 77)], "idscore string, namescore string, taxid long")
    mapped = spark.createDataFrame([(77, 3)], "taxid long, to long")
    levels = {"species": 20, "genus": 30, "family": 40, "root": 100}
    got = {x.id: x for x in models.prediction_rows(preds, meta, nodes, pairs, levels, ["species", "genus", "family"], 10, mapped=mapped).collect()}
    assert set(got) == {"a", "b", "d"} and got["b"].taxid_family is None and got["b"].weight == 100.0
    assert (got["a"].taxid_species, got["a"].taxid_genus, got["a"].taxid_family) == (4, 4, 2)
    assert (got["d"].taxid, got["d"].taxid_species, got["d"].taxid_genus, got["d"].name_family) == (3, 2, 2, "f")
    sure = lambda lev: round(1 / (1 + math.exp(-(-0.5 + 2 * 0.5 + 1.5 * 100**-0.25 + 0.01 * lev + 0.8 * 0.5 * 100**-0.25))), 2)
    assert (got["a"].score_genus, got["a"].score_family) == (sure(20), sure(40))


def test_training_rows_with_background(spark):
    rows = spark.createDataFrame([(l, i) for i, l in enumerate("aaabbbccc")], "l string, id long")
    q = lambda x: spark.createDataFrame(x, "l string, quota long")
    got = annotation.training_rows(rows, q([("c", 2), ("a", 3)]), "l", "id", 1, q([("b", 1)])).collect()
    assert sorted((x.l, x.number) for x in got) == [("a", 1)] * 3 + [("b", 0)] + [("c", 2)] * 2


def test_scores_fall_back_to_the_longest_context_seen(spark):
    """Against a plain scorer at order 4, with contexts that models lack, other symbols, long and short samples."""
    r = random.Random(12)
    groups = {"a": "ACGT", "b": "AC", "c": "ACG", "d": "T"}
    seqs = [(m, "".join(r.choices(s + "N", k=r.choice([3, 60, 300])))) for m, s in groups.items() for _ in range(3)] + [(None, "ACGTACGT"), ("a", None)]
    samples = [(i, "".join(r.choices("ACGTn", [9, 9, 9, 9, 1], k=n))) for i, n in enumerate([0, 4, 5, 6, 40, 700])]
    count, total = {}, {}
    for m, s in seqs:
        for k in range(5):
            for at in range(len(s or "") - k):
                w = s[at : at + k + 1]
                if set(w) <= set("ACGT"):
                    count[m, w] = count.get((m, w), 0) + 1
                    total[m, w[:-1]] = total.get((m, w[:-1]), 0) + 1
    want = {}
    for i, s in samples:
        for at in range(len(s) - 4):
            w = s[at : at + 5]
            for m in groups if set(w) <= set("ACGT") else []:
                seen = next((w[j:] for j in range(5) if (m, w[j:]) in count), None)
                p = (count[m, seen] + 1) / (total[m, seen[:-1]] + 4) if seen else 0.25
                want[i, m] = want.get((i, m), 0) + math.log(p)
    table = models.train(spark.createDataFrame(seqs, "m string, seq string"), "m", "seq", 4)
    for block in (64, 2):
        models.MODEL_BLOCK = block
        got = {(x.id, x.m): x.score for x in models.score(spark.createDataFrame(samples, "id int, seq string"), "id", "seq", table, "m", 4).collect()}
        assert got == pytest.approx(want, abs=1e-9)
    models.MODEL_BLOCK = 64
    assert models.score(spark.createDataFrame([], "id int, seq string"), "id", "seq", table, "m", 4).count() == 0


def test_codes_in_stretches_and_shredding_in_linear_time(spark, monkeypatch):
    import time

    monkeypatch.setattr(kmers, "STEP", 10)
    text = b"ACGTTGCANACGTACGTTTACGACGTACG"
    found = {}
    for k, codes, n in kmers._codes(text, [2, 4], True):
        for c, m in zip(codes.tolist(), n.tolist(), strict=True):
            found[k, c] = found.get((k, c), 0) + m
    want = {}
    for k in (2, 4):
        for at in range(len(text) - k + 1):
            w = text[at : at + k].decode()
            if "N" not in w:
                w = min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA")))
                c = int(w.translate(str.maketrans("ACGT", "0123")), 4)
                want[k, c] = want.get((k, c), 0) + 1
    assert found == want
    seqs = [(1, "é" + "".join(random.Random(1).choices("ACGT", k=1003))), (2, "short"), (3, None)]
    df = spark.createDataFrame(seqs, "id long, seq string")
    for length, offset in [(10, 0), (7, -3), (9, 40), (100, -99), (1004, 0)]:
        got = sorted(tuple(x) for x in kmers.shred(df, "id", "seq", length, offset).collect())
        assert got == [(i, at, at + length, s[at : at + length]) for i, s in seqs if s for at in range(0, len(s) - length + 1, length + offset)]
    took = []
    for n in (200_000, 1_600_000):
        long = spark.range(1).select("id", F.expr(f"repeat('ACGTTGCA', {n // 8})").alias("seq"))
        began = time.time()
        long = kmers.shred(long, "id", "seq", 100, n=5000)
        assert long.filter("length(frag) = 100").count() == min(5000, n // 100)
        took.append(time.time() - began)
    assert took[1] < 8 * max(took[0], 1.0)
