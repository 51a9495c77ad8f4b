"""Near-duplicates and vector searches against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeflow.llm import ann, minhash, topk
from cladeflow.llm.graph import components
from cladeflow.llm.minhash import near_duplicates
from cladeflow.llm.shingles import STEP, shingle_sets

DOCS = "doc_id long, text string"


def true_set(text):
    w = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def true_components(rows):
    sets = {i: true_set(t) for i, t in rows if i is not None}
    of = {i: i for i in sets}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            of[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus():
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    shared = " ".join(r.choices(vocab, k=60))
    for _ in range(25):
        base = r.choices(vocab, k=r.choice([3, 5, 6, 8, 40, 120]))
        for _ in range(r.choice([1, 1, 2, 6])):
            x = list(base)
            for _ in range(r.choice([0, 0, 1, 2])):
                x[r.randrange(len(x))] = r.choice(vocab)
            rows.append((n, ("\t" if n % 3 else " ").join(x).upper() if n % 4 == 0 else " ".join(x)))
            n += 1
    for _ in range(20):  # a common passage that makes no near copy
        rows.append((n, shared + " " + " ".join(r.choices(vocab, k=40))))
        n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "a b"), (n + 4, "A  b"), (n + 5, "b a"), (None, rows[0][1])]


@pytest.mark.parametrize("stars", [True, False])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, stars):
    if not stars:  # all links are left to the rare shingles
        monkeypatch.setattr(minhash, "_may_be", lambda pairs, about, percent: pairs.limit(0))
    rows = corpus()
    docs = spark.createDataFrame([(*x, "clash") for x in rows], DOCS + ", n string")
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    want = true_components(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)


def test_near_duplicates_of_empty_table_and_repeated_rows(spark):
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    got = near_duplicates(spark.createDataFrame([(7, "a b c d e f"), (7, "a b c d e f"), (9, "A b c d e f")], DOCS)).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(7, 7, True), (7, 7, True), (9, 7, False)]


def test_sets_of_long_texts():
    r = random.Random(1)
    long = " ".join(f"word{r.randrange(10**6)}" for _ in range(STEP // 6))
    sets = shingle_sets(["x y", long, None, "", "A b\x0bC\fd e", "a B c d E"])
    assert [len(s) for s in sets] == [1, len(true_set(long)), 0, 0, 1, 1]
    assert sets[4] == sets[5]
    alone = shingle_sets([long[: STEP // 2]])[0]
    assert len(alone) == len(true_set(long[: STEP // 2]))


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (None, 1), (300, 301), (301, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys(range(100, 140), 100), 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(n=700, d=16):
    r = np.random.default_rng(3)
    x = r.normal(size=(n, d)).astype(np.float32)
    x[100:160] = x[100]  # equal vectors
    x[200:240] = x[200] + r.normal(scale=0.01, size=(40, d))
    x[300:330] *= 5
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)]
    bad = [(None, rows[0][1]), (1000, None), (1020, [0.0] * d), (1040, [float("nan")] * d), (1060, [None, *rows[0][1][1:]]), (1080, [float("inf"), *rows[0][1][1:]]), (1100, [])]
    return rows, bad


def expected(rows, whole=False):
    m = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    m = np.floor(m * 64) if whole else m
    ids = np.array([i for i, _ in rows])
    out = {}
    for k, i in enumerate(ids):
        if i % 20 == 0:
            s = m @ m[k]
            s[k] = -np.inf
            order = np.lexsort((ids, -s))[: min(20, len(ids) - 1)]
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def ran(found, key="vec_id"):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r[key], float(r.score)))
    return out


def test_topk_is_exact(spark):
    rows, bad = vectors()
    zero = [(1020, [0.0] * 16)]
    df = spark.createDataFrame([(*x, 1.0) for x in rows + bad], "vec_id long, embedding array<float>, score double")
    assert ran(topk.search(df, F.col("vec_id") % 20 == 0)) == expected(rows + zero, whole=True)


def test_topk_prunes_by_coordinates_and_length(spark, monkeypatch):
    rows, _ = vectors()
    monkeypatch.setattr(topk, "COORDINATES_FROM", 0.05)
    monkeypatch.setattr(topk, "BUCKET", 64)
    monkeypatch.setattr(topk, "ASK", 8)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert ran(topk.search(df, F.col("vec_id") % 20 == 0)) == expected(rows, whole=True)


def test_searches_of_few_or_no_rows(spark):
    rows = [(i, [1.0 * i, 1.0]) for i in (0, 20, 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for found in (topk.search(df, F.col("vec_id") % 20 == 0), ann.search(df, F.col("vec_id") % 20 == 0)):
        assert {k: [i for i, _ in v] for k, v in ran(found).items()} == {0: [3, 20], 20: [3, 0]}
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(none, F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(none, F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("cell", [ann.CELL, 16])
def test_ann_recall_and_scores(spark, monkeypatch, cell):
    monkeypatch.setattr(ann, "CELL", cell)
    monkeypatch.setattr(ann, "ASK", cell)
    rows, bad = vectors()
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got, want = ran(ann.search(df, F.col("vec_id") % 20 == 0)), expected(rows)
    assert got.keys() == want.keys()
    assert all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    m = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows}
    for q, found in got.items():
        for i, s in found:
            assert s == pytest.approx(float(m[q] @ m[i]), abs=1e-12)
