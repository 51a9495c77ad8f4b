"""Operators whose work must not grow faster than the input: their results against naive versions, and the shape of their plans."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from cladeflow.operators import intervals, kmers, tree
from cladeflow.plans import registry

NODES = "id long, idpar long, rank string, name string"


@pytest.fixture(scope="module")
def bushy(spark):
    r = random.Random(6)
    rows = [(1, 0, "root", "root")]
    for i in range(2, 120):
        rows.append((i, r.choice(rows)[0], r.choice(["species", "genus", "family", None]), f"n{i}"))
    nodes = spark.createDataFrame(rows, NODES)
    parent = {i: p for i, p, *_ in rows}
    lineage = {}
    for i in parent:
        up, x = [], i
        while x in parent:
            up.append(x)
            x = parent[x]
        lineage[i] = up
    return nodes, tree.closure(nodes), lineage


def on_top(df) -> list[str]:
    """Operators of the plan above the topmost join."""
    node, names = df._jdf.queryExecution().optimizedPlan(), []
    while node.nodeName() != "Join":
        names.append(node.nodeName())
        node = node.children().apply(0)
    return names


@pytest.mark.parametrize("bound", [0, 1, 3, 50])
def test_fill_up_order_is_made_once(spark, bushy, monkeypatch, bound):
    monkeypatch.setattr(tree, "BLOCK", 4)
    nodes, pairs, lineage = bushy
    targets, others = [3, 7, 40, 41, 90, 90, 119, 1], [x for x in lineage if x % 3 != 1]
    frame = lambda ids: spark.createDataFrame([(x,) for x in ids], "id long")
    out = tree.fill_up_order(pairs, frame(targets), frame(others), bound)
    want = set()
    for a in set(targets):
        near = sorted((up, b) for b in others if b != a for up in [next(k for k, c in enumerate(lineage[a]) if c in lineage[b])] if up <= bound)
        want |= {(a, b, up, k) for k, (up, b) in enumerate(near, 1)}
    rows = [(r.target, r.id, r.up, r.place) for r in out.collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert set(on_top(out)) <= {"Project", "Filter"}  # nothing is shuffled or sorted behind the join


def test_fill_up_order_numbers_no_list_in_vain(spark, bushy, monkeypatch):
    """Leaves under themselves give no rows, so they are neither listed nor numbered, and a list's ranges are read, not made twice."""
    nodes, pairs, lineage = bushy
    leaves = sorted(set(lineage) - {a for up in lineage.values() for a in up[1:]})[:9]
    given, real = [], tree.running
    monkeypatch.setattr(tree, "running", lambda df, *a: given.append((df, a)) or real(df, *a))
    targets, others = spark.createDataFrame([(x,) for x in leaves], "id long"), nodes.select("id")
    out = tree.fill_up_order(pairs, targets, others, 1).collect()
    [(lists, (_, bucket, *_))] = given
    assert {r._list for r in lists.select("_list").distinct().collect()} == {lineage[x][1] for x in leaves}
    assert bucket._jc.toString() in lists.columns
    want = {(x, b, 1) for x in leaves for b in lineage if b != x and lineage[x][1] in lineage[b]}
    assert len(out) == len(want) and {(r.target, r.id, r.up) for r in out} == want


def test_best_outside_equals_naive(spark, bushy):
    nodes, pairs, lineage = bushy
    ranks = ["genus", "family"]
    rank_of = {r.id: r.rank for r in nodes.collect()}
    r = random.Random(3)
    rows = [(s, m, r.choice(list(lineage)), float(r.randrange(5)), t) for s in range(40) for t in [r.choice(list(lineage))] for m in range(6)] + [(99, 1, 1000, 1.0, 7)]
    cand = spark.createDataFrame(rows, "s int, m int, node long, x double, truth long")
    order = [F.desc("x"), F.col("m")]
    want = set()
    for s in {x[0] for x in rows}:
        mine = [x for x in rows if x[0] == s]
        for zone in [a for a in lineage[mine[0][4]] if rank_of[a] in ranks]:
            free = [x for x in mine if zone not in lineage.get(x[2], [])]
            if free:
                want.add((s, rank_of[zone], zone, min((-x[3], x[1]) for x in free)))
    # of several zones of one rank a sample has the best of all
    best = {}
    for s, lev, _, b in want:
        best[s, lev] = min(best.get((s, lev), b), b)
    out = tree.best_outside(cand, nodes, pairs, "s", "node", "truth", ranks, order)
    assert {(x.s, x.lev): (-x.x, x.m) for x in out.collect()} == best and out.count() == len(best)
    given = tree.with_above(tree.with_zones(cand, nodes, pairs, "truth", ranks), nodes, pairs, "node", ranks)
    assert tree.best_outside(given, nodes, pairs, "s", "node", "truth", ranks, order).select(*out.columns).exceptAll(out).count() == 0


@pytest.mark.parametrize("name", ["m1_benchmark_pairs", "w9_next_outside"])
def test_candidates_are_not_shuffled_by_node(spark, sf, name):
    """All line items have 25 nodes, so that a shuffle by node is 25 tasks and a copy of them all."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(l_orderkey#" in plan and "hashpartitioning(node#" not in plan


@pytest.mark.parametrize("step", [50, 1 << 20])
def test_drawn_bases_equal_hashlib(spark, monkeypatch, step):
    """Ids and places of any number of digits, several hashes at once."""
    monkeypatch.setattr(kmers, "DRAWN", 64)
    monkeypatch.setattr(kmers, "STEP", step)
    r = random.Random(2)
    rows = [(x, None if n is None else "".join(r.choices("ACGTacgtxyN\n\u00e9\U0001f600", k=n))) for x, n in [("7", 1), ("12345", 30), ("", 200), ("a" * 60, 40), ("9", 1500), ("0", 0), (None, 20), ("5", None), ("-3", 12)]]
    idents, texts = [x for x, _ in rows], [t for _, t in rows]
    draw = lambda x, k: "ACGT"[int(hashlib.md5(f"{x}-{k}:4".encode()).hexdigest()[:4], 16) % 4]
    whole = lambda x, t: "".join(p if re.match("[ACGTacgt]", p) else "" if x is None else draw(x, k) for k, p in enumerate(re.findall("(?s)[ACGTacgt]+|[^ACGTacgt]", t)))
    assert kmers._replaced(idents, texts, b":4") == [None if t is None else whole(x, t) for x, t in rows]
    out = kmers.replace_degenerate(spark.createDataFrame([(k, x, t) for k, (x, t) in enumerate(rows)], "k int, x string, t string"), "x", "t", 4)
    assert out.columns == ["k", "x", "t"] and out.orderBy("k").first().t == whole(*rows[0])


def test_kmers_of_whole_sequences_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(kmers, "STEP", 20)
    r = random.Random(5)
    rows = [(k, "".join(r.choices("ACGTN", k=n))) for k, n in enumerate([0, 3, 19, 20, 21, 200])]
    count = lambda rows: {(k, t[i : i + 3]): sum(u[j : j + 3] == t[i : i + 3] for m, u in rows if m == k for j in range(len(u))) for k, t in rows for i in range(len(t) - 2) if "N" not in t[i : i + 3]}
    for given in (rows, rows + rows[2:4]):  # ids that occur once, and twice
        out = kmers.kmer_counts(spark.createDataFrame([*given], "id int, s string"), "id", "s", 3)
        got = [((x.id, x.kmer), x.n) for x in out.collect()]
        assert len(got) == len(dict(got)) and dict(got) == count(given)
        assert ("Aggregate" in out._jdf.queryExecution().optimizedPlan().toString()) == (given is not rows)


def test_coverage_is_few_shuffles_and_equals_naive(spark, monkeypatch):
    monkeypatch.setattr(intervals, "WIDTH", 8)
    r = random.Random(9)
    span = lambda: (lambda s: (s, s + r.randrange(0, 25)))(r.randrange(-40, 60))
    parts = [(r.choice([1, 2, None]), r.choice(["a", "b", None]), *span()) for _ in range(150)]
    hits = [(r.choice([1, 2, None, 3]), *span()) for _ in range(12)]
    out = intervals.coverage(spark.createDataFrame(parts, "k int, kind string, start int, end int"), spark.createDataFrame(hits, "k int, start int, end int"), ["k"], "kind")
    at = lambda rows: {x for s, e in rows for x in range(s, e)}
    want = {(k, c): len(at((s, e) for a, b, s, e in parts if (a, b) == (k, c)) & at((s, e) for a, s, e in hits if a == k)) for k, c, *_ in parts}
    assert {(x.k, x.kind): x.covered for x in out.collect()} == {k: n for k, n in want.items() if n}
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") <= 3
