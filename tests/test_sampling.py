"""Samples, splits and benchmark pairs along a tree against naive recursion."""

import hashlib
import math
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from cladeflow.operators import metrics, sampling, tree

NODES = "id long, idpar long, rank string, name string"
RANKS = ["species", "genus", "family", "order", "class", "phylum"]
LEVELS = {r: 20 + 10 * i for i, r in enumerate(RANKS)} | {"root": 100}


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def made_tree(seed, n=150):
    """Six ranks, some left out on the way down, and nodes without a rank."""
    r = random.Random(seed)
    rows, rank = [(1, 0, "root", "root")], {1: len(RANKS)}
    for i in range(2, n):
        up = r.choice([x for x in rank if rank[x] > 0])
        at = rank[up] - r.choice([1, 1, 1, 2]) if r.random() < 0.9 else rank[up]
        rank[i] = max(at, 0)
        rows.append((i, up, RANKS[rank[i]] if rank[i] < rank[up] and rank[up] else None, f"n{i}"))
    return rows


def kids_of(rows):
    kids = {i: [] for i, *_ in rows}
    for i, p, *_ in rows:
        if p:
            kids[p].append(i)
    return kids


@pytest.mark.parametrize("cap", [3, 100])
def test_representatives_equal_recursion(spark, cap):
    rows = made_tree(3)
    kids = kids_of(rows)
    r = random.Random(4)
    own, n = {}, 0
    for i, *_ in rows:
        if (not kids[i] and r.random() < 0.7) or r.random() < 0.15:
            own[i] = list(range(n, n + r.choice([1, 2, 5, 9])))
            n += len(own[i])
    want = set()

    def walk(i):
        lists = [(c, walk(c)) for c in kids[i]]
        if not kids[i]:
            picked, status = [(i, x) for x in own.get(i, [])], "direct"
        else:
            lists = [(c, x) for c, x in [*lists, (i, own.get(i, []))] if x]
            if not lists:
                return []
            many = min(cap, int(median(len(x) for _, x in lists)))
            first = lambda x: sorted(x, key=lambda v: (md5(f"{v}-{i}:7"), v))[:many]
            picked = [(c, v) for c, x in lists for v in first(x)]
            status = "direct" if i in own else "indirect" if len(lists) >= 2 else None
        want.update((i, c, v, status) for c, v in picked)
        return [v for _, v in picked]

    walk(1)
    nodes = spark.createDataFrame(rows, NODES)
    items = spark.createDataFrame([(i, v) for i, x in own.items() for v in x], "id long, item long")
    got = {tuple(x) for x in sampling.representatives_up(nodes, tree.depths(tree.closure(nodes)), items, 7, cap).collect()}
    assert got == want
    assert {s for *_, s in got} == {"direct", "indirect", None}


def true_split(rows, counts, term, loose, min_train, min_test, ratio, seed):
    kids, parent = kids_of(rows), {i: p for i, p, *_ in rows}
    total, lost, s = {}, {}, {}

    def sums(i):
        total[i] = counts.get(i, 0) + sum(sums(c) for c in kids[i])
        return total[i]

    def below(i):
        yield i
        for c in kids[i]:
            yield from below(c)

    sums(1)
    for i, p, *_ in rows:
        lost[i] = i in loose or (p != 0 and lost[p])
        s[i] = {"test": 0, "train": 0 if lost[i] else total[i], "is": False, "has": False, "term": False}

    def choose(c):
        for x in below(c):
            s[x].update(test=total[x], train=0, has=False)
            s[x]["is"] = True

    def act(i):
        if lost[i] or not total[i]:
            return
        here = [c for c in kids[i] if c not in loose and total[c]]
        for c in here:
            if c in term:
                s[c].update(term=True, test=0, train=total[c])
            else:
                act(c)
                if s[c]["test"] == 0 and s[c]["train"] < min_train:
                    s[c]["term"] = True
        test, train = sum(s[c]["test"] for c in here), sum(s[c]["train"] for c in here)
        held = total[i] - sum(total[c] for c in kids[i] if c in loose)
        left = max(min(math.floor(held * ratio + 0.5), held - min_train), min_test) - test
        terms = sorted((c for c in here if s[c]["term"]), key=lambda c: (md5(f"{c}:{seed}"), c))
        if left > 0:
            for c in terms:
                if total[c] <= left and train - total[c] >= min_train:
                    left, test, train = left - total[c], test + total[c], train - total[c]
                    choose(c)
            rest = sorted((c for c in terms if not s[c]["is"]), key=lambda c: total[c])
            if test < min_test and rest and test + total[rest[0]] >= min_test and train - total[rest[0]] >= min_train:
                test, train = test + total[rest[0]], train - total[rest[0]]
                choose(rest[0])
        s[i].update(test=test, train=train, has=test >= min_test)
        if test == 0:
            for x in below(i):
                s[x]["train"] = total[x]

    act(1)
    s[1]["term"] = False
    for i in [x for x in below(1)][1:]:
        p = parent[i]
        if s[i]["test"] == 0 and (not lost[i] or (s[p]["test"] == 0 and s[p]["train"] != 0)):
            s[i]["train"] = total[i]
        if s[p]["term"]:
            s[i]["term"] = True
    return {(i, total[i], x["test"], x["train"], x["is"], x["has"], x["term"]) for i, x in s.items()}


@pytest.mark.parametrize("seed", [1, 2, 5])
def test_split_equals_recursion(spark, seed):
    rows = made_tree(seed, 220)
    kids = kids_of(rows)
    r = random.Random(seed)
    term = {i for i, _, rank, _ in rows if rank == "species" or (not kids[i] and i > 1)}
    counts = {i: r.choice([1, 3, 8, 30]) for i in term if r.random() < 0.8}
    loose = {i for i, *_ in rows if i > 1 and r.random() < 0.06}
    want = true_split(rows, counts, term, loose, 12, 6, 0.25, 9)
    nodes = spark.createDataFrame([(*x, x[0] in term, x[0] in loose) for x in rows], NODES + ", term boolean, loose boolean")
    n = spark.createDataFrame(list(counts.items()), "id long, n long")
    pairs = tree.closure(nodes)
    got = [tuple(x) for x in sampling.test_split(nodes, pairs, n, F.col("term"), F.col("loose"), F.lit(12), F.lit(6), F.lit(0.25), 9).collect()]
    assert set(got) == want and len(got) == len(rows)
    assert any(x[4] for x in got) and any(x[5] for x in got)
    none = nodes.limit(0)
    assert sampling.test_split(none, tree.closure(none), n, F.col("term"), F.col("loose"), F.lit(1), F.lit(1), F.lit(0.5), 9).count() == 0


def true_pairs(rows, scores, truth, models):
    parent, rank = {i: p for i, p, *_ in rows}, {i: r for i, _, r, _ in rows}

    def up(i):
        while i:
            yield i
            i = parent[i]

    usable = {m: n for m, n, leaf in models if leaf}
    placed = set(usable.values())
    held = {i: sum(i in set(up(p)) for p in placed) for i in parent}
    fixed = {i: {LEVELS[rank[a]]: a for a in reversed(list(up(i))) if rank[a] in LEVELS} for i in parent}
    out = set()
    for s, t in truth:
        if t not in placed:
            continue
        order = sorted((-x, m) for q, m, x in scores if q == s and m in usable)
        lineage, levels = set(up(t)), sorted(fixed[t])
        for lev in [0, *[x for x in levels if x < 100]]:
            zone = fixed[t].get(lev)
            won = next(((m, -x) for x, m in order if lev == 0 or (usable[m] not in lineage and zone not in set(up(usable[m])))), None)
            above = [x for x in levels if x > lev]
            n = held[t] if lev == 0 else held[fixed[t][above[0]]] - held[zone] if above else 0
            if won is None or n < 1:
                continue
            best = usable[won[0]]
            told = [(x, fixed[t][x], fixed[best].get(x, -1)) for x in above] + ([(0, t, best)] if lev == 0 else [])
            out |= {(s, lev, *x, t, best, *won, n) for x in told}
    return out


def test_benchmark_pairs_equal_a_plain_search(spark):
    rows = made_tree(8, 120)
    r = random.Random(8)
    ids = [i for i, *_ in rows]
    models = [(m, r.choice(ids), r.random() < 0.8) for m in range(60)]
    truth = [(s, r.choice([n for _, n, _ in models] + ids)) for s in range(40)]
    scores = [(s, m, float(r.randrange(30))) for s in range(40) for m in range(60) if r.random() < 0.7]
    nodes = spark.createDataFrame(rows, NODES)
    frame = lambda x, schema: spark.createDataFrame(x, schema)
    got = metrics.benchmark_pairs(frame(scores, "sample long, model long, score double"), frame(truth, "sample long, node long"), frame(models, "model long, node long, leaf boolean"), nodes, tree.closure(nodes), LEVELS).collect()
    want = true_pairs(rows, scores, truth, models)
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert len({x[1] for x in want}) >= 5 and any(x[4] == -1 for x in want)
