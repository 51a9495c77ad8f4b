"""Operators against naive versions on small rows."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from cladeflow.functions import columns as fn
from cladeflow.operators import annotation, intervals, kmers, metrics, models, relational, tree
from cladeflow.plans import registry
from cladeflow.sources import readers, writers
from cladeflow.streaming import scores

NODES = "id long, idpar long, rank string, name string"


@pytest.fixture(scope="module")
def chain(spark):
    rows = [(1, 0, "root", "root")] + [(i, i - 1, "species" if i == 64 else None, f"n{i}") for i in range(2, 65)]
    return spark.createDataFrame(rows, NODES)


@pytest.fixture(scope="module")
def bushy(spark):
    r = random.Random(6)
    rows = [(1, 0, "root", "root")]
    for i in range(2, 120):
        rows.append((i, r.choice(rows)[0], r.choice(["species", "genus", "family", None]), f"n{i}"))
    return rows, spark.createDataFrame(rows, NODES)


def ancestors(rows):
    parent = {i: p for i, p, *_ in rows}
    out = {}
    for i in parent:
        up, x = [], i
        while x in parent:
            up.append(x)
            x = parent[x]
        out[i] = up
    return out


def test_closure_of_chain_and_bush(chain, bushy):
    assert tree.closure(chain).count() == 64 * 65 // 2
    rows, df = bushy
    got = {(r.id, r.anc_id, r.dist) for r in tree.closure(df).collect()}
    assert got == {(i, a, d) for i, up in ancestors(rows).items() for d, a in enumerate(up)}


def test_nested_sets_are_a_preorder(bushy):
    rows, df = bushy
    got = {r.id: r for r in tree.nested_sets(df, tree.closure(df)).collect()}
    kids = {}
    for i, p, *_ in rows:
        kids.setdefault(p, []).append(i)
    n, want = 0, {}

    def walk(i):
        nonlocal n
        n += 1
        left = n
        for k in sorted(kids.get(i, [])):
            walk(k)
        n += 1
        want[i] = (left, n)

    walk(1)
    assert {i: (r.lnest, r.rnest) for i, r in got.items()} == want


def test_lowest_common_and_reattached(spark, bushy):
    rows, df = bushy
    up, pairs = ancestors(rows), tree.closure(df)
    couples = [(a, b) for a, b in itertools.product(range(2, 30), range(90, 100))]
    got = tree.lowest_common(pairs, spark.createDataFrame(couples, "a long, b long"), "a", "b").collect()
    assert len(got) == len(couples)
    assert all(r.lcs == next(x for x in up[r.a] if x in up[r.b]) for r in got)
    rank = {i: k for i, _, k, _ in rows}
    kept = {r.id: r.idpar for r in tree.reattached(df, pairs, F.col("rank").isNotNull()).collect()}
    assert kept == {i: next((x for x in up[i][1:] if rank[x]), 0) for i in up if rank[i]}


def test_orphans_fail_and_single_node(spark):
    with pytest.raises(ValueError):
        tree.require_parents(spark.createDataFrame([(1, 0, None, ""), (3, 2, None, "")], NODES))
    one = spark.createDataFrame([(1, 0, "root", "r")], NODES)
    assert [tuple(r) for r in tree.closure(one).collect()] == [(1, 1, 0)]


def test_lineage_fill(spark):
    wide = spark.createDataFrame([(1, None, 5, None, 9), (2, 7, None, None, 9), (3, None, None, None, 9)], "id int, species int, genus int, family int, root int")
    ranks = ["species", "genus", "family", "root"]
    rows = lambda how: [tuple(r)[1:] for r in tree.fill_lineage(wide, ranks, how).orderBy("id").collect()]
    assert rows("up") == [(None, 5, 5, 9), (7, 7, 7, 9), (None, None, None, 9)]
    assert rows("up-down") == [(5, 5, 5, 9), (7, 7, 7, 9), (9, 9, 9, 9)]


def test_conditional_reduction(spark):
    rows = [(1, 0, "a", ""), (2, 1, "a", ""), (3, 1, None, ""), (4, 3, "a", ""), (5, 2, "a", "")]
    df = spark.createDataFrame(rows, NODES).withColumn("x", F.col("id"))
    got = {r.id: r.result for r in tree.reduce_up(df, tree.closure(df), "x", F.sum("x"), F.col("rank").isNotNull()).collect()}
    assert got == {5: 5, 4: 4, 2: 7, 3: 7, 1: 8}


def naive_kmers(s, k):
    return [s[i : i + k] for i in range(len(s) - k + 1) if set(s[i : i + k]) <= set("ACGT")]


@pytest.mark.parametrize("step", [100_000, 7])
def test_kmers_equal_naive(spark, monkeypatch, step):
    r = random.Random(2)
    seqs = [(i, "".join(r.choices("ACGTNa", [9, 9, 9, 9, 1, 1], k=r.randrange(0, 60)))) for i in range(30)] + [(99, "ACGT"), (100, "acgt"), (101, "A")]
    whole = kmers.windows
    monkeypatch.setattr(kmers, "windows", lambda d, i, s, k: whole(d, i, s, k, step))
    got = {(x.id, x.kmer): x.n for x in kmers.kmer_counts(spark.createDataFrame(seqs, "id int, seq string"), "id", "seq", 3).collect()}
    want = {}
    for i, s in seqs:
        for w in naive_kmers(s, 3):
            want[i, w] = want.get((i, w), 0) + 1
    assert got == want


def test_palindromes_merge_and_ladder(spark):
    df = spark.createDataFrame([(1, "ATGCAAAA"), (2, "AAAA")], "id int, seq string")
    merged = {(r.id, r.kmer): r.n for r in kmers.kmer_counts(df, "id", "seq", 2, merge=True).collect()}
    assert merged[1, "AT"] == 1 and merged[1, "GC"] == 1 and merged[1, "CA"] == 2
    row = kmers.ladder(df, "id", "seq", 2).filter("id = 2 AND kmer = 'AA'").first()
    assert (row.n, row.expected) == (3, 4.0)


def test_shredding_bounds(spark):
    df = spark.createDataFrame([(1, "A" * 10), (2, "A" * 9), (3, "ACGTACGTACGTACGTACGT")], "id int, seq string")
    got = sorted((r.old_id, r.start, r.end, r.frag) for r in kmers.shred(df, "id", "seq", 10, -5).collect())
    assert got == [(1, 0, 10, "A" * 10), (3, 0, 10, "ACGTACGTAC"), (3, 5, 15, "CGTACGTACG"), (3, 10, 20, "GTACGTACGT")]


def test_balance_and_folds(spark):
    df = spark.createDataFrame([(i, i % 3 if i % 7 else 3) for i in range(200)], "id int, label int")
    n = lambda d: {r.label: r["count"] for r in d.groupBy("label").count().collect()}
    full = n(df)
    assert n(kmers.balance(df, "label", "id", 5, 1)) == dict.fromkeys(full, 5)
    assert n(kmers.balance(df, "label", "id", -1, 1)) == full
    assert n(kmers.balance(df, "label", "id", 0, 1)) == {}
    assert set(n(kmers.balance(df, "label", "id", "min", 1)).values()) == {min(full.values())}
    assert n(kmers.balance(df, "label", "id", 4, 1, {3: -1}))[3] == full[3]
    folds = [r["count"] for r in models.folds(df, "id", 6, 3).groupBy("fold").count().collect()]
    assert len(folds) == 6 and max(folds) - min(folds) <= 1


def test_allocation_is_whole_and_even(bushy):
    rows, df = bushy
    pairs = tree.closure(df)
    got = {r.id: r.amount for r in models.allocate_down(df, tree.depths(pairs), 1, 1000, 5).collect()}
    kids = {}
    for i, p, *_ in rows:
        kids.setdefault(p, []).append(i)
    for i, k in kids.items():
        if i:
            assert sum(got[x] for x in k) == got[i] and max(got[x] for x in k) - min(got[x] for x in k) <= 1


def test_fragments_are_shared_by_length(spark):
    rows = [("a", i, "ACGTA" * n) for i, n in enumerate([2000, 400, 400, 20, 20, 19, 3])] + [("b", 50, "A" * 250), ("b", 51, "C" * 99), (None, 60, "G" * 100)]
    seqs = spark.createDataFrame(rows, "g string, id long, seq string")
    cap = 50
    got = kmers.capped_fragments(seqs, "g", "id", "seq", 100, cap, 3).collect()
    of = {i: sorted(r.start for r in got if r.old_id == i) for _, i, _ in rows}
    total = sum(len(s) for g, _, s in rows if g == "a")
    for g, i, s in rows:
        assert len(set(of[i])) == len(of[i]) and all(x % 100 == 0 and x + 100 <= len(s) for x in of[i])
        if g == "a":
            assert len(of[i]) in {min(n, len(s) // 100) for n in (int(len(s) * cap / total), int(len(s) * cap / total) + 1)}
    assert of[0] and len(of[0]) > 2 * len(of[1])
    assert (of[50], of[51], of[60]) == ([0, 100], [], [0])
    assert all(r.frag == dict((i, s) for _, i, s in rows)[r.old_id][r.start : r.end] for r in got)
    again = kmers.capped_fragments(seqs.repartition(3), "g", "id", "seq", 100, cap, 3).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in again} and len(got) == len(again)


def test_chunks_of_one_group_take_several_tasks(spark):
    r = random.Random(5)
    rows = [("a" if i % 50 else None, i, r.randrange(0, 90)) for i in range(6000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = kmers.chunk_index(spark.createDataFrame(rows, "g string, id long, n long").repartition(3), "g", "id", "n", 100)
        got = out.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = []
    for g in ("a", None):
        at = 0
        for _, i, n in (x for x in rows if x[0] == g):
            want += [(g, c, i, c * 100 - at) for c in range(-(-at // 100), -(-(at + n) // 100))]
            at += n
    assert sorted((tuple(x)[:4] for x in got), key=str) == sorted(want, key=str)
    assert len({x.task for x in got if x.g == "a"}) > 1


def test_host_candidates_of_virus_names(spark):
    want = {
        "Vibriophage VP16": [(1, "vibrio"), (1, "vibriobacter"), (1, "vibriobacterium"), (1, "vibriobacteria")],
        "Uncultured cyanophage": [(1, "cyanobacteria")],
        "Marine Cyanophage S-1": [(2, "marine cyanobacteria"), (1, "marine")],
        "x mosaicvirus": [(1, "x")],
        "Blackberry cv. Apache virus": [(3, "blackberry cv. apache"), (2, "blackberry cv."), (1, "blackberry")],
        "Yersinia hybrid bacteriophage 3": [(2, "yersinia hybrid"), (1, "yersinia")],
        "Red Roseophage virus": [(2, "red roseo"), (2, "red roseobacter"), (2, "red roseobacterium"), (2, "red roseobacteria"), (1, "red")],
        "hybrid": [],
        "phage T4": [],
        "": [],
        None: [],
        "uncultured uncultured Thing": [(2, "uncultured thing"), (1, "uncultured")],
    }
    out = models.host_candidates(spark.createDataFrame([(n,) for n in want], "name string"), "name", ["uncultured", "unclassified", "unidentified", "hybrid"])
    got = {n: [] for n in want}
    for r in out.collect():
        got[r.name].append((r.words, r.host))
    assert got == want


def test_annotations_resolve_by_the_first_step(spark):
    rows = [(1, 0, "root"), (2, 1, "Bacteria"), (3, 2, "Escherichia"), (4, 3, "Escherichia coli"), (5, 2, "Actinobacteria"), (6, 5, "Actinobacteria"), (7, 6, "Twin"), (8, 3, "Twin")]
    nodes = spark.createDataFrame(rows, "id long, idpar long, name string")
    records = [
        (1, 4, "Twin", ["Bacteria"], 4, "taxid"),
        (2, 99, " escherichia COLI K-12 ", ["Bacteria"], 4, "name"),
        (3, None, "Escherichia coli", None, 4, "name"),
        (4, None, "Nothing known", ["Bacteria", "Escherichia", "Lost"], 3, "lineage"),
        (5, 99, "Twin", ["Bacteria", "Actinobacteria", "Twin"], 2, "lineage"),
        (6, 99, "Twin strain 3", ["Lost", "Actinobacteria", "Twin"], 2, "common"),
        (7, 99, None, ["Actinobacteria", "Lost"], 5, "common"),
        (8, 99, "Twin", [], None, None),
        (9, None, "", None, None, None),
        (10, None, None, ["root", None, "Escherichia"], 3, "lineage"),
    ]
    df = spark.createDataFrame([r[:4] for r in records], "k long, taxid long, name string, lineage array<string>")
    got = annotation.resolved(df, nodes, tree.closure(nodes), nodes, "k").collect()
    assert sorted(map(tuple, got)) == [(r[0], *r[4:]) for r in records if r[4]]


def test_interval_union_and_coverage(spark):
    spans = [(1, 0, 5), (1, 5, 9), (1, 2, 3), (1, 2, 3), (1, 20, 30), (2, 1, 1), (2, 4, 6)]
    df = spark.createDataFrame(spans, "k int, start int, end int")
    assert sorted(tuple(r) for r in intervals.merged(df, ["k"]).collect()) == [(1, 0, 9), (1, 20, 30), (2, 4, 6)]
    parts = spark.createDataFrame([(1, 8, 22, "a"), (1, 25, 40, "b"), (3, 0, 5, "a")], "k int, start int, end int, kind string")
    assert sorted(tuple(r) for r in intervals.coverage(parts, df, ["k"], "kind").collect()) == [(1, "a", 3), (1, "b", 5)]
    assert intervals.merged(df.limit(0), ["k"]).count() == 0


def test_runs(spark):
    for bits in ["", "0", "1", "10", "01", "110", "0110", "1011", "11111"]:
        df = spark.createDataFrame([(1, i, b == "1") for i, b in enumerate(bits)], "k int, i int, f boolean")
        got = sorted((r.start, r.end) for r in relational.runs_of_true(df, ["k"], "i", F.col("f")).collect())
        want = []
        for on, g in itertools.groupby(enumerate(bits), key=lambda x: x[1]):
            g = list(g)
            if on == "1":
                want.append((g[0][0], g[-1][0]))
        assert got == want


def test_metrics_of_odd_classes(spark):
    rows = [(1, 1), (1, 1), (1, 0), (2, 1), (3, 4), (2, -1)]
    conf = metrics.confusion(spark.createDataFrame(rows, "test int, pred int"), [], "test", "pred")
    w = metrics.weighted(conf, metrics.class_weights(conf, [], "test"), [], "test")
    sens = {r.test: r.sens for r in metrics.sensitivity(w, [], "test", "pred").collect()}
    assert sens == {1: pytest.approx(2 / 3), 2: 0, 3: 0}
    spec = {r.pred: r.spec for r in metrics.specificity(w, [], "test", "pred").collect()}
    assert spec == {1: pytest.approx(2 / 3.5)}  # 4 has no test rows; 0 and -1 have no precision


def test_joins_with_nulls_and_empty_sides(spark):
    a = spark.createDataFrame([(1, 5.0), (None, 2.0), (2, 3.0)], "k int, n double")
    assert relational.drop_listed(a, spark.createDataFrame([(1,), (None,)], "k int"), "k").count() == 2
    assert relational.outweighing(a, a.limit(0), "k", "n", 2).count() == 3
    with pytest.raises(ValueError):
        relational.must_match(a, a.filter("k = 1"), "k")
    with pytest.raises(ValueError):
        relational.require_unique(a.union(a), ["k"])


def test_rejects_by_each_rule(spark):
    best = spark.createDataFrame([(1, 7, 0.9, -0.1), (2, 8, 0.5, 0.4), (3, 9, -0.2, -0.3), (4, 6, 0.3, None)], "id int, label int, top double, second double")
    labels = lambda rule, t=0.0: [r.pred for r in models.with_rejects(best, "label", rule, t).orderBy("id").collect()]
    assert labels("value", 0.4) == [7, 8, 0, 0]
    assert labels("alone") == [7, 0, 0, 0]
    assert labels("margin", 0.2) == [7, 0, 0, 6]
    assert labels("relative", 0.6) == [7, 0, 0, 6]


def test_files_round_trip(spark, tmp_path):
    p = str(tmp_path / "a.fa")
    with open(p, "w") as f:
        f.write(">gi|5|ref one two\nACGT\nNNNN\n\n>b\n>c  x\nAC\r\nGT\n")
    got = [tuple(r) for r in readers.read_fasta(spark, p).collect()]
    assert got == [("gi|5|ref", "gi|5|ref one two", "ACGTNNNN"), ("b", "b", ""), ("c", "c  x", "ACGT")]
    with open(p, "w") as f:
        f.write("a\tb\n1\tx\n2\ty\n")
    t = readers.read_table(spark, p, overrides={"a": ("n", "int")}, where="n > 1")
    assert [tuple(r) for r in t.collect()] == [(2, "y")]
    assert readers.read_table(spark, p, header=False).columns == ["fld_0", "fld_1"]
    assert readers.read_table(spark, p, where="a = 'none'").count() == 0
    with pytest.raises(ValueError):
        readers.read_table(spark, p, overrides={"zz": ("n", "int")})
    with open(p, "w") as f:
        f.write("Accno\tStatus\tc1\nr1 Assembled c5 x y c6\nr2 Single\nr3 Assembled c7\n")
    assert [tuple(r) for r in readers.read_status(spark, p).collect()] == [("r1", "c5", "c6"), ("r3", "c7", None)]


def test_annotation_records(spark, tmp_path):
    p = str(tmp_path / "a.json")
    with open(p, "w") as f:
        f.write('{"name": "q", "tree": "NO_TREE", "strict_consensus": {"phylum": "P", "phylum_outgroup": "0"}, "strict_taxon_id": "12", "bootstrap": "0.5"}\n')
    r = readers.read_annotations(spark, p, ["phylum"]).first()
    assert (r.tree, r.strict_phylum, r.strict_taxon_id, r.bootstrap, r.relaxed_phylum) == (None, "P", 12, 0.5, None)


def test_streams_equal_tables(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    at = str(tmp_path / "in")
    events.orderBy(F.desc("event_id")).repartition(5).write.parquet(at)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(at)
    got = scores.drained(scores.best_so_far(stream, "user_id", "event_type", "value", "event_id"), str(tmp_path / "o"), str(tmp_path / "c"))
    want = scores.best_so_far(events, "user_id", "event_type", "value", "event_id")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_confidence_and_scalars(spark):
    df = spark.createDataFrame([(1, 0.37, "AC-N")], "id int, x double, s string")
    r = df.select(fn.reverse_complement(F.col("s")).alias("rc"), fn.percent(F.col("x")).alias("p"), fn.bits(F.col("id")).alias("b"), fn.confidence(F.lit("Reviewed")).alias("c"), fn.hash01("id", 3).alias("h")).first()
    assert (r.rc, r.p, r.b, r.c) == ("N-GT", "37.00%", "00000001", 1.0) and 0 <= r.h < 1


def test_every_sql_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_comment_report(spark, tmp_path):
    p = str(tmp_path / "r")
    writers.write_report(spark.createDataFrame([(1, None)], "a int, b string"), p, comment="hi")
    assert sorted(r.value for r in spark.read.text(p).collect()) == ["#hi", "1\t", "a\tb"]
