"""Neighbours, names, phrases, reductions by functions, streams and files against plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeflow.operators import annotation, common, kmers, neighbours, relational, tree
from cladeflow.sources import readers, writers
from cladeflow.streaming import scores


def near_of(ids, x, q, k, most=None):
    out = set()
    for i in q:
        d = np.sqrt(((x - x[ids.index(i)]) ** 2).sum(axis=1))
        best = sorted((float(v), j) for v, j in zip(d, ids, strict=True) if j != i)[:k]
        out |= {(i, j, round(v, 9)) for v, j in best if most is None or v <= most}
    return out


@pytest.mark.parametrize(("points", "queries"), [(16_384, 2048), (13, 3)])
def test_neighbours_equal_brute_force_and_leave_most_unvisited(spark, monkeypatch, points, queries):
    monkeypatch.setattr(neighbours, "POINTS", points)
    monkeypatch.setattr(neighbours, "QUERIES", queries)
    r = np.random.default_rng(1)
    centres = r.normal(size=(30, 6)) * 40
    x = np.concatenate([centres[k % 30] + r.normal(size=(1, 6)) for k in range(600)] + [np.zeros((3, 6))])
    ids = list(range(len(x)))
    rows = [(i, [float(v) for v in x[i]], i % 5, "clash") for i in ids] + [(9000, None, 1, ""), (9001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, "")]
    df = spark.createDataFrame(rows, "id long, v array<double>, l int, cell string")
    q = df.filter("id % 4 = 0")
    asked = [i for i in ids if i % 4 == 0]
    counter = spark.sparkContext.accumulator(0)
    got = {(a.id_q, a.id_p, round(a.dist, 9)) for a in neighbours.nearest_points(q, df, 5, "id", "v", "l", counter=counter).collect()}
    assert got == near_of(ids, x, asked, 5)
    assert counter.value < 0.2 * len(asked) * len(ids)
    got = {(a.id_q, a.id_p, round(a.dist, 9)) for a in neighbours.nearest_points(q, df, 5, "id", "v", "l", most=2.0).collect()}
    assert got == near_of(ids, x, asked, 5, 2.0)
    votes = {a.id_q: (a.label, a.votes) for a in relational.nearest_neighbours(q, df, 5, "id", "v", "l").collect()}
    assert votes[9000] == (0, 0) and set(asked) <= set(votes)
    assert relational.nearest_neighbours(q, df.limit(0), 5, "id", "v", "l").filter("label <> 0").count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_names_within_few_edits(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choices("abc ", k=r.choice([1, 3, 6, 9]))).strip() or "a"
    names = [(i, word().title()) for i in range(80)]
    asked = [(w,) for w in {word() for _ in range(40)} | {"", "zzzz"}]
    for most in (1, 2):
        got = {tuple(x) for x in tree.close_names(spark.createDataFrame(names, "id long, name string"), spark.createDataFrame(asked, "q string"), "name", "q", most).collect()}
        assert got == {(q, i, edits(n.lower(), q)) for i, n in names for (q,) in asked if edits(n.lower(), q) <= most}


def test_misspelt_hosts(spark):
    nodes = spark.createDataFrame([(1, 0, None, "root"), (2, 1, None, "Escherichia"), (3, 2, None, "Escherichia coli"), (4, 1, None, "Bacillus"), (5, 1, None, "viruses"), (6, 5, None, "Bacilus")], "id long, idpar long, rank string, name string")
    asked = [("exact", "escherichia coli"), ("off", "Eschericia coli"), ("two", "Bacilas"), ("words", "Escherichia coli K12 strain"), ("none", "Homo sapiens"), ("both", "Escherichia")]
    pairs = tree.closure(nodes)
    got = {(x.v, x.id) for x in annotation.near_hosts(spark.createDataFrame(asked, "v string, host string"), nodes.select("id", "name"), pairs, nodes.filter("id = 5"), "v", "host").collect()}
    assert got == {("exact", 3), ("off", 3), ("two", 4), ("words", 3), ("both", 2)}


def test_phrases_keep_their_order(spark):
    texts = [(1, "The complete GENOME of x"), (2, "genome complete"), (3, "complete plasmid, complete genome!"), (4, None), (5, ""), (6, "complete\nchromosome; ribosomal RNA"), (7, "complete complete genome"), (8, "a b a b c")]
    df = spark.createDataFrame([(*x, "clash") for x in texts], "id long, text string, word string")
    phrases = {"g": "complete genome", "c": "complete chromosome", "r": "ribosomal rna", "p": "plasmid", "abc": "a b c", "cab": "c a"}
    got = {tuple(x) for x in relational.phrase_matches(df, "id", "text", phrases).collect()}
    words = {i: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " " for i, t in texts}
    assert got == {(k, i) for k, p in phrases.items() for i, t in words.items() if f" {p} " in t}
    rules = {"whole": {"any": ["complete genome", "complete chromosome"], "none": ["plasmid", "ribosomal rna"]}, "all": {"all": ["complete", "plasmid"]}}
    assert {tuple(x) for x in relational.boolean_matches(df, "id", "text", rules).collect()} == {("whole", 1), ("whole", 7), ("all", 3)}
    with pytest.raises(ValueError, match="no phrase"):
        relational.boolean_matches(df, "id", "text", {"x": {"none": ["a"]}})


def test_reduction_by_a_function_that_needs_order(spark):
    r = random.Random(3)
    rows = [(1, 0, None, "root", 1)]
    for i in range(2, 80):
        rows.append((i, r.choice(rows)[0], None, f"n{i}", r.randrange(100)))
    kids = {i: sorted(j for j, p, *_ in rows if p == i) for i, *_ in rows}
    own = {i: v for i, *_, v in rows}
    f = lambda own, kids: f"({own}" + "".join(f"-{r}" for _, r in kids) + ")"
    true = lambda i, ok: f(own[i], [(c, true(c, ok)) for c in kids[i] if ok(i, c)])
    nodes = spark.createDataFrame(rows, "id long, idpar long, rank string, name string, x int")
    pairs = tree.closure(nodes)
    assert {x.id: x.result for x in tree.reduce_up_by(nodes, pairs, "x", f, "string").collect()} == {i: true(i, lambda i, c: True) for i in own}
    edges = spark.createDataFrame([(p, i) for i, p, *_ in rows if p and i % 3], "id long, child long")
    assert {x.id: x.result for x in tree.reduce_up_by(nodes, pairs, "x", f, "string", edges).collect()} == {i: true(i, lambda i, c: c % 3) for i in own}


def test_upserts_across_a_restart(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, r.randrange(12), f"m{r.randrange(4)}", float(r.randrange(50))) for i in range(250)]
    schema, at = "event_id long, user_id int, kind string, value double", str(tmp_path / "in")
    ran = 0
    for k in range(5):  # each call is a new query that goes on from the checkpoint
        spark.createDataFrame(rows[50 * k : 50 * k + 50], schema).coalesce(1).write.mode("append").parquet(at)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at)
        for f, keys, name in [(scores.best_so_far(stream, "user_id", "kind", "value", "event_id"), ["user_id"], "best"), (scores.running_counts(stream, "kind", "value"), ["kind"], "counts")]:
            ran += scores.upserted(f, str(tmp_path / name), str(tmp_path / f"{name}-state"))
    assert ran >= 10
    table = spark.createDataFrame(rows, schema)
    for f, keys, name in [(scores.best_so_far(table, "user_id", "kind", "value", "event_id"), ["user_id"], "best"), (scores.running_counts(table, "kind", "value"), ["kind"], "counts")]:
        got = scores.latest(spark, str(tmp_path / name), keys, f.schema)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, f.collect()))
        scores.compacted(spark, str(tmp_path / name), str(tmp_path / f"{name}-small"), keys, f.schema)
        small = spark.read.parquet(str(tmp_path / f"{name}-small"))
        assert small.count() == small.select(*keys).distinct().count() == f.count()


def test_records_larger_than_a_block(spark, tmp_path):
    r = random.Random(8)
    records = [(f"s{k}", "".join(r.choices("ACGT", k=n))) for k, n in enumerate([30_000, 0, 1, 79, 80, 81, 9000])] + [("s0", "ACGT")]
    for name in ("a.fa", "b.fa"):
        with open(tmp_path / name, "w") as file:
            for h, s in records:
                file.write(f">{h} {name}\n" + "".join(s[i : i + 80] + "\n" for i in range(0, len(s), 80)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "4k")
    try:
        parts = readers.read_fasta_parts(spark, str(tmp_path / "*.fa"), 500)
        rows = parts.withColumn("task", F.spark_partition_id()).collect()
        tasks = readers.read_fasta_parts(spark, str(tmp_path / "*.fa"), 500)
        assert spark.read.text(str(tmp_path / "*.fa")).rdd.getNumPartitions() > 10 and tasks.count() == len(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    texts = {}
    for x in rows:
        texts.setdefault((x.file.rsplit("/", 1)[1], x.record, x.header), []).append((x.start, x.seq))
    got = []
    for (name, _, header), found in texts.items():
        at = 0
        for start, seq in sorted(found):
            assert start == at
            at += len(seq)
        got.append((name, header, "".join(s for _, s in sorted(found))))
    assert sorted(got) == sorted((n, f"{h} {n}", s) for n in ("a.fa", "b.fa") for h, s in records if s)
    assert len({(n, r) for n, r, _ in texts}) == len(texts)


def test_ranges_of_keys_that_repeat(spark):
    keys = spark.range(200_000).select((F.col("id") % 100).alias("k"))
    n = [x["n"] for x in keys.withColumn("b", common.range_bucket(keys, "k")).groupBy("b").agg(F.count("*").alias("n")).collect()]
    assert len(n) > 60 and max(n) < 10_000
    hot = spark.range(100_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    n = [x["n"] for x in hot.withColumn("b", common.range_bucket(hot, "k")).groupBy("b").agg(F.count("*").alias("n")).collect()]
    assert len(n) > 100 and sorted(n)[-2] < 3000


def test_reports_trees_and_contigs_as_files(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.5, "x"), ("a", 2.0, "y"), ("a", 0.25, "x")], "r string, v double, c string")
    wide = relational.pivot_report(df, "r", "c", F.sum("v"), ["y", "x"], "-", "%.1f")
    assert wide.columns == ["r", "y", "x"] and {tuple(x) for x in wide.collect()} == {("a", "2.0", "0.3"), ("b", "-", "1.5")}
    at = str(tmp_path / "report")
    writers.write_report(df.coalesce(1), at, comment="c", epilog="end")
    files = sorted((tmp_path / "report").glob("part-*.txt"))
    lines = "".join(f.read_text() for f in files).splitlines()
    assert lines[:2] == ["#c", "r\tv\tc"] and lines[-1] == "end" and len(lines) == 6
    writers.write_report(df, at, header=False, append=True, epilog="more")
    assert spark.read.text(at).count() == 10
    writers.write_gff(df, F.concat_ws("\t", "c", "v"), str(tmp_path / "gff"), "r")
    for k, n in (("a", 3), ("b", 2)):
        (one,) = (tmp_path / "gff" / f"r={k}").glob("part-*")
        assert one.read_text().splitlines()[0] == "##gff-version 3" and len(one.read_text().splitlines()) == n
    text = spark.createDataFrame([(1, "ACNNg-T"), (2, None), (3, "")], "id long, s string")
    (a, b, c) = sorted(kmers.replace_degenerate(text, "id", "s", 1).collect())
    assert re.fullmatch("AC[ACGT]{2}g[ACGT]T", a.s) and b.s is None and c.s == ""


def test_contig_files_are_whole_and_alone(spark, tmp_path):
    """On a file: path tasks write the files, so that a contig costs neither a checksum nor a process that sets permissions; unknown
    and empty names share a folder, and its file has one first line."""
    contigs = ["a", "b/c", "50%", "x=y", "q:r*[1]", "\u00e4 b", "", None]
    rows = [(c, f"l{i}" if i % 7 else None) for i in range(500) for c in contigs]
    df, at = spark.createDataFrame(rows, "contig string, v string").repartition(5), f"file:{tmp_path}/gff"
    for some in (df, df.filter("contig > 'a' OR contig IS NULL OR contig IN ('', 'a', '50%')")):  # the second takes the first's place
        writers.write_gff(some, F.col("v"), at, "contig")
    folders = list((tmp_path / "gff").glob("contig=*"))
    assert len(folders) == 7 and (tmp_path / "gff" / "_SUCCESS").exists()
    for folder in folders:
        (one,) = folder.iterdir()
        lines = one.read_text().split("\n")
        n = 1000 if "HIVE" in folder.name else 500
        assert lines[0] == "##gff-version 3" and lines[-1] == "" and len(lines) == n + 2 and lines.count("##gff-version 3") == 1
        assert sorted(lines[1:-1]) == sorted((f"l{i}" if i % 7 else "") for i in range(500) for _ in range(n // 500))
    back = {x.contig: x.n for x in spark.read.text(at).groupBy("contig").agg(F.count("*").alias("n")).collect()}
    assert back == {c: 501 for c in contigs if c} | {None: 1001}


def test_contig_files_of_a_failed_task_are_not_there(spark, tmp_path):
    at = f"file:{tmp_path}/gff"
    df = spark.range(60).selectExpr("'a' AS contig", "if(id < 59, 'x', raise_error('no line')) AS v")
    with pytest.raises(Exception, match="no line"):
        writers.write_gff(df, F.col("v"), at, "contig")
    assert not (tmp_path / "gff" / "_SUCCESS").exists() and not list((tmp_path / "gff").glob("contig=*/*"))


def test_phrases_lie_in_one_text_and_nothing_is_shuffled(spark):
    """Texts of one id are texts of their own, a row each, and a phrase without words is in none."""
    texts = [(1, "complete plasmid"), (1, "a genome"), (2, "Complete -- genome"), (2, "complete genome"), (None, "complete genome"), (3, None), (4, "!?"), (5, "UnÄhnlich, sehr")]
    df = spark.createDataFrame(texts, "id long, text string")
    found = relational.phrase_matches(df, "id", "text", {"g": "complete genome", "p": "plasmid", "u": "unähnlich", "n": "??", "e": ""})
    assert sorted(map(str, found.collect())) == sorted(f"Row(phrase='{p}', id={i})" for p, i in [("p", 1), ("g", 2), ("g", 2), ("g", None), ("u", 5)])
    rules = {"x": {"any": ["complete genome", "plasmid"], "none": ["a", "?"]}, "y": {"all": ["complete", "??"]}, "z": {"all": ["complete", "genome"], "any": ["plasmid", "genome"]}}
    held = relational.boolean_matches(df, "id", "text", rules)
    assert sorted(map(str, held.collect())) == sorted(f"Row(rule='{r}', id={i})" for r, i in [("x", 1), ("x", 2), ("x", 2), ("x", None), ("z", 2), ("z", 2), ("z", None)])
    assert not relational.phrase_matches(df, "id", "text", {}).collect() and not relational.boolean_matches(df, "id", "text", {}).collect()
    for out in (found, held):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
