"""Odd inputs, planted cases, and plain versions of what has no SQL."""

import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cladeflow.llm import language_id, licenses, minhash, mixing, queries, sharding, token_counts, topk, url_filter

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, source string, lang string"


def plain_grams(text):
    """Slots of the 1- to 3-grams of letters, all else being single blanks."""
    c = re.sub(" +", " ", " " + "".join(x if x.isalpha() else " " for x in text.lower()) + " ")
    out, wrap = set(), 2**64 - 1
    for n in (1, 2, 3):
        for at in range(len(c) - n + 1):
            x = 0
            for y in c[at : at + n]:
                x = (x << 21 | ord(y)) & wrap
            h = (x + n) * 0x9E3779B97F4A7C15 & wrap
            out.add(((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 & wrap) >> (64 - language_id.BITS))
    return out


def test_language_scores_equal_a_plain_kernel_ridge():
    r = random.Random(8)
    words = {"x": ["alpha", "beta", "gamma"], "y": ["über", "straße", "mögen"], "z": ["ñandú", "año", "niño"]}
    texts = [(k, " ".join(r.choices(words[k] + words["x"], k=6))) for k in words for _ in range(15)]
    r.shuffle(texts)
    labels = [k for k, _ in texts]
    presence = np.zeros((len(texts), language_id.SLOTS), dtype=bool)
    sets = [plain_grams(t) for _, t in texts]
    for k, (_, t) in enumerate(texts):
        assert language_id.grams(t, presence[k])
        assert set(np.flatnonzero(presence[k]).tolist()) == sets[k]
    model = language_id.fit(np.packbits(presence, axis=1), labels, landmarks=9, ridge=0.01)

    def kernel(a, b):
        return len(a & b) / (len(a) * len(b)) ** 0.5

    order = sorted((labels[:k].count(labels[k]), labels[k], k) for k in range(len(texts)))
    marks = [sets[k] for *_, k in order[:9]]
    inner = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(inner)
    keep = values > values.max() * 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = lambda some: np.hstack([np.array([[kernel(a, b) for b in marks] for a in some]) @ root, np.ones((len(some), 1))])
    z = features(sets)
    w = np.array([(1 / (3 * labels.count(k))) ** 0.5 for k in labels])[:, None]
    asked = ["alpha niño", "straße 12", "qqq", "año año " * 50]
    for j, name in enumerate(sorted(words)):
        y = np.array([1.0 if k == name else -1.0 for k in labels])[:, None]
        a = np.vstack([z * w, np.sqrt(0.01) * np.eye(z.shape[1])])
        solved = np.linalg.lstsq(a, np.vstack([y * w, np.zeros((z.shape[1], 1))]), rcond=None)[0]
        want = features([plain_grams(t) for t in asked]) @ solved
        assert model.scores(asked)[0][:, j] == pytest.approx(want[:, 0], abs=1e-5)


def test_languages_of_repeated_long_and_clashing_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs.filter(~language_id.held_out()))
    text = docs.filter("lang = 'fr'").orderBy(F.desc(F.length("text"))).first().text
    rows = [(1, text, 0.5, "mine"), (1, text, 0.5, "mine"), (2, text * 200, 0.5, "mine"), (None, text, 0.5, "mine"), (4, "...", 0.5, "mine")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, lang_pred string")
    got = language_id.identify(df, model).collect()
    assert sorted((r.doc_id or 0, r.lang_pred, r.lang_claimed) for r in got) == [(0, "fr", True), (1, "fr", True), (1, "fr", True), (2, "fr", True), (4, "und", False)]
    assert language_id.identify(df.limit(0), model).count() == 0


def test_clean_labelled_documents_pass_the_first_stage(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = corpus_pipeline.in_a_language(spark, docs, "")
    lost = docs.join(kept.select("doc_id"), "doc_id", "left_anti").filter("lang IS NOT NULL").collect()
    assert [r.text for r in lost if any(c.isalpha() for c in r.text or "")] == []


def sql_of_pages(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    return sorted(con.execute(f"SELECT page_id, host, path, rule, verdict, component FROM ({queries.oracle_sql()['op8_url_filter']})").fetchall(), key=str)


@pytest.mark.parametrize("few", [1000, 1])
def test_urls_equal_the_sql_with_relative_links(spark, monkeypatch, few):
    monkeypatch.setattr(url_filter, "FEW_RULES", few)
    to = lambda x: f"<link rel='canonical' href='{x}'>"
    rows = [
        (1, "http://a.org/x/y.html", to("z.html")),
        (2, "http://a.org/x/z.html", to("http://b.net/es/1")),
        (3, "http://c.org", to("q")),
        (4, "http://c.org/q", to("?p=1")),
        (5, "http://d.org/1", to("mailto:me@x")),
        (6, "http://d.org/2", to("#top")),
        (7, "http://e.com/es/", to("../up")),
        (8, "http://e.com/es/../up", None),
        (9, None, to("x")),
        (1, "http://a.org/x/y.html", to("z.html")),
        (None, "http://example.com/en/", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    got = url_filter.filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict", "component").collect()
    assert sorted((tuple(r) for r in got), key=str) == sql_of_pages(rows)


def test_shards_prune_files(spark):
    r = random.Random(3)
    rows = [(i, "w" * int(r.paretovariate(0.7) * 5), f"s{r.randrange(8)}", f"l{r.randrange(4)}") for i in range(4000)]
    docs = spark.createDataFrame(rows, DOCS)
    placed = docs.join(sharding.shard(docs).select("doc_id", "shard"), "doc_id").withColumn("other", F.pmod(F.xxhash64("doc_id"), F.lit(16)))
    reach = lambda by: placed.groupBy(by).agg(F.countDistinct("source").alias("s"), F.countDistinct("lang").alias("l")).agg(F.sum("s"), F.sum("l")).first()
    (s, n), (s0, n0) = reach("shard"), reach("other")
    assert s <= 0.5 * s0 and n <= 0.6 * n0  # a filter by source or language opens about half as many files


def test_topk_of_huge_components(spark):
    r = random.Random(5)
    rows = [(i, [float(r.randrange(-(2**24), 2**24)) for _ in range(3)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for x in topk.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.score, x.vec_id))
    whole = [(i, [int(y) * 64 for y in v]) for i, v in rows]
    for i, q in whole[::20]:
        best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in whole if j != i)[:20]
        assert got[i] == [(-s, j) for s, j in best]
    with pytest.raises(ValueError, match="64 bits"):
        topk.search(spark.createDataFrame([(1, [1e12])], "vec_id long, embedding array<double>"), F.lit(True))


def test_licences_counts_and_mixes_of_odd_rows(spark):
    long = "mot " * 300_000 + "x" * 200_000
    docs = spark.createDataFrame([(1, long, "a", None), (1, long, "a", None), (2, None, None, None), (None, "one two", "a", None)], DOCS)
    got = licenses.scan(docs).select("doc_id", "n_words", "license").collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in got) == [(0, 2), (1, 300_001), (1, 300_001), (2, 0)]
    counted = token_counts.count_tokens(docs, P.path("piece_bpe_32k.model")).select("doc_id", "n_tokens").collect()
    ones = [r.n_tokens for r in counted if r.doc_id == 1]
    assert ones[0] == ones[1] > 300_000 and len(counted) == 4
    mixed = mixing.mix(docs, F.array("source")).docs.collect()
    assert sorted(r["size"] for r in mixed) == [0, 2, 300_001, 300_001]
    none = docs.limit(0)
    assert licenses.scan(none).count() == token_counts.count_tokens(none, P.path("piece_bpe_32k.model")).count() == 0


def plain_components(rows):
    """Smallest id that links lead to, of (id, text) with distinct ids."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    of = {i: i for i, _ in rows}

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            of[y] = x
    return {i: top(i) for i in of}


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_copies_in_salted_parts(spark, monkeypatch, broadcast):
    monkeypatch.setattr(minhash, "BROADCAST_SETS", broadcast)
    r = random.Random(1)
    base = [[f"w{r.randrange(400)}" for _ in range(60)] for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(base[i % 12])
        if i % 3:
            w[r.randrange(60)] = "other"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(docs).collect()}
    assert got == plain_components(rows)
    # one id with several texts links what each of them is like, and repeats count once
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "g h i j k l"), (1, "g h i j k l"), (2, "a b c d e f"), (3, "g h i j k l"), (4, "m n")], "doc_id long, text string")
    got = {(x.doc_id, x.component_id) for x in minhash.near_duplicates(twice).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_pipeline_stages_against_plain_versions(spark, sf):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    some = docs.filter("lang IS NOT NULL").orderBy("doc_id").limit(3).collect()
    planted = [(10_000 + k, r.text if k % 2 else r.text + " end", r.lang, None if k == 1 else r.source, 1) for k, r in enumerate(some * 2)]
    planted += [(20_000, None, None, None, 0), (20_001, "... 12", None, "x", 1), (20_002, "", None, None, 0)]
    docs = docs.union(spark.createDataFrame(planted, docs.schema))
    rows = docs.collect()

    one = corpus_pipeline.in_a_language(spark, docs, sf).cache()
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in rows if any(c.isalpha() for c in r.text or "")}
    two = corpus_pipeline.without_near_copies(spark, one, sf).cache()
    of = plain_components([(r.doc_id, r.text) for r in one.collect()])
    assert sorted(r.doc_id for r in two.collect()) == sorted({of[i] for i in of})
    three = corpus_pipeline.sources_mixed(spark, two, sf).cache()
    size = lambda r: len((r.text or "").split())
    have, taken, copies = {}, {}, {}
    for r in two.collect():
        have[r.source] = have.get(r.source, 0) + size(r)
    for r in three.collect():
        taken[r.source] = taken.get(r.source, 0) + size(r)
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    names = sorted(have, key=lambda s: (s is None, s or ""))
    want = mixing.fill_targets(have, {s: 1 + k % 3 for k, s in enumerate(names)}, 3)
    most = max(map(size, two.collect()))
    assert max(copies.values()) <= 3 and all(abs(taken.get(s, 0) - want[s]) <= most for s in have)
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.packed(spark, three, sf).collect()
    tokens = sum(len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in three.collect())
    assert sum(p.length for p in pieces) == tokens
    fill = {}
    for p in pieces:
        fill[p.sequence_id] = fill.get(p.sequence_id, 0) + p.length
    assert sorted(fill.values())[1:] == [1024] * (len(fill) - 1) and len(fill) == -(-tokens // 1024)
    for df in (one, two, three):
        df.unpersist()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0
