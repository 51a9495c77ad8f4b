"""Equal texts in shards, links of many near copies, and recall at the bench's size."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from cladeflow.llm import ann, language_id, minhash, packing, sharding, topk
from cladeflow.llm.common import Tables, forget
from cladeflow.llm.queries import URL_RULES, op1_ann
from cladeflow.llm.url_filter import filter_urls

DOCS = "doc_id long, text string, source string, lang string"


@pytest.mark.parametrize("group", [1_000_000, 40])
def test_equal_texts_lie_together(spark, monkeypatch, group):
    monkeypatch.setattr(sharding, "GROUP", group)
    r = random.Random(3)
    rows = [(i, f"text {r.randrange(150)}" if i % 3 else "hot", "s", "l") for i in range(900)]
    r.shuffle(rows)
    got = sharding.shard(spark.createDataFrame(rows, DOCS)).collect()
    of = {}
    for x in got:
        of.setdefault((x.text_crc32, x["size"]), []).append((x.shard, x.slot))
    starts = np.cumsum([0] + [sum(x.shard == s for x in got) for s in range(16)])
    for places in of.values():
        at = sorted(starts[s] + k for s, k in places)
        assert at == list(range(at[0], at[0] + len(at)))
    assert sum(len({s for s, _ in p}) > 1 for p in of.values()) <= 15


def test_pairs_of_stars_and_of_one_hot_shingle(spark, monkeypatch):
    """All that the bands would propose is left to a shingle that every text has."""
    monkeypatch.setattr(minhash, "_may_be", lambda pairs, about, percent: pairs.limit(0))
    r = random.Random(5)
    head = "a b c d e"
    rows = []
    for k in range(60):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.choice([8, 40, 41, 54, 80]))]
        rows.append((2 * k, f"{head} {' '.join(base)}"))
        rows.append((2 * k + 1, f"{head} {' '.join(base[:-1] + ['x'])}"))
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    for k in range(60):
        a, b = sets[2 * k], sets[2 * k + 1]
        assert (got[2 * k + 1] == 2 * k) == (100 * len(a & b) >= 75 * len(a | b))


def test_recall_at_the_size_of_the_bench(spark):
    sf = "/root/testdata/sf0.1"
    got = {}
    for x in op1_ann(spark, sf).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, v = np.array([x.vec_id for x in rows]), np.array([x.embedding for x in rows], dtype=np.float64)
    found = wanted = 0
    for k in np.flatnonzero(ids % 20 == 0):
        s = v @ v[k]
        s[k] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        found += len(got[ids[k]] & set(best.tolist()))
        wanted += 20
    assert found >= 0.95 * wanted


def test_odd_vectors_and_names(spark):
    """Clashing columns, repeated ids, and one id with several labels to learn from."""
    r = np.random.default_rng(2)
    rows = [(i % 90, [float(x) for x in r.normal(size=8)], "clash", 1.0) for i in range(100)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, group string, rank double"), F.col("vec_id") % 20 == 0).collect()
    assert {x.query_id for x in got} == {0, 20, 40, 60, 80} and all(1 <= x.rank <= 20 for x in got)
    docs = [(1, "der die das", "s", "de"), (1, "der die das", "s", "en"), (2, "the of and", "s", "en"), (3, "und oder", "s", "de")] * 2
    frame = spark.createDataFrame(docs, DOCS)
    a, b = (language_id.train(x) for x in (frame, frame.repartition(3)))
    assert str(a) == str(b)


def test_packing_of_special_tokens_and_long_texts(spark):
    tokenizers = pytest.importorskip("tokenizers")
    p = pytest.importorskip("public_tokenizers")
    tok = tokenizers.Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"a{end}b", end * 3, f"{end} x {end}", "word " * 120_000, "y" * 30_000, None]
    docs = spark.createDataFrame([(i, t, "s", "l") for i, t in enumerate(texts)], DOCS)
    pieces = packing.pack(docs, p.path("byte_bpe_50k.tiktoken"), p.PATTERN, added={end: 50256}).collect()
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        found = sorted((x.start, np.frombuffer(x.ids, "<u4").tolist()) for x in pieces if x.doc_id == i)
        assert [v for _, part in found for v in part] == ids


def test_long_urls_and_repeated_vector_ids(spark):
    long = "x" * 200_000
    pages = spark.createDataFrame([(1, f"http://a.net/es/{long}", ""), (2, f"http://{long}.com/{long}?{long}", None), (3, f"http://b.org/{long}", f"<link rel=canonical href='http://a.net/es/{long}'>")], "page_id long, url string, html string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    assert {x.page_id: x.verdict for x in filter_urls(pages, rules).collect()} == {1: "block", 2: "allow", 3: "block"}
    rows = [(20, [1.0, 2.0]), (20, [1.0, 2.0]), (7, [3.0, 1.0]), (7, [3.0, 1.0]), (8, [0.5, 0.5])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert [(x.query_id, x.rank, x.vec_id) for x in sorted(got)] == [(20, 1, 7)] * 2 + [(20, 2, 7)] * 2 + [(20, 3, 8)] * 2


def test_very_long_texts_have_near_copies(spark):
    r = random.Random(4)
    words = [f"w{r.randrange(10**6)}" for _ in range(150_000)]
    other = [*words[:75_000], "other", *words[75_001:]]
    rows = [(5, " ".join(words)), (6, " ".join(other)), (7, " ".join(words[:1000]))]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: c for k, (_, c) in got.items()} == {5: 5, 6: 5, 7: 7} and got[5][0] >= 149_990


def test_tables_go_when_they_are_forgotten(spark):
    tables = Tables(spark)
    kept = tables.put(spark.range(3))
    assert kept.count() == 3
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(tables.root)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert there.exists(path)
    forget()
    assert not there.exists(path)
