"""Fingerprints, repairs of conversations and divergence of sources against plain versions."""

import itertools
import random
import zlib

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from cladeflow.llm import conversations, divergence, queries, simhash

DOCS = "doc_id long, text string"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def true_print(text):
    w = (text or "").encode().translate(LOWER).split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(len(w) - 2, 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def true_components(prints, bits=2):
    of = {i: i for i, _ in prints}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for (a, x), (b, y) in itertools.combinations(prints, 2):
        if (x ^ y).bit_count() <= bits:
            a, b = sorted((find(a), find(b)))
            of[b] = a
    return {i: find(i) for i in of}


def test_prints_and_components_equal_brute_force(spark):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(200)]
    rows = []
    for _ in range(30):
        base = r.choices(vocab, k=r.choice([1, 2, 3, 4, 30, 300]))
        for _ in range(r.choice([1, 2, 5])):
            x = list(base)
            if r.random() < 0.5:
                x[r.randrange(len(x))] = r.choice(vocab)
            rows.append((len(rows), "\x0b ".join(x) if r.random() < 0.2 else " ".join(x).upper()))
    n = len(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "É é"), (n + 4, "é é"), (n + 5, rows[0][1]), (None, rows[0][1])]
    rows += [(n + 6, " ".join(r.choices(vocab, k=150_000)))]  # hashed in parts
    got = simhash.near_duplicates(spark.createDataFrame([(*x, "clash") for x in rows], DOCS + ", fingerprint string")).collect()
    prints = [(i, true_print(t)) for i, t in rows if i is not None]
    want, of = true_components(prints), dict(prints)
    assert len(got) == len(rows)
    for x in got:
        if x.doc_id is None:
            assert x.component_id is None and int(x.fingerprint, 16) == of[0]
        else:
            assert (int(x.fingerprint, 16), len(x.fingerprint), x.component_id) == (of[x.doc_id], 16, want[x.doc_id])


@pytest.mark.parametrize("limit", [64, 16])
def test_close_prints_are_all_found(spark, monkeypatch, limit):
    """Also where buckets are too large and are split again: prints around a few centres, in all their bits."""
    monkeypatch.setattr(simhash, "LIMIT", limit)
    r = random.Random(limit)
    prints = set()
    for _ in range(5):
        centre = r.getrandbits(64)
        for _ in range(120):
            prints.add(centre ^ sum(1 << b for b in r.sample(range(64), r.choice([0, 1, 2, 3, 4]))))
    prints |= {1 << b for b in range(64)} | {0}
    rows = [(i, x) for i, x in enumerate(sorted(prints))]
    signed = [(x - (1 << 64) if x >> 63 else x, i) for i, x in rows]
    tables = simhash.Tables(spark)
    got = {tuple(sorted(p)) for p in simhash.close_pairs(spark.createDataFrame(signed, "print long, node long"), 2, tables).collect()}
    assert got == {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if (x ^ y).bit_count() <= 2}


def test_prints_of_empty_tables_and_repeated_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(7, "a b c d"), (7, "x y z u"), (7, "x y z u"), (9, "X y z u"), (11, "a b c d"), (12, "other words")]
    got = sorted((x.doc_id, x.component_id) for x in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(7, 7), (7, 7), (7, 7), (9, 7), (11, 7), (12, 12)]


def every_script(codes):
    """The cheapest (cost, audit) of all edit scripts."""
    best = [10**9, ""]

    def go(i, word, cost, audit, free):
        if cost > best[0]:
            return
        if i == len(codes) and (word == "" or (word[-1] == "a" and len(word) > word.count("s"))):
            best[:] = min(best, [cost, audit])
        due = [c for c in "sua" if (c == "s" and word == "") or (c == "u" and (word == "" or word[-1] in "sa")) or (c == "a" and word[-1:] == "u")]
        for c in due:
            if c != "s" and free:
                go(i, word + c, cost + 3, audit + "I", free - 1)
            if i < len(codes) and codes[i] != "D" and (c == codes[i].lower() or c != "s"):
                same = c == codes[i].lower()
                go(i + 1, word + c, cost + 3 * codes[i].isupper() + 3 * (not same), audit + ("K" if same else "R"), 2)
        if i < len(codes):
            go(i + 1, word, cost + 4, audit + "D", 2)

    go(0, "", 0, "", 2)
    return tuple(best)


def test_alignment_equals_a_search_of_all_scripts():
    r = random.Random(2)
    for k in range(250):
        codes = "".join(r.choices("uasxUASXD", [6, 6, 2, 1, 2, 2, 1, 1, 2], k=k % 7))
        want = every_script(codes)
        assert conversations.align(codes) == want, codes
        assert conversations.align_long(codes) == want, codes
    for n in (30, 150, 400):
        codes = "".join(r.choices("uasxUASXD", [9, 9, 1, 1, 2, 2, 1, 1, 2], k=n))
        parts = [{x: conversations.segment(codes[at : at + 17], x) for x in range(4)} for at in range(0, n, 17)]
        assert conversations.align(codes) == conversations.joined(parts)


ROWS = "conv_id long, turn long, role string, text string, gaps string"


def odd_conversations():
    r = random.Random(6)
    rows = []
    for c in [*range(60), None]:
        turns = [*range(r.choice([0, 1, 2, 5, 9])), *([None, None] if r.random() < 0.3 else [])]
        for t in turns:
            for _ in range(r.choice([1, 1, 1, 2])):
                role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Üser"])
                text = r.choice(["Yes.", "No! \n", "why?", "cut", "", " \x0b", None, "é.é", "...", "a\nb.", "long " * 3000])
                rows.append((c, None if t is None else t * r.choice([1, 1, 2]), role, text, "clash"))
    return rows


@pytest.mark.parametrize("whole", [200_000, 3])
def test_repairs_equal_their_sql(spark, monkeypatch, tmp_path, whole):
    """With the second number, conversations of more than 3 rows are repaired in segments by several tasks."""
    monkeypatch.setattr(conversations, "WHOLE", whole)
    if whole < 10:
        monkeypatch.setattr(conversations, "LONG", 4)
    rows = odd_conversations()
    at = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, ROWS).repartition(3).write.parquet(at)
    got = queries.op12_conversations(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS FROM read_parquet('{at}/*.parquet')")
    found = con.execute(queries.oracle_sql()["op12_conversations"])
    names = [c[0] for c in found.description]
    want = sorted(found.fetchall(), key=repr)
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == want
    assert len(want) == len({x[0] for x in rows})
    assert any(zlib.crc32(b"%d:%d" % x[:2]) % 20 == 0 for x in rows if None not in x[:2])


def test_repair_of_rows_as_they_are(spark):
    rows = [(1, 0, "user", "Hi."), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "cut"), (3, 1, "system", "Be kind.")]
    got = {x.conv: x for x in conversations.repair(spark.createDataFrame(rows, "conv long, turn long, role string, text string"), there=None).collect()}
    assert (got[1].gaps, got[1].cost, got[1].audit) == (1, 0, "KK")
    assert (got[2].truncated, got[2].cost, got[2].audit) == (1, 4, "D")
    assert (got[3].cost, got[3].audit) == (4, "D")
    assert conversations.repair(spark.createDataFrame([], "conv long, turn long, role string, text string"), there=None).count() == 0


@pytest.mark.parametrize("block", [48, 2])
def test_divergence_equals_its_sql(spark, monkeypatch, tmp_path, block):
    """Nulls, groups and a language without terms, odd letters, long texts; also with sources in several blocks."""
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "RARE_BITS", 70)
    r = random.Random(9)
    vocab = [f"{x}{y}" for x in ["straße", "Über", "año", "the", "x", " ", "É"] for y in ["", "a", "B", "œ"]]
    rows = []
    for i in range(220):
        words = r.choices(vocab, [1 / (k + 1) for k in range(len(vocab))], k=r.choice([0, 1, 5, 40]))
        rows.append((i, r.choice([" ", "1", "-\n"]).join(words), r.choice(["de", "en", None]), r.choice(["a", "b", "c", "é", "Z", None, "d"]), "clash"))
    rows += [(900, None, "fr", "a", ""), (901, "seul", "fr", "b", ""), (902, "x " * 60_000, "de", "a", ""), (902, "x y", "de", "a", "")]
    at = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, term string").repartition(3).write.parquet(at)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM read_parquet('{at}/*.parquet')")
    found = con.execute(queries.oracle_sql()["op13_divergence"])
    names = [c[0] for c in found.description]
    want = sorted(found.fetchall())
    got = queries.op13_divergence(spark, str(tmp_path))
    assert sorted(map(tuple, got.select(*names).collect())) == want
    assert {(x[0], x[4]) for x in want if x[0] == "fr"} == {("fr", 0)}
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    big = 9 * 10**17
    x = spark.range(1).select(divergence.share(F.lit(big), F.lit(big + 7), F.lit(5)).alias("p")).first().p
    assert x == divergence._shares([big], big + 7, 5)[0] == 1 + 10**9 * (big + 1) // (big + 12)
