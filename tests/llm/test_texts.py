"""Packing, counts, mixing, languages, licences, shards and URLs against brute force."""

import itertools
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cladeflow.llm import language_id, licenses, mixing, packing, queries, sharding, token_counts, url_filter

P = pytest.importorskip("public_tokenizers")
TEXTS = ["Hello  world, it's  me\n\n again ", "", None, " lead", "tail ", "a\n b", "x \n\n  y", "naïve Übermut 東京 😀", "word " * 300, "1234 5.6%%% don't\tstop", "<|endoftext|>", " odd space "]


def docs_of(spark, rows, schema="doc_id long, text string, source string, lang string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def some(spark):
    r = random.Random(2)
    rows = [(i, TEXTS[i % len(TEXTS)] if i % 2 else " ".join(r.choices(["the", "of", "tion", "ing,", "and"], k=r.randrange(1, 400))), [None, "a", "b", "b", "b", "c"][i % 6], "en") for i in range(90)]
    return rows + [(None, "no id", "a", None), (3, "again", "b", None), (3, "again", "b", None)]


def test_packing_places_every_token_once(spark, some):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    added = {"<|endoftext|>": 50256}
    docs = docs_of(spark, some).repartition(3).withColumn("start", F.lit("clash"))
    pieces = packing.pack(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, window=128, added=added).collect()
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    ids = {}
    for i, text, _, _ in some:
        ids.setdefault(i, []).append([*tok.encode(text or "", add_special_tokens=False).ids, 0])
    for i, found in by_doc.items():
        tokens = sorted((p.start, np.frombuffer(p.ids, "<u4").tolist()) for p in found)
        if len(ids[i]) == 1:
            assert list(itertools.chain(*[t for _, t in tokens])) == ids[i][0]
            assert {p.doc_tokens for p in found} == {len(ids[i][0])}
        else:
            assert sum(len(t) for _, t in tokens) == sum(map(len, ids[i]))
    assert by_doc.keys() == ids.keys()
    total = sum(len(x) for v in ids.values() for x in v)
    assert sorted(by_seq) == list(range(-(-total // 128)))
    share = {}
    for s, found in by_seq.items():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
            share.setdefault(s, {}).setdefault(p.source, 0)
            share[s][p.source] += p.length
        assert at == (128 if s < len(by_seq) - 1 else total - 128 * s)
    tokens_of = {}
    for i, _, s, _ in some:
        tokens_of.setdefault(s, 0)
    for p in pieces:
        tokens_of[p.source] += p.length
    for s in range(len(by_seq) - 1):  # each window has the target proportions, to a token or two
        for source, n in tokens_of.items():
            assert abs(share[s].get(source, 0) - 128 * n / total) <= 2.5
    rows = packing.sequences(packing.pack(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, window=128, added=added), 128).collect()
    assert all(len(r.ids) == 128 * 4 for r in rows) and sum(r.n_tokens for r in rows) == total


def test_schedule_is_a_merge_by_due_time():
    plan = packing.Schedule([50, 7, 300, 1], [3.0, 1.0, 2.0, 2.0], 16)
    order = sorted(((2 * n + 1) / w, j) for j, (t, w) in enumerate(zip([50, 7, 300, 1], [3.0, 1.0, 2.0, 2.0], strict=True)) for n in range(t))
    for k in range(plan.n // 16 + 2):
        want = [0] * 4
        for _, j in order[: 16 * k]:
            want[j] += 1
        assert plan.served(np.array([k]))[0].tolist() == want


def test_packing_of_nothing(spark):
    assert packing.pack(docs_of(spark, []), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_counts_equal_the_tokenizers(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = token_counts.zipf_vocabulary(P.path("piece_bpe_32k.model"))
    whole = [("<unk>", 0.0)] + vocab + [(f"<0x{b:02X}>", -99.0) for b in range(256)]
    tok = Tokenizer(models.Unigram(whole, unk_id=0, byte_fallback=True))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    low = min(s for _, s in vocab)
    r = random.Random(4)
    texts = TEXTS + ["".join(r.choices("abcdeéß東▁ \nxyz", k=60)) for _ in range(200)] + ["tiontionthe " * 40]
    viterbi = token_counts.Viterbi(vocab)
    viterbi.unknown = min(low, -99.0) - token_counts.UNKNOWN  # as the byte pieces are in that vocabulary
    counted = token_counts.count_tokens(docs_of(spark, [(i, t, "s", "n") for i, t in enumerate(texts)]).withColumn("n_tokens", F.lit(-1)), P.path("piece_bpe_32k.model"))
    got = {x.doc_id: x.n_tokens for x in counted.collect()}
    for i, t in enumerate(texts):
        assert got[i] == len(tok.encode(t or "").ids), t


def test_viterbi_ties_and_brute_force():
    vocab = [("▁", -1.0), ("a", -1.0), ("b", -2.0), ("ab", -3.0), ("ba", -3.0), ("▁a", -2.0), ("aba", -4.0)]
    v = token_counts.Viterbi(vocab)
    scores = dict(vocab)

    def best(word):
        if not word:
            return 0.0
        return max([scores[p] + best(word[len(p) :]) for p in scores if word.startswith(p)], default=float("-inf"))

    for n in range(1, 7):
        for w in itertools.product("ab", repeat=n):
            assert v("▁" + "".join(w))[0] == best("▁" + "".join(w))
    assert v("▁aba")[1] == 2  # "▁" and "aba" tie with "▁a" "ba" and others; the longest last piece stays
    assert v("é")[1] == 2 and v("")[1] == 0


def test_mix_meets_targets(spark):
    r = random.Random(8)
    rows = [(i, " ".join(["w"] * r.randrange(0, 60)), ["a", "b", "c", "d", None][min(4, int(r.expovariate(0.6)))], None) for i in range(3000)]
    docs = docs_of(spark, rows + [(None, None, "a", None), (5, "x", "a", None), (5, "x", "a", None)]).withColumn("copies", F.lit("clash"))
    m = mixing.mix(docs, F.array("source"))
    got = m.docs.collect()
    assert len(got) == 3003
    taken, size = {}, {}
    for x in got:
        assert 0 <= x.copies <= 3 and x.size == len((x.text or "").split())
        taken[x.source] = taken.get(x.source, 0) + x.copies * x["size"]
        size[x.source] = size.get(x.source, 0) + x["size"]
    assert sum(m.targets.values()) == pytest.approx(sum(size.values()))
    for s in size:
        assert m.targets[s] <= 3 * size[s] + 1e-6
        assert abs(taken[s] - m.targets[s]) <= 60
    again = {(x.doc_id, x.text): x.copies for x in mixing.mix(docs, F.array("source")).docs.collect()}
    assert again == {(x.doc_id, x.text): x.copies for x in got}
    assert mixing.mix(docs_of(spark, []), F.array("source")).docs.count() == 0


def test_mix_of_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a"] if i < 100 else ["a", "b"] if i < 300 else ["b", None]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    m = mixing.mix(docs, F.col("sources"), weights={"a": 1, "b": 1, None: 1})
    got = m.docs.collect()
    taken = {}
    for x in got:
        assert x.copies <= 3 and set(x.assigned) <= set(x.sources)
        for s in x.assigned:
            taken[s] = taken.get(s, 0) + x["size"]
    for s, t in m.targets.items():
        assert abs(taken[s] - t) <= 20


def test_min_cost_flow_against_all_choices():
    r = random.Random(3)
    for _ in range(40):
        members = [m for m in [("a",), ("b",), ("a", "b")]]
        cap = [r.randrange(0, 4) for _ in members]
        want = {"a": r.randrange(0, 8), "b": r.randrange(0, 8)}
        flow = mixing.min_cost_flow(cap, members, want, [0, 1, 3])
        used = [sum(f.values()) for f in flow]

        def cost(used):
            return sum(sum([0, 1, 3][u // c] for u in range(n)) for n, c in zip(used, cap, strict=True) if c)

        best = None
        for x in itertools.product(*[range(3 * c + 1) for c in (cap[0], cap[1], cap[2], cap[2])]):
            if x[2] + x[3] > 3 * cap[2] or x[0] + x[2] > want["a"] or x[1] + x[3] > want["b"]:
                continue
            key = (-sum(x), cost([x[0], x[1], x[2] + x[3]]))
            best = key if best is None else min(best, key)
        assert (-sum(used), cost(used)) == best


def test_fill_targets_reshares():
    got = mixing.fill_targets({"a": 1, "b": 10, "c": 100}, {"a": 3, "b": 2, "c": 1}, 3)
    assert got == {"a": 3.0, "b": 30.0, "c": 78.0}


def test_language_accuracy_and_odd_texts(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = queries.languages(docs).filter("held_out").select("doc_id", "lang", "lang_pred", "score").collect()
    assert all(t.lang_pred == t.lang for t in told if t.score > 0.6)
    assert sum(t.lang_pred == t.lang for t in told) >= 0.98 * len(told)
    odd = docs_of(spark, [(1, None, None, None), (2, "", None, None), (3, "123 ... %", None, None), (None, "the and of", None, None)])
    model = language_id.train(docs.filter(~language_id.held_out()))
    assert [(r.lang_pred, r.score) for r in language_id.identify(odd.filter("doc_id IS NOT NULL"), model).orderBy("doc_id").collect()] == [("und", 0.0)] * 3
    assert language_id.identify(odd, None).select("lang_pred").distinct().collect()[0][0] == "und"
    assert language_id.train(odd) is None
    crc = docs.select("doc_id", language_id.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in crc)


def test_presence_is_that_of_short_parts():
    a, b = np.zeros(language_id.SLOTS, bool), np.zeros(language_id.SLOTS, bool)
    text = "Straße, ééé und 12 mehr! " * 50
    step, language_id.STEP = language_id.STEP, 17
    language_id.grams(text, a)
    language_id.STEP = step
    language_id.grams(text, b)
    assert np.count_nonzero(b & ~a) == 0


def test_licences_by_canonical_text(spark):
    mit = [t for n, t in licenses.KNOWN if n == "MIT" and len(t) > 500][0]
    rows = [
        (1, mit.upper().replace(",", " ,,"), "MIT", ""),
        (2, mit.replace("Copyright (c) <year>", "(C) 1999-2024"), "MIT", ""),
        (3, "Some prose.\nReleased under the MIT Licence!\nLICENSED under CC BY-NC 4.0", None, "CC-BY-NC-4.0,MIT"),
        (4, "Licensed under the Apache License, Version 2.0.", "Apache-2.0", "Apache-2.0"),
        (5, None, None, ""),
        (6, "", None, ""),
        (7, mit + " and more", None, "MIT"),
    ]
    got = licenses.scan(docs_of(spark, [(i, t, None, None) for i, t, _, _ in rows]).withColumn("license", F.lit(1))).collect()
    lines = {r.doc_id: r for r in got}
    assert all(lines[i].license == name for i, _, name, _ in rows)
    assert [lines[i].notices for i in (3, 4, 5)] == ["CC-BY-NC-4.0,MIT", "Apache-2.0", ""]


def test_common_licences_are_known(spark):
    body = lambda name: (Path(licenses.__file__).parent / "license_texts" / f"{name}.txt").read_text()
    names = ["Apache-2.0", "Artistic-1.0-Perl", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "Zlib", "Unlicense", "BSL-1.0"]
    rows = [(i, body(name).upper(), name, "") for i, name in enumerate(names)]
    rows += [
        (50, body("Apache-2.0").split("APPENDIX")[0], "Apache-2.0", ""),
        (51, body("GPL-2.0").split("END OF TERMS")[0], "GPL-2.0", ""),
        (52, "BSD 3-Clause License\n\nCopyright (c) 2020, X\nAll rights reserved.\n\n" + body("BSD-3-Clause").split("\n\n", 1)[1], "BSD-3-Clause", ""),
        (53, "Copyright (c) 2020, X\nAll rights reserved.\n\n" + re.sub(r"(?m)^\d\.", "*", body("BSD-3-Clause").split("\n\n", 1)[1]), "BSD-3-Clause", ""),
        (54, [t for n, t in licenses.KNOWN if n == "MIT" and len(t) > 500][0].split("\n\n", 1)[1], "MIT", ""),
        (55, "The MIT License (MIT)\n" + [t for n, t in licenses.KNOWN if n == "MIT" and len(t) > 500][0].split("\n\n", 1)[1], "MIT", ""),
        (60, "prose\nThis project is licensed under the BSD 3-Clause License.\n# SPDX-License-Identifier: GPL-2.0-or-later\nmore", None, "BSD-3-Clause,GPL-2.0"),
        (61, body("MPL-2.0") + "\nand a tail", None, ""),
    ]
    got = {r.doc_id: r for r in licenses.scan(docs_of(spark, [(i, t, None, None) for i, t, _, _ in rows])).collect()}
    bad = [(i, got[i].license, name) for i, _, name, _ in rows if got[i].license != name]
    assert not bad
    assert [(got[i].license, got[i].notices) for i in (60, 61)] == [(None, "BSD-3-Clause,GPL-2.0"), (None, "")]
    clash = spark.createDataFrame(licenses.all_known(), "license string, text string").select("license", F.array_join(licenses.lines_of(F.col("text")), " ").alias("body")).groupBy("body").agg(F.collect_set("license").alias("of")).filter((F.size("of") > 1) | (F.col("body") == ""))
    assert clash.collect() == []


def true_hilbert_neighbours(order):
    return all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in itertools.pairwise(order))


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2)])
def test_hilbert_visits_neighbours(spark, dims, bits):
    points = list(itertools.product(range(2**bits), repeat=dims))
    df = spark.createDataFrame([(list(p),) for p in points], "p array<long>").withColumn("h", sharding.hilbert("p", dims, bits))
    rows = sorted(df.collect(), key=lambda r: r.h)
    assert [r.h for r in rows] == list(range(len(points)))
    assert true_hilbert_neighbours([r.p for r in rows])


def test_shards_have_equal_rows(spark, some):
    docs = docs_of(spark, some + [(500 + i, "same", "hot", "en") for i in range(200)]).withColumn("size", F.lit("clash"))
    got = sharding.shard(docs).collect()
    n = len(some) + 200
    assert len(got) == n
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(16)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    runs = sorted((r.shard, r.slot, r.curve) for r in got)
    assert [c for *_, c in runs] == sorted(c for *_, c in runs)
    texts = {i: t for i, t, *_ in some}
    for r in got:
        if r.doc_id is not None and r.doc_id != 3 and r.doc_id < 90:
            t = (texts[r.doc_id] or "").encode()
            assert (r["size"], r.text_crc32) == (len(t) + 1, zlib.crc32(t))
    assert sharding.shard(docs_of(spark, [])).count() == 0


def test_urls_blocked_through_aliases(spark):
    page = lambda link="", to="": f'<html><head>{f"<link href={link!r} rel=canonical>" if link else ""}{f"<META HTTP-EQUIV=refresh content=" + chr(34) + f"0; URL={to}" + chr(34) + ">" if to else ""}</head>'
    rows = [
        (1, "http://A.net/es/1#x", page()),  # blocked by a rule
        (2, "https://b.org/z", page(link="http://a.net/es/1")),  # an alias of it
        (3, "https://c.org/", page(to="https://b.org/z?")),  # another address
        (4, "https://d.org", page(to="//b.org/z")),  # an alias of an alias
        (5, "http://x.com/p", page(link="http://a.net/es/1")),  # allowed explicitly
        (6, "http://e.org/q/r.html", page(to="s.html")),
        (7, "http://e.org/q/s.html", page(link="http://gone.net/fr/9")),  # its target is blocked, and isn't a page
        (8, None, None),
        (9, "no scheme", page()),
        (10, "http://www.EXAMPLE.com/en/", page()),
        (11, "http://m.example.com/en/1?x", page()),
        (12, "http://notexample.com/en/1", page()),
        (13, "http://f.org/a", page(link="/b")),
        (14, "http://f.org/b?utm#x", page()),
    ]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, verdict string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, rules).collect()}
    want = {1: "block", 2: "block", 3: "allow", 4: "block", 5: "allow", 6: "block", 7: "block", 8: "allow", 9: "allow", 10: "allow", 11: "block", 12: "allow", 13: "allow", 14: "allow"}
    assert {i: r.verdict for i, r in got.items()} == want
    assert (got[8].host, got[8].path, got[9].host, got[1].host, got[1].path, got[4].path) == ("", "", "", "a.net", "/es/1", "")
    assert (got[10].rule, got[11].rule, got[12].rule, got[1].rule) == ("www.example.com/en/", "example.com/en/", "com/", "net/es/")
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
    pieces = corpus_pipeline.run(spark, sf)
    assert pieces.agg(F.sum("length")).first()[0] > 0
    assert len(corpus_pipeline.STAGES) == 4
