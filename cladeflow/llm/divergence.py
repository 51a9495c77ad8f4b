"""How far the sources of a language lie apart in their words, exactly.

Every group (a language's source) stores, for each count that a term can have in it, the set of such
terms as bits. AND and a population count of two groups' sets give how many terms have one count here
and another there, which is all that a sum over terms of a function of two counts needs.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.llm.common import Tables, release, within

#: Fixed value: the parts that a whole is divided into.
WHOLE = 1_000_000_000
#: Term counts that a task holds before it hands them on.
HELD = 200_000
#: Terms whose count in the language is below the first number share bitmaps of about so many bits, and the
#: others, which have more different counts, of so many.
RARE, RARE_BITS, OTHER_BITS = 64, 2048, 64
#: Groups that meet each other in one block.
BLOCK = 48
#: Words that one step of a comparison makes at most.
STEP = 1 << 21
#: Rows about groups that are broadcast at most.
BROADCAST_ROWS = 100_000

# ASCII other than letters parts terms; only A-Z get small
_PARTED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, text) to (lang, source, term, n, docs), in parts that must still be summed up: a task counts
    many documents before it hands rows on. The empty term, with zeros, stands for each group itself."""

    def rows(words: dict, holders: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in words.items():
            terms = list(counts)
            there = holders[lang, source]
            n = len(terms)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (n + 1), pa.string()), pa.array([source] * (n + 1), pa.string()), pa.array([b"", *terms], pa.binary()).cast(pa.string()), pa.array([0, *counts.values()], pa.int64()), pa.array([0, *[there[x] for x in terms]], pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, holders, held = defaultdict(Counter), defaultdict(Counter), 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                terms = text.as_py().translate(_PARTED).split()
                counts = words[lang, source]
                held -= len(counts)
                counts.update(terms)
                holders[lang, source].update(set(terms))
                held += len(counts)
                if held > HELD:
                    yield from rows(words, holders)
                    words, holders, held = defaultdict(Counter), defaultdict(Counter), 0
        yield from rows(words, holders)
        release()

    return docs.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def share(n: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(WHOLE * (n + 1) / (total + kinds)), exact at any size."""
    return F.lit(1) + F.call_function("div", F.lit(WHOLE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), (total + kinds).cast("decimal(20,0)"))


def _shares(n: list[int], total: int, kinds: int) -> list[int]:
    return [1 + WHOLE * (x + 1) // (total + kinds) for x in n]


def _compared(key: tuple, t: pa.Table) -> pa.Table:
    """The parts of all pairs' sums that come from the terms of one bitmap: (lang, source, other, value).

    Rows of ``t`` with word -1 tell of a group: its block, total, the language's kept terms and the bitmap's
    size; the others are a word of a level's bits. Partial sums are parts of a sum of non-negative
    values which stays below (WHOLE + kinds)^2, so that 64 bits hold them.
    """
    source, n, word, bits = (t.column(c).to_numpy(zero_copy_only=False) for c in ("source", "n", "word", "bits"))
    about = np.flatnonzero(word < 0)
    about = about[np.argsort(source[about].astype(object), kind="stable")]
    names = source[about].tolist()
    number = {x: i for i, x in enumerate(names)}
    block, total, kinds, size = (t.column(c).take(pa.array(about)).to_pylist() for c in ("block", "total", "kinds", "size"))
    words = (size[0] + 63) // 64
    full = np.full(words, np.iinfo(np.uint64).max, dtype=np.uint64)
    if size[0] % 64:
        full[-1] = np.uint64((1 << size[0] % 64) - 1)
    # a row of bits for each level of each group, level 0 first: what is in no other level
    of = defaultdict(dict)
    rest = np.flatnonzero(word >= 0)
    for g, c, w, b in zip(source[rest].tolist(), n[rest].tolist(), word[rest].tolist(), bits[rest].view(np.uint64).tolist(), strict=True):
        of[number[g]].setdefault(c, np.zeros(words, dtype=np.uint64))[w] = b
    starts, rows, p = [], [], []
    for i in range(len(names)):
        levels = of[i]
        starts.append(len(rows))
        some = np.bitwise_or.reduce(list(levels.values()), axis=0) if levels else np.zeros(words, dtype=np.uint64)
        rows += [full & ~some, *levels.values()]
        p += _shares([0, *levels], total[i], kinds[i])
    rows, p = np.array(rows), np.array(p, dtype=np.int64)
    lo, hi = key[3].as_py(), key[4].as_py()
    out = ([], [], [])
    for i, name in enumerate(names):
        own = slice(starts[i], starts[i + 1] if i + 1 < len(names) else len(rows))
        a, pa_ = rows[own], p[own]
        values = np.empty(len(rows), dtype=np.int64)
        step = max(1, STEP // (len(a) * words))
        for at in range(0, len(rows), step):
            q = p[None, at : at + step]
            cells = np.bitwise_count(a[:, None, :] & rows[None, at : at + step, :]).sum(axis=2, dtype=np.int64)
            d = pa_[:, None] - q
            values[at : at + step] = (cells * (d * d // q)).sum(axis=0)
        for j, value in enumerate(np.add.reduceat(values, starts).tolist()):
            if i != j and (lo == hi or block[i] != block[j]):
                out[0].append(name)
                out[1].append(names[j])
                out[2].append(value)
    lang = pa.array([key[0].as_py()] * len(out[0]), pa.string())
    return pa.table([lang, pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["lang", "source", "other", "value"])


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of a language differs from its other sources (part
    "pair", all of them) and in which terms it goes beyond the language (part "term", the ``top`` ones).

    Terms are runs of letters A-Z in small letters and of anything beyond ASCII; a language keeps those in ``least_docs`` of its
    documents or more. p is a term's share in billionths, with one added to each count. The value for another source is the sum
    over all kept terms of floor((p - q)^2 / q), q being the other's share, and for a term of more than
    its share in the language, q, that one value. Ties go to the smaller item.

    Kept terms are dealt to bitmaps by the magnitude of their count and by hash, so that a bitmap of many
    bits has few levels. Sources meet in blocks; no task holds a group, a language or its terms.

    Defined results: null text, language and source are empty; a group without terms, or a language without
    kept ones, has pairs (of value 0 if no term is kept); an empty table gives none; other columns are
    not read.
    """
    tables = Tables(docs.sparkSession)
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    counted = term_counts(docs.select(of(lang_col).alias("lang"), of(source_col).alias("source"), of(text_col).alias("text")))
    by = tables.put(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))

    # kept terms, each with a place in a bitmap
    kept = by.filter("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    kept = tables.put(kept.select("lang", "term", "n_lang", F.length(F.bin("n_lang")).alias("size_class")))
    classes = kept.groupBy("lang", "size_class").agg(F.count("*").alias("terms"))
    wide = F.when(F.col("size_class") < RARE.bit_length(), RARE_BITS).otherwise(OTHER_BITS)
    classes = tables.put(classes.select("lang", "size_class", F.ceil(F.col("terms") / wide).alias("parts")))
    dealt = kept.join(within(classes, BROADCAST_ROWS), ["lang", "size_class"]).withColumn("part", F.pmod(F.xxhash64("term"), "parts"))
    place = F.row_number().over(Window.partitionBy("lang", "size_class", "part").orderBy("term")) - 1
    dealt = tables.put(dealt.select("lang", "term", "n_lang", "size_class", "part", place.alias("place")))
    used = tables.put(by.filter("term <> ''").select("lang", "source", "term", "n").join(dealt, ["lang", "term"]))

    # what is known of each group
    langs = kept.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("n_lang").alias("total_lang"))
    groups = by.filter("term = ''").select("lang", "source")
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    sums = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    about = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").join(blocks, "lang").na.fill(0, ["total", "kinds", "total_lang"])
    about = tables.put(about.withColumn("block", F.pmod(F.xxhash64("source"), "blocks")))

    # bitmaps: a row for each word of the bits of a level of a group
    word, bit = (F.col("place") / 64).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place") % 64)
    maps = used.groupBy("lang", "size_class", "part", "source", "n", word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    maps = maps.join(within(about.select("lang", "source", "block", "blocks"), BROADCAST_ROWS), ["lang", "source"])
    none = F.lit(None).cast("long")
    maps = maps.select("lang", "size_class", "part", "source", "block", "blocks", "n", "word", "bits", none.alias("total"), none.alias("kinds"), none.alias("size"))
    sizes = dealt.groupBy("lang", "size_class", "part").agg(F.count("*").alias("size"))
    heads = sizes.join(within(about, BROADCAST_ROWS), "lang").select("lang", "size_class", "part", "source", "block", "blocks", F.lit(0).cast("long").alias("n"), F.lit(-1).alias("word"), F.lit(0).cast("long").alias("bits"), "total", "kinds", "size")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("_x")
    meet = maps.union(heads).select("*", other).withColumn("lo", F.least("block", "_x")).withColumn("hi", F.greatest("block", "_x")).drop("_x", "blocks")
    parts = meet.groupBy("lang", "size_class", "part", "lo", "hi").applyInArrow(_compared, "lang string, source string, other string, value long")
    sums = parts.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    couples = about.select("lang", "source").join(about.select("lang", F.col("source").alias("other")), "lang").filter("source <> other")
    pairs = couples.join(sums, ["lang", "source", "other"], "left").select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), F.coalesce("value", F.lit(0).cast("long")).alias("value"))

    # terms beyond their share in the language
    x = used.join(within(about.select("lang", "source", "total", "kinds", "total_lang"), BROADCAST_ROWS), ["lang", "source"])
    x = x.withColumn("p", share(F.col("n"), F.col("total"), F.col("kinds"))).withColumn("q", share(F.col("n_lang"), F.col("total_lang"), F.col("kinds"))).filter("p > q")
    value = F.expr("(p - q) * (p - q) div q")
    terms = x.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).union(terms.withColumn("rank", rank).filter(F.col("rank") <= top))
