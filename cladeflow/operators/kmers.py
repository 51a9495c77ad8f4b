"""Sequences, k-mers, fragments and features."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cladeflow.functions.columns import hash01, probabilistic_round, reverse_complement, seeded
from cladeflow.operators.common import cut, in_seeded_order, range_bucket, running, summed
from cladeflow.operators.neighbours import nearest_points

#: Symbols of a sequence that are coded at once, and different k-mers that a task counts before it hands them on.
STEP, HELD = 1 << 20, 1 << 18
#: The longest k-mers that fit into a code of 64 bits, and those of which a task holds all of a sequence.
MAX_K, SHORT = 31, 9

_DIGIT = np.full(256, 4, dtype=np.int64)
_DIGIT[list(b"ACGT")] = range(4)
_IS_BASE = np.zeros(256, dtype=bool)
_IS_BASE[list(b"ACGTacgt")] = True

#: Hashes that are made at once, in arrays that fit into a cache; the fixed numbers of MD5.
DRAWN = 1 << 13
_MD5_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], dtype=np.uint32)
_MD5_SINES = np.floor(np.abs(np.sin(np.arange(1, 65, dtype=np.float64))) * 2**32).astype(np.uint32)
_MD5_TURNS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], dtype=np.uint32)


def windows(seqs: DataFrame, ident: str, seq: str, k: int, step: int = 50_000) -> DataFrame:
    """Long sequences cut into parts that share k - 1 symbols, so that no array holds all k-mers of one.

    One pass over the sequence cuts it; each part then gets the first symbols of the next.
    """
    cut_up = seqs.filter(F.length(seq) >= k).select(ident, F.regexp_extract_all(F.col(seq), F.lit(f"(?s).{{1,{step}}}"), F.lit(0)).alias("_parts"))
    joined = F.transform("_parts", lambda x, i: F.concat(x, F.coalesce(F.substring(F.get("_parts", i + 1), 1, k - 1), F.lit(""))))
    return cut_up.select(ident, F.explode(joined).alias(seq))


def kmers(seqs: DataFrame, ident: str, seq: str, k: int, merge: bool = False) -> DataFrame:
    """(id, kmer) for each place of a k-mer of upper-case A, C, G and T; ``merge``: under the smaller of
    it and its reverse complement. The time is linear in the length of a sequence."""
    at_each_place = F.regexp_extract_all(F.col(seq), F.lit(f"(?=([ACGT]{{{k}}}))"), F.lit(1))
    found = windows(seqs, ident, seq, k).select(ident, F.explode(at_each_place).alias("kmer"))
    return found.withColumn("kmer", F.least("kmer", reverse_complement(F.col("kmer")))) if merge else found


def _codes(text: bytes, ks: list[int], merge: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, codes, counts) of the k-mers of a sequence, a stretch of it at a time."""
    for at in range(0, max(len(text), 1), STEP):
        x = _DIGIT[np.frombuffer(text[at : at + STEP + max(ks) - 1], dtype=np.uint8)]
        bad = np.concatenate([[0], np.cumsum(x > 3)])
        for k in ks:
            n = min(len(x) - k + 1, STEP)  # the places that begin in this stretch
            if n <= 0:
                continue
            codes = np.zeros(n, dtype=np.int64)
            for j in range(k):
                codes = codes * 4 + x[j : j + n]
            codes = codes[bad[k : k + n] == bad[:n]]
            if merge:
                rest, other = codes.copy(), np.zeros_like(codes)
                for _ in range(k):
                    other = other * 4 + 3 - rest % 4
                    rest //= 4
                codes = np.minimum(codes, other)
            yield k, *np.unique(codes, return_counts=True)


def _summed_codes(counted: Iterator[tuple[int, np.ndarray, np.ndarray]], ks: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """_codes() of a sequence with its stretches added up, each k once."""
    parts = {k: [] for k in ks}
    for k, codes, n in counted:
        if parts[k]:
            both = np.concatenate([parts[k][1], codes]), np.concatenate([parts[k][2], n])
            codes, where = np.unique(both[0], return_inverse=True)
            n = np.bincount(where, weights=both[1]).astype(np.int64)
        parts[k] = [k, codes, n]
    yield from (tuple(x) for x in parts.values() if x)


def code_counts(seqs: DataFrame, ident: str, seq: str, ks: list[int], merge: bool = False) -> DataFrame:
    """(id, k, code, n): how often a sequence has each k-mer of upper-case A, C, G and T, for all ``ks`` in one pass. A code is
    the k-mer as a number of k digits to the base 4; ``merge``: of the smaller of it and its reverse complement.

    Tasks count stretches of a sequence in arrays, so that only different k-mers are shuffled; where no id occurs twice and k-mers
    are short, a task has a sequence's counts as a whole and nothing is shuffled or held.
    """
    if max(ks) > MAX_K:
        raise ValueError(f"k-mers of more than {MAX_K} symbols")
    short = max(ks) <= SHORT

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, of_k, codes, counts, held = [], [], [], [], 0

            def flush(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                sizes = [len(x) for x in codes]
                rows = pa.array(np.repeat(at, sizes).astype(np.int64))
                arrays = [batch.column(0).take(rows), pa.array(np.repeat(of_k, sizes).astype(np.int32)), pa.array(np.concatenate(codes)), pa.array(np.concatenate(counts).astype(np.int64))]
                for x in (at, of_k, codes, counts):
                    x.clear()
                return pa.RecordBatch.from_arrays(arrays, [ident, "k", "code", "n"])

            for row, text in enumerate(batch.column(1).cast(pa.binary())):
                counted = _codes(text.as_py() or b"", ks, merge)
                for k, found, n in _summed_codes(counted, ks) if short and batch.column(1)[row].is_valid else counted:
                    for kept, x in zip((at, of_k, codes, counts), (row, k, found, n), strict=True):
                        kept.append(x)
                    held += len(found)
                    if held > HELD:
                        yield flush()
                        held = 0
            if codes:
                yield flush()

    kind = seqs.schema[ident].dataType.simpleString()
    parts = seqs.select(ident, seq).mapInArrow(count, f"`{ident}` {kind}, k int, code long, n long")
    if short and seqs.groupBy(ident).agg(F.count("*").alias("_n")).filter("_n > 1").isEmpty():
        return parts
    return parts.groupBy(ident, "k", "code").agg(F.sum("n").alias("n"))


def coded(code: Column, k: Column) -> Column:
    """The k-mer of a code."""
    return F.when(k > 0, F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, F.lit("0")), "0123", "ACGT")).otherwise("")


def code_of(kmer: Column) -> Column:
    return F.when(F.length(kmer) > 0, F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")).otherwise(0)


def kmer_counts(seqs: DataFrame, ident: str, seq: str, k: int, merge: bool = False) -> DataFrame:
    return code_counts(seqs, ident, seq, [k], merge).select(ident, coded(F.col("code"), F.lit(k)).alias("kmer"), "n")


def frequencies(counts: DataFrame, ident: str, unit: bool = False) -> DataFrame:
    """Share of each k-mer in its sequence; ``unit``: scaled to length one."""
    of = Window.partitionBy(ident)
    if not unit:
        return counts.withColumn("freq", F.col("n") / F.sum("n").over(of))
    return counts.withColumn("freq", F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(of)))


def ladder(seqs: DataFrame, ident: str, seq: str, most: int) -> DataFrame:
    """k-mers of 1 to ``most`` symbols with what the shorter ones lead to expect: the count of the first
    k - 1 symbols times the share of the last; single symbols are expected alike."""
    levels = cut(code_counts(seqs, ident, seq, list(range(1, most + 1))))
    of = lambda code: F.sum(F.when(F.col("code") == code, F.col("n")).otherwise(0))
    one = levels.filter("k = 1").groupBy(ident).agg(F.array(*[of(c) for c in range(4)]).alias("_one"), F.sum("n").alias("total"), F.count("*").alias("kinds"))
    prefix = levels.filter(F.col("k") < most).select(ident, (F.col("k") + 1).alias("k"), F.col("code").alias("_prefix"), F.col("n").alias("n_prefix"))
    x = levels.withColumn("_prefix", F.shiftright("code", 2)).join(prefix, [ident, "k", "_prefix"], "left").join(one, ident)
    last = F.get("_one", F.col("code").bitwiseAND(F.lit(3)).cast("int"))
    expected = F.when(F.col("k") == 1, F.col("total") / F.col("kinds")).otherwise(F.col("n_prefix") * last / F.col("total"))
    x = x.withColumn("expected", expected).withColumn("feature", (F.col("n") - F.col("expected")) / F.col("expected"))
    return x.select(ident, "k", coded(F.col("code"), F.col("k")).alias("kmer"), "n", "expected", "feature")


def against_reversed(counts: DataFrame, reversed_counts: DataFrame, ident: str, expected: Column) -> DataFrame:
    """Counts by those of the reversed sequence, or by what is expected where that has none."""
    other = reversed_counts.select(ident, "kmer", F.col("n").alias("n_rev"))
    return counts.join(other, [ident, "kmer"], "left").withColumn("ratio", F.col("n") / F.coalesce(F.nullif("n_rev", F.lit(0)), expected))


def filter_records(seqs: DataFrame, header: str, seq: str, function) -> DataFrame:
    """(header, seq) of ``function(header, seq)`` for each record: a record as it is to be, or None to leave it out. For what no
    column expression can say; the function runs in the tasks, on one record at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [x for x in (function(h, s) for h, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)) if x is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in kept], pa.string()) for k in (0, 1)], [header, seq])

    return seqs.select(F.col(header).cast("string"), F.col(seq).cast("string")).mapInArrow(run, f"`{header}` string, `{seq}` string")


def _starts(seq: str, length: int, step: int) -> Column:
    return F.when(F.length(seq) >= length, F.sequence(F.lit(0), F.length(seq) - length, F.lit(step))).otherwise(F.array().cast("array<int>"))


def _cut_at(df: DataFrame, seq: str, starts: str, length: int, keep: list[str]) -> DataFrame:
    """A row for each of the ``starts`` of a sequence, with the fragment of ``length`` there, in time linear in the
    sequence: it is cut once into blocks of a few fragments' length, and a fragment is taken from its
    block, and from the next, by their numbers."""
    block = 4 * length
    cut_up = df.select(*keep, starts, F.regexp_extract_all(F.col(seq), F.lit(f"(?s).{{1,{block}}}"), F.lit(0)).alias("_parts"))

    def fragment(s: Column) -> Column:
        i = F.floor(s / block).cast("int")
        at = s - i * block
        head = F.substring(F.get("_parts", i), at + 1, F.lit(length))
        tail = F.substring(F.coalesce(F.get("_parts", i + 1), F.lit("")), F.lit(1), F.greatest(at + length - block, F.lit(0)))
        return F.struct(s.alias("start"), F.concat(head, tail).alias("frag"))

    return cut_up.select(*keep, F.explode(F.transform(F.col(starts), fragment)).alias("_x")).select(*keep, "_x.start", "_x.frag")


def shred(seqs: DataFrame, ident: str, seq: str, length: int, offset: int = 0, n: int | None = None, seed: int = 0) -> DataFrame:
    """Fragments of a fixed length, each ``length + offset`` after the last; with ``n``, that many of a
    sequence in seeded order. Returns old id, start, end, frag.

    Places are chosen in the sequence's own row, before any text is cut, so that nothing is shuffled: rows of
    one id are sequences of their own.
    """
    starts = _starts(seq, length, length + offset)
    if n is not None:
        hashed = F.array_sort(F.transform(starts, lambda x: F.struct(seeded(F.concat(F.col(ident).cast("string"), F.lit("-"), x.cast("string")), seed).alias("h"), x.alias("start"))))
        starts = F.transform(F.slice(hashed, 1, n), lambda x: x["start"])
    x = seqs.select(F.col(ident).alias("old_id"), F.col(seq).alias("_s"), starts.alias("_starts"))
    return _cut_at(x, "_s", "_starts", length, ["old_id"]).select("old_id", "start", (F.col("start") + length).alias("end"), "frag")


def capped_fragments(seqs: DataFrame, group: str, ident: str, seq: str, length: int, cap: int, seed: int) -> DataFrame:
    """(group, old_id, start, end, frag): about ``cap`` fragments of each group, shared among its sequences by
    length: ratio = cap * length / all symbols of the group; a sequence has the quota len * ratio / length,
    rounded up or down by chance (seeded), and the fragments that come first in seeded order within it.
    All fragments (quota -1) where the ratio is 1 or more.

    Groups are only summed up; fragments are numbered within one sequence, and no text is shuffled.
    """
    totals = seqs.groupBy(group).agg(F.sum(F.length(seq)).alias("_total"))
    ratio = F.lit(float(cap * length)) / F.col("_total")
    quota = F.when(ratio < 1, probabilistic_round(F.length(seq) * ratio / length, ident, f"quota:{seed}")).otherwise(-1)
    shared = seqs.join(summed(totals.withColumnRenamed(group, "_group")), F.col(group).eqNullSafe(F.col("_group"))).withColumn("_quota", quota)
    whole = shared.filter((F.length(seq) >= length) & (F.col("_quota") != 0)).select(group, F.col(ident).alias("old_id"), F.col(seq).alias("_s"), "_quota", _starts(seq, length, length).alias("_all"))
    # in each sequence's own array: its places by their hashes, as many as the quota
    hashed = F.array_sort(F.transform("_all", lambda x: F.struct(seeded(F.concat(F.col("old_id").cast("string"), F.lit("-"), x.cast("string")), seed).alias("h"), x.alias("start"))))
    chosen = F.when(F.col("_quota") < 0, F.col("_all")).otherwise(F.transform(F.slice(hashed, F.lit(1), F.greatest(F.col("_quota"), F.lit(0)).cast("int")), lambda x: x["start"]))
    out = _cut_at(whole.withColumn("_starts", chosen), "_s", "_starts", length, [group, "old_id"])
    return out.select(group, "old_id", "start", (F.col("start") + length).alias("end"), "frag")


def random_part(seqs: DataFrame, ident: str, seq: str, length: int, seed: int) -> DataFrame:
    """A part of each sequence that begins anywhere; whole sequences where they are shorter."""
    start = F.floor(hash01(ident, seed) * (F.greatest(F.length(seq) - length, F.lit(0)) + 1)).cast("int")
    return seqs.select(ident, start.alias("start"), F.substring(seq, start + 1, F.lit(length)).alias("part"))


def _md5_second_byte(messages: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The second byte of the MD5 of each row of up to 55 bytes, all rows at once; ``messages`` has 64 columns, zero behind a row's end."""
    messages[np.arange(len(lengths)), lengths] = 0x80
    words = np.ascontiguousarray(messages.view("<u4").T)
    words[14] = lengths * 8
    used = [bool(w.any()) for w in words]
    a, b, c, d = (np.full(len(lengths), x, dtype=np.uint32) for x in _MD5_START)
    for i in range(64):
        if i < 16:
            f, k = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, k = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, k = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, k = c ^ (b | ~d), 7 * i % 16
        f += a
        f += _MD5_SINES[i]
        if used[k]:
            f += words[k]
        turn = _MD5_TURNS[i // 16][i % 4]
        turned = f << turn
        f >>= np.uint32(32) - turn
        turned |= f
        turned += b
        a, d, c, b = d, c, b, turned
    return (a + _MD5_START[0] >> np.uint32(8)) & np.uint32(255)


def _drawn(idents: np.ndarray, at: np.ndarray, places: np.ndarray, tail: bytes) -> np.ndarray:
    """0 to 3 by the hash of "ident-place" and ``tail``, for each place (``at``: whose it is)."""
    heads = [str(x).encode() + b"-" for x in idents]
    width = np.array([len(h) for h in heads])
    if width.max() + 20 + len(tail) > 55:
        return np.array([hashlib.md5(heads[i] + b"%d" % p + tail).digest()[1] & 3 for i, p in zip(at.tolist(), places.tolist(), strict=True)], dtype=np.uint8)
    table = np.array(heads, dtype=f"S{width.max()}").view(np.uint8).reshape(len(heads), -1)
    out = np.empty(len(places), dtype=np.uint8)
    for lo in range(0, len(places), DRAWN):
        who, p = at[lo : lo + DRAWN], places[lo : lo + DRAWN]
        message, row, head = np.zeros((len(p), 64), dtype=np.uint8), np.arange(len(p)), width[who]
        message[:, : table.shape[1]] = table[who]
        digits = np.ones(len(p), dtype=np.int64)
        for e in range(1, len(str(int(p.max())))):
            digits += p >= 10**e
        rest = p.copy()
        for e in range(int(digits.max())):
            here = np.flatnonzero(digits > e)
            message[here, (head + digits - 1 - e)[here]] = 48 + rest[here] % 10
            rest //= 10
        for j, x in enumerate(tail):
            message[row, head + digits + j] = x
        out[lo : lo + DRAWN] = _md5_second_byte(message, head + digits + len(tail)) & 3
    return out


def replace_degenerate(seqs: DataFrame, ident: str, seq: str, seed: int) -> DataFrame:
    """Symbols that aren't A, C, G or T replaced by bases that follow from id, seed and how many such symbols and stretches of
    others come before.

    Tasks draw the bases of many symbols at once, in arrays: a base is the hash that seeded() gives, of id and place.
    """
    name, tail = "_seq", f":{seed}".encode()

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idents, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lo = 0
            while lo < len(texts):  # some rows at a time, as arrays hold several numbers for a symbol
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= STEP):
                    size += len(texts[hi] or "")
                    hi += 1
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in batch.columns[2:]], pa.array(_replaced(idents[lo:hi], texts[lo:hi], tail), pa.string())], [*rest, name])
                lo = hi

    rest = [c for c in seqs.columns if c != seq]
    fields = [*[seqs.schema[c] for c in rest], StructField(name, StringType())]
    x = seqs.select(F.col(ident).cast("string").alias("_ident"), F.col(seq).alias("_text"), *rest).mapInArrow(draw, StructType(fields))
    return x.select(*[F.col(name).alias(c) if c == seq else F.col(c) for c in seqs.columns])


def _replaced(idents: list, texts: list, tail: bytes) -> list[str | None]:
    known = [i for i, x in enumerate(texts) if x is not None and (idents[i] is not None)]
    out = [None] * len(texts)
    # without an id there is no hash: what holds none but bases stays, and other texts lose the symbols
    for i, x in enumerate(texts):
        if x is not None and idents[i] is None:
            out[i] = "".join(c for c in x if c in "ACGTacgt")
    if not known:
        return out
    symbols = np.frombuffer("".join(texts[i] for i in known).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(texts[i]) for i in known], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    base = (symbols < 256) & _IS_BASE[np.minimum(symbols, 255)]
    # a piece is a symbol or a stretch of bases; a text's first symbol begins one
    new = np.ones(len(symbols), dtype=bool)
    new[1:] = ~(base[1:] & base[:-1])
    new[starts[lengths > 0]] = True
    piece = np.cumsum(new)
    odd = np.flatnonzero(~base)
    at = np.searchsorted(starts, odd, side="right") - 1
    shown = symbols.astype(np.uint8)
    if len(odd):
        drawn = _drawn(np.array([idents[i] for i in known], dtype=object), at, piece[odd] - piece[starts[at]], tail)
        shown[odd] = np.frombuffer(b"ACGT", dtype=np.uint8)[drawn]
    text = shown.tobytes().decode("ascii")
    for i, lo, n in zip(known, starts.tolist(), lengths.tolist(), strict=True):
        out[i] = text[lo : lo + n]
    return out


def chunk_index(seqs: DataFrame, group: str, ident: str, length: str, size: int) -> DataFrame:
    """Chunks of a fixed size along the concatenated sequences of each group: the sequence that each
    begins in, and how far into it."""
    seqs = seqs.select(group, ident, length)
    placed = running(seqs, group, range_bucket(seqs, ident), [ident], F.col(length)).withColumnRenamed("_run", "_end").withColumn("_start", F.col("_end") - F.col(length))
    first = F.ceil(F.col("_start") / size).cast("long")
    last = F.ceil(F.col("_end") / size).cast("long") - 1
    chunks = placed.filter(first <= last).select(group, ident, "_start", F.explode(F.sequence(first, last)).alias("chunk"))
    return chunks.select(group, "chunk", ident, (F.col("chunk") * size - F.col("_start")).alias("offset"))


def balance(df: DataFrame, label: str, ident: str, target: int | str, seed: int, per_label: dict | None = None) -> DataFrame:
    """At most so many rows of each label, in seeded order: a number, "min" or "median" of the labels'
    counts, or -1 for all; ``per_label`` overrides it label by label."""
    if target in ("min", "median"):
        n = df.groupBy(label).agg(F.count("*").alias("n"))
        target = int(n.agg(F.min("n") if target == "min" else F.percentile("n", 0.5).cast("long")).first()[0] or 0)
    most = F.lit(target)
    for k, v in (per_label or {}).items():
        most = F.when(F.col(label) == k, F.lit(v)).otherwise(most)
    placed = in_seeded_order(df.withColumn("_most", most), label, ident, seed, F.lit(1))
    return placed.filter("_most < 0 OR _run <= _most").select(*df.columns)


def renumber(df: DataFrame, label: str, to: str = "number") -> DataFrame:
    """Labels as 0 to n - 1 in their order; rows without a label go. However many labels there are, they
    are numbered within ranges of them."""
    names = df.select(label).filter(F.col(label).isNotNull()).distinct().withColumn("_all", F.lit(0))
    placed = running(names, "_all", range_bucket(names, label), [label], F.lit(1))
    return df.join(summed(placed.select(label, (F.col("_run") - 1).cast("long").alias(to))), label)


def to_sparse(df: DataFrame, vector: str, to: str = "sparse") -> DataFrame:
    """A dense vector as its non-zero (ind, val), from 1."""
    pairs = F.transform(vector, lambda v, i: F.struct((i + 1).alias("ind"), v.alias("val")))
    return df.withColumn(to, F.filter(pairs, lambda p: p["val"] != 0))


def to_dense(df: DataFrame, sparse: str, n: int, to: str = "dense") -> DataFrame:
    at = F.map_from_entries(F.transform(sparse, lambda p: F.struct(p["ind"], p["val"])))
    return df.withColumn(to, F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.coalesce(F.element_at(at, i), F.lit(0.0))))


def svmlight(label: Column, vector: Column) -> Column:
    """A line of sparse features."""
    pairs = F.filter(F.transform(vector, lambda v, i: F.struct((i + 1).alias("i"), v.alias("v"))), lambda p: p["v"] != 0)
    return F.concat_ws(" ", label.cast("string"), F.array_join(F.transform(pairs, lambda p: F.concat(p["i"].cast("string"), F.lit(":"), F.format_string("%.4f", p["v"].cast("double")))), " "))


def nearest_units(df: DataFrame, ident: str, vector: str, units: DataFrame, radius: float) -> DataFrame:
    """(id, unit, dist) of the nearest grid unit (unit, weights) within ``radius``, ties to the smaller unit. A row visits the
    units' cells that may hold a nearer one than it knows (neighbours.nearest_points)."""
    asked = df.select(F.col(ident).alias("_i"), F.col(vector).alias("_v"))
    grid = units.select(F.col("unit").alias("_i"), F.col("weights").alias("_v"), F.lit(0).alias("_l"))
    near = nearest_points(asked, grid, 1, "_i", "_v", "_l", most=radius, itself=True)
    return near.select(F.col("id_q").alias(ident), F.col("id_p").alias("unit"), "dist")


def pair_radius(df: DataFrame, ident: str, vector: str, share: float = 0.18, rows: int = 500, seed: int = 20) -> DataFrame:
    """(radius): the quantile ``share`` of the distances between all pairs of a sample of at most ``rows`` rows, in seeded order."""
    few = df.orderBy(seeded(ident, seed), ident).limit(rows)
    a, b = few.select(F.col(ident).alias("_i"), F.col(vector).alias("_v")), few.select(F.col(ident).alias("_j"), F.col(vector).alias("_w"))
    square = F.aggregate(F.zip_with("_v", "_w", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda acc, x: acc + x)
    return a.join(F.broadcast(b), F.col("_i") < F.col("_j")).select(F.sqrt(square).alias("_d")).agg(F.percentile("_d", share).alias("radius"))


def split_by_features(seqs: DataFrame, features: DataFrame, ident: str, length: str) -> DataFrame:
    """Coding stretches (id, start, end, strand) and what lies between them, strand 0."""
    f = features.select(ident, "start", "end", "strand")
    at = Window.partitionBy(ident).orderBy("start", "end")
    reach = F.max("end").over(at.rowsBetween(Window.unboundedPreceding, -1))
    gaps = f.withColumn("_reach", F.coalesce(reach, F.lit(0))).filter("start > _reach").select(ident, F.col("_reach").alias("start"), F.col("start").alias("end"), F.lit(0).alias("strand"))
    tail = seqs.select(ident, length).join(f.groupBy(ident).agg(F.max("end").alias("_reach")), ident, "left").withColumn("_reach", F.coalesce("_reach", F.lit(0))).filter(F.col("_reach") < F.col(length))
    return f.union(gaps).union(tail.select(ident, F.col("_reach").alias("start"), F.col(length).alias("end"), F.lit(0).alias("strand")))


def concatenated(seqs: DataFrame, group: str, ident: str, seq: str, spacer: str = "NNNNNNN") -> DataFrame:
    """All sequences of a group as one, with a spacer between them. The group is one text by request."""
    items = F.array_sort(F.collect_list(F.struct(F.col(ident), F.col(seq))))
    return seqs.groupBy(group).agg(F.array_join(F.transform(items, lambda x: x[seq]), spacer).alias(seq))


def concatenated_parts(seqs: DataFrame, group: str, ident: str, seq: str, size: int, spacer: str = "NNNNNNN") -> DataFrame:
    """(group, part, seq): the text of ``concatenated`` in parts of ``size`` symbols, numbered from 0, the last
    one shorter. No row or task holds a group, however long it is."""
    rows = seqs.filter(F.col(seq).isNotNull()).select(group, ident, F.concat(F.col(seq), F.lit(spacer)).alias("_s"))
    placed = running(rows, group, range_bucket(rows, ident), [ident], F.length("_s").cast("long"))
    # the last sequence of a group has no spacer behind it
    text = F.when(F.col("_run") == F.col("_total"), F.expr(f"left(_s, length(_s) - {len(spacer)})")).otherwise(F.col("_s"))
    placed = placed.select(group, ident, (F.col("_run") - F.length("_s")).alias("_start"), text.alias("_s")).filter(F.length("_s") > 0)
    lead = (F.lit(size) - F.col("_start") % size).cast("int")
    rest = F.regexp_extract_all(F.expr("substr(_s, _lead + 1)"), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    pieces = placed.withColumn("_lead", lead).select(group, ident, "_start", F.posexplode(F.concat(F.array(F.expr("left(_s, _lead)")), rest)).alias("_i", "_piece"))
    pieces = pieces.withColumn("part", (F.floor(F.col("_start") / size) + F.col("_i")).cast("long"))
    items = F.array_sort(F.collect_list(F.struct("_start", "_i", "_piece")))
    return pieces.groupBy(group, "part").agg(F.array_join(F.transform(items, lambda x: x["_piece"]), "").alias(seq))


def training_text(seqs: DataFrame, ident: str, seq: str, cap: int, seed: int) -> DataFrame:
    """Both strands of each sequence, all cut by one ratio so that their sum stays near ``cap``."""
    total = seqs.agg(F.sum(F.length(seq))).first()[0] or 0
    ratio = cap / (2 * total) if total else 1.0
    rows = seqs.select(ident, F.lit(1).alias("strand"), F.col(seq).alias(seq)).union(seqs.select(ident, F.lit(-1), reverse_complement(F.col(seq))))
    if ratio >= 1:
        return rows
    n = F.floor(F.length(seq) * ratio).cast("int")
    start = F.floor(hash01(ident, seed) * (F.length(seq) - n + 1)).cast("int")
    return rows.select(ident, "strand", F.substring(seq, start + 1, n).alias(seq))
