"""Intervals [start, end) and arrays of repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


#: Positions of a bin. Windows are sorted within bins of a key, and what lies before or after a bin is summed up
#: by bin, so that no task holds a key.
WIDTH = 1 << 16


def _bin(position: Column) -> Column:
    return F.floor(position / WIDTH)


def _joined(x: DataFrame, sums: DataFrame, key: list[str]) -> DataFrame:
    """``x`` with columns of ``sums`` by key and _bin, nulls being a key as any other."""
    renamed = sums.select(*[F.col(k).alias(f"_by_{k}") for k in [*key, "_bin"]], *[c for c in sums.columns if c not in (*key, "_bin")])
    on = [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in [*key, "_bin"]]
    return x.join(renamed, on).drop(*[f"_by_{k}" for k in [*key, "_bin"]])


def _with_before(x: DataFrame, key: list[str], to: str, value: Column, total=F.sum, after: bool = False) -> DataFrame:
    """``x`` with ``total`` (sum, max or min) of ``value`` over all bins before a row's own, or after it: a row for each
    key and bin is put in order, no more."""
    at = Window.partitionBy(*key).orderBy("_bin")
    at = at.rowsBetween(1, Window.unboundedFollowing) if after else at.rowsBetween(Window.unboundedPreceding, -1)
    sums = x.groupBy(*key, "_bin").agg(total(value).alias("_sum"))
    return _joined(x, sums.withColumn(to, total("_sum").over(at)).drop("_sum"), key)


def merged(df: DataFrame, key: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Unions of overlapping or touching intervals of each key.

    Of equal starts the furthest end counts; a bin of starts then has no more rows than positions.
    """
    x = df.filter(F.col(start) < F.col(end)).groupBy(*key, start).agg(F.max(end).alias(end)).withColumn("_bin", _bin(F.col(start)))
    x = _with_before(x, key, "_reach", F.col(end), F.max)
    at = Window.partitionBy(*key, "_bin").orderBy(start)
    reach = F.greatest("_reach", F.max(end).over(at.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1)).drop("_reach")
    x = _with_before(x, key, "_runs", F.col("_new"))
    x = x.withColumn("_run", F.coalesce("_runs", F.lit(0)) + F.sum("_new").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*key, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def overlap_totals(a: DataFrame, b: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """(key, by, overlap): positions of a's intervals that b's cover, summed up over all pairs that overlap; without
    pairs where they don't.

    What b covers up to a place, with repeats, follows from how many of its intervals begin and end before it
    and where: sums over bins and within the place's bin. No pairs are formed.
    """
    ends = F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(-1).alias("sign")), F.struct(F.col("end").alias("at"), F.lit(1).alias("sign")))).alias("_x")
    a, b = a.filter("start < end"), b.filter("start < end")
    asked = a.select(*key, *by, ends).select(*key, *by, "_x.at", "_x.sign", F.lit(0).alias("_n"))
    # a start opens a row of cover and an end closes it
    edges = b.select(*key, ends).select(*key, "_x.at", (-F.col("_x.sign")).alias("_n")).groupBy(*key, "at").agg(F.sum("_n").alias("_n"))
    x = asked.unionByName(edges.withColumn("sign", F.lit(0)), allowMissingColumns=True).withColumn("_bin", _bin(F.col("at")))
    x = _with_before(x, key, "_n0", F.col("_n"))
    x = _with_before(x, key, "_p0", F.col("_n") * F.col("at"))
    at = Window.partitionBy(*key, "_bin").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.coalesce("_n0", F.lit(0)) + F.sum("_n").over(at)
    p = F.coalesce("_p0", F.lit(0)) + F.sum(F.col("_n") * F.col("at")).over(at)
    x = x.withColumn("_covered", n * F.col("at") - p).filter("sign <> 0")
    return x.groupBy(*key, *by).agg(F.sum(F.col("sign") * F.col("_covered")).alias("overlap")).filter("overlap > 0")


def overlapping(a: DataFrame, b: DataFrame, key: list[str], width: int = 4096) -> DataFrame:
    """Pairs of a's and b's intervals of one key that overlap, each once; b's columns but the key as b_<column>.

    Both are laid into the bins that they touch, and a pair is met in the bin where the later of the two
    begins, so that a key is as many joins as it has bins.
    """
    touched = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width))).alias("_bin")
    x = a.filter("start < end").select("*", touched("start", "end"))
    y = b.select(*key, *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in key]).filter("b_start < b_end").select("*", touched("b_start", "b_end"))
    met = x.join(y, [*key, "_bin"]).filter("start < b_end AND b_start < end")
    return met.filter(F.col("_bin") == F.floor(F.greatest("start", "b_start") / width)).drop("_bin")


def _covered(bins: np.ndarray, kinds: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, kind, positions) of the kinds from 0 that kind -1 covers; starts and ends lie within a bin. Bins, and then the kinds of each, are
    laid behind one another on a line, on which unions are running maxima."""

    def union(line: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s, e = s + line * (width + 1), e + line * (width + 1)
        order = np.argsort(s, kind="stable")
        line, s, reach = line[order], s[order], np.maximum.accumulate(e[order])
        new = np.flatnonzero(np.concatenate([[True], s[1:] > reach[:-1]]))
        return line[new], s[new], reach[np.append(new[1:], len(s)) - 1]

    hit = kinds < 0
    if not hit.any() or hit.all():
        return bins[:0], kinds[:0], start[:0]
    _, hs, he = union(bins[hit], start[hit], end[hit])
    before = np.concatenate([[0], np.cumsum(he - hs)])
    pairs, line = np.unique(np.stack([bins[~hit], kinds[~hit]]), axis=1, return_inverse=True)
    line, ps, pe = union(line.ravel(), start[~hit], end[~hit])
    shift = (pairs[0] - np.arange(pairs.shape[1]))[line] * (width + 1)

    def upto(x: np.ndarray) -> np.ndarray:
        k = np.searchsorted(hs, x, side="right")
        return before[k] - np.where(k > 0, np.maximum(he[k - 1] - x, 0), 0)

    n = np.bincount(line, weights=upto(pe + shift) - upto(ps + shift), minlength=pairs.shape[1]).astype(np.int64)
    return pairs[0][n > 0], pairs[1][n > 0], n[n > 0]


def coverage(parts: DataFrame, hits: DataFrame, key: list[str], kind: str) -> DataFrame:
    """Distinct positions of the parts of each kind that hits cover, without a row for a position or a pair.

    Intervals are cut at the bounds of bins, of equal starts the furthest end counts, and tasks unite and measure
    many bins at once in arrays. A bin is as wide as intervals are on average, at least ``WIDTH``, so that there are no more pieces
    than a few for each.
    """
    both = parts.select(*key, kind, "start", "end", F.lit(False).alias("_hit")).unionByName(hits.select(*key, F.lit(None).cast(parts.schema[kind].dataType).alias(kind), "start", "end", F.lit(True).alias("_hit"))).filter("start < end")
    width = max(WIDTH, int(both.agg(F.avg(F.col("end").cast("double") - F.col("start"))).first()[0] or 0))
    b = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("_bin")
    x = both.select(*key, kind, "_hit", "start", "end", b)
    x = x.select(*key, kind, "_hit", "_bin", (F.greatest("start", F.col("_bin") * width) - F.col("_bin") * width).alias("_s"), (F.least("end", (F.col("_bin") + 1) * width) - F.col("_bin") * width).cast("long").alias("_e"))
    x = x.withColumn("_s", F.col("_s").cast("long")).groupBy(*key, "_bin", "_hit", kind, "_s").agg(F.max("_e").alias("_e"))
    of = [*key, "_bin"]
    x = x.repartition(*of).sortWithinPartitions(*of).select(*of, kind, "_hit", "_s", "_e")
    fields = [*[x.schema[c] for c in key], x.schema[kind], StructField("_n", LongType())]

    def measure(t: pa.Table) -> pa.RecordBatch:
        changed = np.zeros(t.num_rows, dtype=bool)
        for c in of:
            changed[1:] |= _differ(t[c])
        bins = np.cumsum(changed)
        names = t[kind].combine_chunks().dictionary_encode("encode")
        kinds = np.where(t["_hit"].to_numpy(), -1, names.indices.to_numpy(zero_copy_only=False)).astype(np.int64)
        at, k, n = _covered(bins, kinds, t["_s"].to_numpy(), t["_e"].to_numpy(), width)
        first = pa.array(np.searchsorted(bins, at))
        return pa.RecordBatch.from_arrays([*[t[c].combine_chunks().take(first) for c in key], names.dictionary.take(pa.array(k)), pa.array(n)], [*key, kind, "_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            held.append(batch)
            t = pa.Table.from_batches(held)
            changed = np.flatnonzero(np.logical_or.reduce([_differ(t[c]) for c in of])) if t.num_rows > 1 else []
            if len(changed):  # the last bin may go on
                yield measure(t.slice(0, changed[-1] + 1))
                held = t.slice(changed[-1] + 1).combine_chunks().to_batches()
        if held:
            yield measure(pa.Table.from_batches(held))

    out = x.mapInArrow(run, StructType(fields))
    return out.groupBy(*key, kind).agg(F.sum("_n").alias("covered"))


def _differ(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each value but the first is another than the one before; nulls are alike."""
    codes = column.combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
    return codes[1:] != codes[:-1]


def nearest(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The least gap between a's and b's intervals of one key; negative where they overlap.

    Sorted by their middles, an interval of a is next to the least start of what follows and to the
    greatest end of what comes before, in its bin or in the bins after or before: no pairs are formed.
    """
    both = a.select(key, "start", "end", F.lit(None).cast("double").alias("_s"), F.lit(None).cast("double").alias("_e"))
    both = both.unionByName(b.select(key, F.lit(None).alias("start"), F.lit(None).alias("end"), F.col("start").cast("double").alias("_s"), F.col("end").cast("double").alias("_e")))
    both = both.withColumn("_middle", F.coalesce(F.col("start") + F.col("end"), F.col("_s") + F.col("_e"))).withColumn("_bin", _bin(F.col("_middle")))
    # of equal middles only the shortest and the longest interval of b matter, and likewise of a
    both = both.groupBy(key, "_bin", "_middle").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("_s").alias("_s"), F.max("_e").alias("_e"))
    both = _with_before(_with_before(both, [key], "_before", F.col("_e"), F.max), [key], "_after", F.col("_s"), F.min, after=True)
    at = Window.partitionBy(key, "_bin").orderBy("_middle")
    after = F.least("_after", F.min("_s").over(at.rangeBetween(Window.currentRow, Window.unboundedFollowing))) - F.col("end")
    before = F.col("start") - F.greatest("_before", F.max("_e").over(at.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return both.withColumn("gap", F.least(after, before)).groupBy(key).agg(F.min("gap").alias("gap")).filter("gap IS NOT NULL")


def array_extents(elements: DataFrame, array: str) -> DataFrame:
    """Extent of each array, and its number of repeats: elements alternate with spacers."""
    return elements.groupBy(array).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.floor((F.count("*") + 1) / 2).alias("repeats"))


def spacers_in_ratio(elements: DataFrame, array: str, low: float = 0.6, high: float = 2.5) -> DataFrame:
    """Whether every spacer's length lies within the ratios of the array's mean repeat length."""
    at = Window.partitionBy(array).orderBy("start", "end")
    x = elements.withColumn("_gap", F.lead("start").over(at) - F.col("end")).withColumn("_mean", F.avg(F.col("end") - F.col("start")).over(Window.partitionBy(array)))
    ok = F.col("_gap").isNull() | ((F.col("_gap") >= low * F.col("_mean")) & (F.col("_gap") <= high * F.col("_mean")))
    return x.groupBy(array).agg(F.bool_and(ok).alias("ok"))


def similar_spacers(spacers: DataFrame, array: str, place: str, seq: str, identity: float = 0.6, reach: int = 3) -> DataFrame:
    """Share of spacers that are like one of the next few: identity is 1 - edit distance by length."""
    steps = F.explode(F.sequence(F.lit(1), F.lit(reach)))
    later = spacers.select(array, F.col(place).alias("_p"), F.col(seq).alias("_q"), steps.alias("_step")).withColumn(place, F.col("_p") - F.col("_step"))
    near = spacers.join(later.select(array, place, "_q"), [array, place])
    like = 1 - F.levenshtein(seq, "_q") / F.greatest(F.length(seq), F.length("_q")) >= identity
    hit = near.filter(like).select(array, place).distinct().withColumn("_hit", F.lit(1))
    return spacers.join(hit, [array, place], "left").groupBy(array).agg((F.sum(F.coalesce("_hit", F.lit(0))) / F.count("*")).alias("share"))


def joined_elements(elements: DataFrame, array: str, place: str, seq: str, repeat: Column) -> DataFrame:
    """Elements of an array as one sequence: repeats in capitals, spacers in small letters, no gaps."""
    text = F.regexp_replace(F.when(repeat, F.upper(seq)).otherwise(F.lower(seq)), "-", "")
    items = F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), text.alias("t"))))
    return elements.groupBy(array).agg(F.array_join(F.transform(items, lambda x: x["t"]), "").alias("seq"))


def forward(df: DataFrame, begin: str, end: str, is_forward: Column) -> DataFrame:
    """Hit coordinates on the forward strand, half-open, from 1-based closed ones in reading order."""
    return df.withColumn("start", F.when(is_forward, F.col(begin) - 1).otherwise(F.col(end) - 1)).withColumn("stop", F.when(is_forward, F.col(end)).otherwise(F.col(begin)))


def overlay(queries: DataFrame, hits: DataFrame, ident: str, seq: str, order: str) -> DataFrame:
    """The query with the last hit's symbol at each place, in small letters where it differs. What a hit holds beyond
    the query's ends is left out; of hits of one order the one that sorts last counts.

    A query meets its hits in one row, on which they are laid one after another as arrays.
    """
    laid = hits.groupBy(ident).agg(F.array_sort(F.collect_list(F.struct(order, "start", F.upper("hit").alias("hit")))).alias("_hits"))
    kind = queries.schema[ident].dataType.simpleString()
    x = queries.filter(F.length(seq) > 0).select(ident, F.upper(seq).alias("_own")).join(laid, ident, "left")
    x = x.select(ident, "_own", F.transform("_hits", lambda h: h["start"].cast("long")).alias("_starts"), F.transform("_hits", lambda h: h["hit"]).alias("_texts"))
    symbols = lambda text: np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shown = []
            for own, starts, texts in zip(*[b.column(k).to_pylist() for k in (1, 2, 3)], strict=True):
                base = symbols(own)
                top = base.copy()
                for start, text in zip(starts or [], texts or [], strict=True):
                    if start is None or text is None:
                        continue
                    hit = symbols(text)[max(-start, 0) :]
                    at = max(start, 0)
                    hit = hit[: max(len(top) - at, 0)]
                    top[at : at + len(hit)] = hit
                differs = np.flatnonzero(top != base)
                line = list(top.tobytes().decode("utf-32-le"))
                for k in differs:
                    line[k] = line[k].lower()
                shown.append("".join(line))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shown, pa.string())], [ident, "shown"])

    return x.mapInArrow(show, f"`{ident}` {kind}, shown string")
