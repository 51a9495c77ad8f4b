"""Mixing overlapping sources to target weights by a min-cost flow over membership patterns.

Documents that belong to the same set of sources are one node of the flow with their words as its
capacity; a source is a node that wants its target. A second and a third use of the same words cost
more each time (a convex cost), so that repetition is spread as thinly as the targets allow. Only
the patterns, whose number is bounded, reach the driver. The flow out of a pattern is turned into
documents by their seeded hash: cutting the pattern's documents, in the order of the hash, at a sum
of words is cutting at a hash, which is found digit by digit from sums, without sorting documents.
"""

from __future__ import annotations

import heapq
import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeflow.llm.common import WORD, cut

#: More distinct sets of sources than this are refused, as the flow is solved in one place.
MAX_PATTERNS = 10_000
#: Bits of a hash that are fixed at a time; a hash has 63.
BITS = 9
#: Documents at most that are looked at one by one to place a cut.
FINE = 2_000


def words(text: str = "text") -> Column:
    """Number of words of a text; none in a null."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_order(source: str | None) -> tuple[bool, bytes]:
    """Sources by code point, null last."""
    return source is None, (source or "").encode("utf-8", "surrogatepass")


def fill_targets(sizes: dict, weights: dict, most: float) -> dict:
    """Share the sum of ``sizes`` out by weight; none gets more than ``most`` times its size, what
    lies above that goes to the others by weight, again and again until none is above."""
    left, free, out = float(sum(sizes.values())), sorted(sizes, key=source_order), {}
    while free:
        level = left / sum(weights[s] for s in free)
        full = [s for s in free if weights[s] * level > most * sizes[s]]
        if not full:
            return out | {s: weights[s] * level for s in free}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def min_cost_flow(capacity: list[int], members: list[tuple], wanted: dict, costs: list[int]) -> list[dict]:
    """Words that each pattern gives each of its sources.

    ``costs`` has the price of a word's first, second, ... use, which mustn't fall. The flow is as
    large as can be, and of these the cheapest: shortest augmenting paths with potentials, from
    patterns (an arc for each use) over their sources to what is still wanted.
    """
    flow = [dict.fromkeys(m, 0) for m in members]
    used = [0] * len(capacity)
    need = dict(wanted)
    takers = {s: [p for p, m in enumerate(members) if s in m] for s in wanted}

    def price(p: int) -> int | None:
        tier = used[p] // capacity[p] if capacity[p] else len(costs)
        return costs[tier] if tier < len(costs) else None

    while True:
        # Cheapest way to a source in need: out of a pattern, then over sources whose words may be moved.
        best: dict = {}
        queue: list = []
        order = itertools.count()
        for p, m in enumerate(members):
            if (c := price(p)) is not None:
                for s in m:
                    if s in need:
                        heapq.heappush(queue, (c, next(order), s, ((None, p, s),)))
        found = None
        while queue:
            c, _, s, way = heapq.heappop(queue)
            if s in best:
                continue
            best[s] = c
            if need[s] > 0:
                found = way
                break
            for p in takers[s]:  # s has enough: it may give up what it takes of p, for another member of p
                if flow[p][s] > 0:
                    for t in members[p]:
                        if t not in best and t in need:
                            heapq.heappush(queue, (c, next(order), t, (*way, (s, p, t))))
        if not found:
            return flow
        start, end = found[0][1], found[-1][2]
        amount = min([need[end], capacity[start] - used[start] % capacity[start], *(flow[p][s] for s, p, _ in found[1:])])
        used[start] += amount
        need[end] -= amount
        for s, p, t in found:
            if s is not None:
                flow[p][s] -= amount
            flow[p][t] += amount


def _apart(members: list[tuple]) -> list[list[int]]:
    """Patterns in groups that share no source with each other."""
    of: dict = {}

    def top(s):
        while of[s] != s:
            of[s] = of[of[s]]
            s = of[s]
        return s

    for m in members:
        for s in m:
            of.setdefault(s, s)
            of[top(s)] = top(m[0])
    groups: dict = {}
    for p, m in enumerate(members):
        groups.setdefault(top(m[0]), []).append(p)
    return list(groups.values())


@dataclass
class Mix:
    """``docs``: the documents with size, source_size, target, copies and assigned; ``targets`` and
    ``sizes`` by source."""

    docs: DataFrame
    targets: dict
    sizes: dict


def _hash(id_col: str, text_col: str, seed: int) -> Column:
    """63 bits by which the documents of a pattern are put in a seeded order."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), 1)


def _running(base: DataFrame, cuts: list[tuple], bits: int, value: str) -> DataFrame:
    """(cut, rest, value, size, n, before): sums by value of what lies in a cut's prefix, and what comes before each.

    A cut has at most ``2 ** BITS`` values, or ``FINE`` documents, so that its window is small.
    """
    at = base.sparkSession.createDataFrame(cuts, "cut int, cut_pattern int, prefix long, shift int, rest long")
    inside = base.join(F.broadcast(at), (F.col("pattern") == F.col("cut_pattern")) & (F.expr(f"shiftrightunsigned(h, shift + {bits})") == F.col("prefix")))
    sums = inside.groupBy("cut", "rest", F.expr(value).alias("value")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    earlier = Window.partitionBy("cut").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))


def _cut_points(base: DataFrame, wanted: list[tuple[int, int]]) -> list[int]:
    """For each (pattern, words): the hash below which the pattern's documents hold about so many words.

    A few bits of the hash are fixed at a time: sums by their next values, for the one value that
    each cut falls into, until few documents are left, which are then taken one by one. A round
    brings one row of each cut to the driver.
    """
    todo = {k: (p, 0, 63 - BITS, left) for k, (p, left) in enumerate(wanted)}
    points: dict[int, int] = {}
    while todo:
        cuts = [(k, *x) for k, x in todo.items()]
        points |= {k: (prefix + 1) << (shift + BITS) for k, _, prefix, shift, _ in cuts}
        # no more rows than cuts: running sums pass what is left once
        fallen = _running(base, cuts, BITS, "shiftrightunsigned(h, shift)").filter("before <= rest AND rest < before + size").collect()
        now, todo, fine = todo, {}, []
        for r in fallen:
            p, _, shift, left = now[r.cut]
            left -= r.before
            if shift == 0 or r.n <= 1:
                points[r.cut] = (r.value + (2 * left >= r["size"])) << shift
            elif r.n <= FINE:
                fine.append((r.cut, p, r.value, shift, left))
            else:
                todo[r.cut] = (p, r.value, shift - BITS, left)
        if fine:
            points |= {k: (value + 1) << shift for k, _, value, shift, _ in fine}
            first = _running(base, fine, 0, "h").filter("2 * (rest - before) < size").groupBy("cut").agg(F.min("value").alias("h"))
            points |= {r.cut: r.h for r in first.collect()}
    return [min(points[k], (1 << 63) - 1) for k in range(len(wanted))]


def mix(docs: DataFrame, sources: Column, weights: dict | None = None, most: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> Mix:
    """Choose how often each document is taken, so that each source's words come near its target.

    ``sources``: an array of the sources that a document belongs to (nulls count as a source of their
    own). Weights by source; by default they weigh 1, 2, 3, 1, 2, 3, ... by code point, null last.
    Targets share out all words, and stop at ``most`` times a source's words (fill_targets). No
    document is taken more than ``most`` times.

    The documents come back with size (words), source_size and target (sums over the document's
    sources), copies (times taken) and assigned (the source of each copy). Two small passes over a
    checkpoint of (pattern, hash, size) find the cuts; the documents themselves aren't shuffled.

    Defined results: null and empty texts have size 0; ids may be null or repeat, and equal rows share
    one fate; a document without sources is never taken; an empty table stays empty. Columns named
    like those that are added are replaced; others stay. More than ``MAX_PATTERNS`` sets of sources
    raise ``ValueError``.
    """
    spark = docs.sparkSession
    own = ["size", "source_size", "target", "copies", "assigned"]
    # sorted, each once; a null sorts last
    members = F.array_distinct(F.filter(sources, lambda s: s.isNotNull()))
    members = F.concat(F.array_sort(members), F.when(F.exists(sources, lambda s: s.isNull()), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>")))
    keyed = docs.select(members.alias("_members"), words(text_col).alias("_size"), _hash(id_col, text_col, seed).alias("_h"), *[F.col(c) for c in docs.columns if c not in own])
    narrow = cut(keyed.select(F.col("_members").alias("members"), F.col("_size").alias("size"), F.col("_h").alias("h")))
    found = narrow.groupBy("members").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sets of sources")
    patterns = sorted(((tuple(r.members), int(r["size"])) for r in found if r.members), key=lambda x: [source_order(s) for s in x[0]])
    sizes: dict = {}
    for m, size in patterns:
        for s in m:
            sizes[s] = sizes.get(s, 0) + size
    names = sorted(sizes, key=source_order)
    weights = {s: 1 + k % 3 for k, s in enumerate(names)} if weights is None else weights
    total = sum(size for _, size in patterns)
    targets = fill_targets(sizes, weights, most) if len(patterns) == len(sizes) else _overlapping_targets(sizes, weights, most, total)
    flow: list[dict] = [{} for _ in patterns]
    for some in _apart([m for m, _ in patterns]):  # patterns that share no source are flows of their own
        wanted = {s: round(targets[s]) for p in some for s in patterns[p][0]}
        for p, f in zip(some, min_cost_flow([patterns[p][1] for p in some], [patterns[p][0] for p in some], wanted, list(range(most))), strict=True):
            flow[p] = f

    # A pattern's documents are one line, run over again for each use; its sources take stretches of it.
    stretches: list[tuple] = []
    ends: list[tuple[int, int]] = []
    of_pattern: dict[int, list[tuple]] = {}
    for p, (m, size) in enumerate(patterns):
        at = 0
        for s in m:
            left = flow[p][s]
            while left > 0:
                step = min(left, size - at % size)
                stretches.append((p, s, at % size, at % size + step, size))
                of_pattern.setdefault(p, []).append(stretches[-1])
                at, left = at + step, left - step
    for p, _, a, b, size in stretches:
        ends += [(p, x) for x in (a, b) if 0 < x < size]
    ends = sorted(set(ends))
    hashed = spark.createDataFrame([(list(m), p) for p, (m, _) in enumerate(patterns)], T.StructType([T.StructField("m", T.ArrayType(T.StringType())), T.StructField("pattern", T.IntegerType())]))
    base = narrow.join(F.broadcast(hashed), F.col("members") == F.col("m")).select("pattern", "h", "size") if ends else None
    at = dict(zip(ends, _cut_points(base, ends), strict=True)) if ends else {}
    top = (1 << 63) - 1
    rows = []
    for p, (m, _) in enumerate(patterns):
        parts = [(0 if a == 0 else at[p, a], top if b == size else at[p, b], s) for _, s, a, b, size in of_pattern.get(p, [])]
        rows.append((list(m), sum(sizes[s] for s in m), float(sum(targets[s] for s in m)), parts))
    part = T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("source", T.StringType())])
    schema = T.StructType([T.StructField("_m", T.ArrayType(T.StringType())), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("_parts", T.ArrayType(part))])
    decided = keyed.join(F.broadcast(spark.createDataFrame(rows, schema)), F.col("_members") == F.col("_m"), "left")
    taken = F.transform(F.filter("_parts", lambda x: (F.col("_h") >= x["lo"]) & ((F.col("_h") < x["hi"]) | (x["hi"] == top))), lambda x: x["source"])
    out = decided.withColumn("assigned", F.coalesce(taken, F.array().cast("array<string>"))).withColumn("copies", F.size("assigned").cast("long"))
    keep = [F.col(c) for c in docs.columns if c not in own]
    return Mix(out.select(*keep, F.col("_size").alias("size"), "source_size", "target", "copies", "assigned"), targets, sizes)


def _overlapping_targets(sizes: dict, weights: dict, most: float, total: int) -> dict:
    """Shares of all words where sources overlap: a source's cap counts all that it shares."""
    filled = fill_targets(sizes, weights, most)
    scale = total / sum(sizes.values()) if sizes else 1.0
    return {s: t * scale for s, t in filled.items()}
