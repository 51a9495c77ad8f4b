"""Composition models, predictions, voting, sampling plans."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.functions.columns import seeded
from cladeflow.operators.common import cut, first_by, in_seeded_order, summed
from cladeflow.operators.kmers import _codes, code_counts, code_of, coded
from cladeflow.operators.relational import status_of
from cladeflow.operators.tree import fill_lineage, fixed_lineage, level_rows, lowest_common, with_info

# Coefficients of the confidence model.
SCALE = {"b0": -0.5, "b1": 2.0, "b2": 1.5, "b3": 0.01, "b4": 0.8, "e": 4.0}


#: Models that a task scores at once, and contexts' symbols at most: a model's row of one length fits in memory.
MODEL_BLOCK, MAX_ORDER = 64, 10
#: Samples that one copy of a block of models serves at least and at most.
LEAST_SAMPLES, MOST_SAMPLES = 256, 20_000
#: What a symbol that a model has never seen gets.
UNSEEN = -1.3862943611198906


def train(seqs: DataFrame, model: str, seq: str, order: int = 3, least: int = 0) -> DataFrame:
    """A context model for each group of sequences: (model, context, next, logp) for contexts of 0 to
    ``order`` symbols, with one added to each count; groups shorter in sum than ``least`` are left out. All
    lengths of contexts are counted in one pass."""
    if least:
        big = seqs.groupBy(model).agg(F.sum(F.length(seq)).alias("_n")).filter(F.col("_n") >= least).select(model)
        seqs = seqs.join(summed(big), model, "left_semi")
    n = code_counts(seqs, model, seq, list(range(1, order + 2))).withColumn("_context", F.shiftright("code", 2))
    total = F.sum("n").over(Window.partitionBy(model, "k", "_context"))
    logp = F.log((F.col("n") + 1) / (total + 4))
    return n.select(model, coded(F.col("_context"), F.col("k") - 1).alias("context"), coded(F.col("code").bitwiseAND(F.lit(3)), F.lit(1)).alias("next"), logp.alias("logp"))


def score(samples: DataFrame, ident: str, seq: str, table: DataFrame, model: str, order: int = 3) -> DataFrame:
    """(id, model, score): the log-probability of each sample under each model. A null model is none.

    Each symbol behind ``order`` others is looked up by the longest end of them after which the model has
    seen it, down to no context; a symbol that it has never seen gets a quarter. What lengths the table
    has is up to it: one with the full length and the empty context only falls back from one to the other.

    A sample is one row of its different k-mers and their counts. Models come in blocks, of which each part of the
    samples gets a copy: a task reads a block's rows first and then lets samples pass by, so that it
    holds one block and one batch, and no k-mer of a sample meets a model as a row.
    """
    if order > MAX_ORDER:
        raise ValueError(f"contexts of more than {MAX_ORDER} symbols")
    table = cut(table.select(F.col(model).alias("_m"), F.length("context").alias("_level"), code_of(F.concat("context", "next")).alias("_code"), "logp").filter((F.col("_level") <= order) & F.col("_m").isNotNull()))
    blocks = -(-table.select("_m").distinct().count() // MODEL_BLOCK)
    n = samples.count()
    cores = samples.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(n // LEAST_SAMPLES, 2 * cores), n // MOST_SAMPLES)
    kind, of_model = samples.schema[ident].dataType.simpleString(), table.schema["_m"].dataType.simpleString()

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, codes, counts = [], [], []
            for row, text in enumerate(batch.column(1).cast(pa.binary())):
                for _, found, n in _codes(text.as_py() or b"", [order + 1], False):
                    if len(found):
                        at.append(row)
                        codes.append(found)
                        counts.append(n)
            if at:
                offsets = pa.array(np.cumsum([0, *map(len, codes)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(np.int64))) for x in (codes, counts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *lists], ["_id", "_codes", "_n"])

    found = samples.select(F.col(ident).alias("_id"), seq).mapInArrow(sparse, f"_id {kind}, _codes array<long>, _n array<long>")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    none = lambda t: F.lit(None).cast(t)
    # long samples come in several rows, which need not meet
    part = F.pmod(F.xxhash64("_id", F.get("_codes", F.lit(0)), F.size("_codes")), F.lit(parts)).cast("int")
    of_samples = found.select(part.alias("_part"), each(blocks).alias("_block"), F.lit(1).alias("_kind"), "_id", none(of_model).alias("_m"), none("int").alias("_level"), "_codes", "_n", none("array<double>").alias("_logp"))
    items = F.array_sort(F.collect_list(F.struct("_code", "logp")))
    levels = table.groupBy("_m", "_level").agg(items.alias("_x"))
    of_models = levels.select(each(parts).alias("_part"), F.pmod(F.xxhash64("_m"), F.lit(max(blocks, 1))).cast("int").alias("_block"), F.lit(0).alias("_kind"), none(kind).alias("_id"), "_m", "_level", F.transform("_x", lambda x: x["_code"]).alias("_codes"), none("array<long>").alias("_n"), F.transform("_x", lambda x: x["logp"]).alias("_logp"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        place = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)])
            edges = np.flatnonzero(np.any(keys[:, 1:] != keys[:, :-1], axis=0)) + 1
            for lo, hi in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if hi == lo:
                    continue
                run = batch.slice(lo, hi - lo)
                if place != (keys[0, lo], keys[1, lo]):
                    place, known = (keys[0, lo], keys[1, lo]), {}
                if keys[2, lo] == 0:
                    for m, level, codes, logp in zip(run.column(4).to_pylist(), run.column(5).to_pylist(), run.column(6), run.column(8), strict=True):
                        known.setdefault(m, {})[level] = (codes.values.to_numpy(), logp.values.to_numpy())
                    continue
                lists = run.column(6)
                starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
                codes, n = lists.flatten().to_numpy(), run.column(7).flatten().to_numpy()
                unique, back = np.unique(codes, return_inverse=True)
                names = sorted(known)
                values = np.empty((len(names), hi - lo))
                for j, m in enumerate(names):
                    logp = np.full(len(unique), UNSEEN)
                    for level in sorted(known[m]):
                        has, p = known[m][level]
                        ends = unique % 4 ** (level + 1)
                        at = np.minimum(np.searchsorted(has, ends), len(has) - 1)
                        logp = np.where(has[at] == ends, p[at], logp)
                    values[j] = np.add.reduceat(logp[back] * n, starts)
                rows, chosen = np.tile(np.arange(hi - lo), len(names)), np.repeat(np.arange(len(names)), hi - lo)
                yield pa.RecordBatch.from_arrays([run.column(3).take(pa.array(rows)), pa.array(names, batch.schema.field(4).type).take(pa.array(chosen)), pa.array(values.reshape(-1))], ["_id", "_m", "score"])

    met = of_models.unionByName(of_samples).repartition(parts * max(blocks, 1), "_part", "_block").sortWithinPartitions("_part", "_block", "_kind")
    out = met.mapInArrow(scored, f"_id {kind}, _m {of_model}, score double")
    return out.groupBy(F.col("_id").alias(ident), F.col("_m").alias(model)).agg(F.sum("score").alias("score"))


def best_of_shared(scores: DataFrame, sample: str, model: str, ids: DataFrame, score_id: str) -> DataFrame:
    """Models that share a score id give it the highest of their scores."""
    return scores.join(ids, model).groupBy(sample, score_id).agg(F.max("score").alias("score"))


def combined(a: DataFrame, b: DataFrame, sample: str) -> DataFrame:
    """Scores of two collections of models for the same samples; raises if the samples differ."""
    x, y = a.select(sample).distinct(), b.select(sample).distinct()
    if x.exceptAll(y).limit(1).count() or y.exceptAll(x).limit(1).count():
        raise ValueError("samples differ")
    return a.unionByName(b)


def predictions(scores: DataFrame, sample: str, model: str, meta: DataFrame) -> DataFrame:
    """The best model of each sample, ties to the first, with what is known of it."""
    return first_by(scores, [sample], [F.desc("score"), F.col(model)]).join(meta, model, "left")


def confidence(score: Column, length: Column, level: Column, c: dict = SCALE) -> Column:
    """Logistic of score per symbol, length and level; level 90 counts as 115."""
    s, n = score / length, F.pow(length.cast("double"), F.lit(-1.0 / c["e"]))
    lev = F.when(level == 90, 115).otherwise(level)
    x = c["b0"] + c["b1"] * s + c["b2"] * n + c["b3"] * lev + c["b4"] * s * n
    return 1 / (1 + F.exp(-x))


def two_best(scores: DataFrame, sample: str, label: str, value: str) -> DataFrame:
    """(sample, label, top, second) of each sample's two best decision values."""
    best = first_by(scores, [sample], [F.desc(value), F.col(label)], 2)
    items = F.sort_array(F.collect_list(F.struct(F.col(value), (-F.col(label)).alias("minus"))), asc=False)
    x = best.groupBy(sample).agg(items.alias("_b"))
    return x.select(sample, (-F.col("_b")[0]["minus"]).alias(label), F.col("_b")[0][value].alias("top"), F.get("_b", F.lit(1))[value].alias("second"))


def with_rejects(best: DataFrame, label: str, rule: str, t: float = 0.0) -> DataFrame:
    """Labels or 0 by a rule: "value" (top above t), "alone" (top > 0, second < 0), "margin" or "relative"."""
    top, second = F.col("top"), F.coalesce(F.col("second"), F.lit(0.0))
    ok = {"value": top > t, "alone": (top > 0) & (second < 0), "margin": top - second > t, "relative": (top - second) / F.abs(top) > t}[rule]
    return best.withColumn("pred", F.when(ok, F.col(label)).otherwise(0))


def soft_decision(y: Column) -> Column:
    return F.signum(y) * (1 - F.exp(-F.abs(y)))


def folds(df: DataFrame, ident: str, n: int, seed: int) -> DataFrame:
    """Folds of equal size to one row, in seeded order."""
    buckets = df.withColumn("_b", F.expr(f"conv(substring(md5(concat({ident}, ':{seed}')), 1, 3), 16, 10)").cast("int"))
    counts = buckets.groupBy("_b").agg(F.count("*").alias("_n"))
    start = counts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_b", "_start")
    at = F.row_number().over(Window.partitionBy("_b").orderBy(seeded(ident, seed), F.col(ident)))
    return buckets.join(F.broadcast(start), "_b").withColumn("fold", ((F.col("_start") + at - 1) % n).cast("int")).drop("_b", "_start")


def grid(spark, params: dict[str, list]) -> DataFrame:
    """All combinations of parameter values, numbered."""
    out = None
    for name, values in params.items():
        df = spark.createDataFrame([(v,) for v in values], [name])
        out = df if out is None else out.crossJoin(df)
    return out.withColumn("id", F.row_number().over(Window.orderBy(*params)) - 1)


def prediction_rows(preds: DataFrame, meta: DataFrame, nodes: DataFrame, pairs: DataFrame, levels: dict[str, int], ranks: list[str], least: int, given: DataFrame | None = None, mapped: DataFrame | None = None, c: dict = SCALE) -> DataFrame:
    """The full row of each prediction (id, len, idscore, score) of a sample of ``least`` symbols or more.

    ``meta`` (idscore, namescore, taxid) says what a score id stands for, ``mapped`` (taxid, to) replaces
    taxids by others, ``given`` (id, given) are weights, else a sample weighs its length. Returns id, len,
    taxid, name, rank, weight, idscore, namescore and, for each of ``ranks``, taxid_, name_ and score_: the
    node of the lineage, filled up and down over all ``levels`` (from the bottom; the last is the root's),
    and the confidence at that node's own level, 1 at the root. A taxid that is no node (0, a reject)
    keeps its row, with nulls.
    """
    x = preds.filter(F.col("len") >= least).join(meta, "idscore")
    if mapped is not None:
        x = x.join(mapped, "taxid", "left").withColumn("taxid", F.coalesce("to", "taxid")).drop("to")
    x = x.join(given, "id", "left") if given is not None else x.withColumn("given", F.lit(None))
    x = x.withColumn("weight", F.coalesce(F.col("given").cast("double"), F.col("len").cast("double")))
    info = nodes.select(F.col("id").alias("taxid"), "name", "rank")
    wide = fill_lineage(fixed_lineage(pairs, nodes, list(levels)), list(levels), "up-down")
    x = x.join(info, "taxid", "left").join(wide.select(F.col("id").alias("taxid"), *[F.col(r).alias(f"taxid_{r}") for r in ranks]), "taxid", "left")
    top = max(levels.values())
    out = ["id", "len", "taxid", "name", "rank", "weight", "idscore", "namescore"]
    for r in ranks:
        at = F.coalesce(*[F.when(F.col("_rank") == k, v) for k, v in levels.items()])
        x = x.join(info.select(F.col("taxid").alias(f"taxid_{r}"), F.col("name").alias(f"name_{r}"), F.col("rank").alias("_rank")), f"taxid_{r}", "left").withColumn("_level", at)
        sure = F.when(F.col("_level") == top, 1.0).otherwise(F.round(confidence(F.col("score"), F.col("len"), F.col("_level"), c), 2))
        x = x.withColumn(f"score_{r}", F.when(F.col("_level").isNotNull(), sure)).drop("_rank", "_level")
        out += [f"taxid_{r}", f"name_{r}", f"score_{r}"]
    return x.select(*out)


def taxonomy_report(ids: DataFrame, lookup: DataFrame, nodes: DataFrame, pairs: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """What a list of ids stands for: (status, id, ids, weight), the ids that found a node by each node above
    it, and those that did not by why (missing, zero, no node), with id 0."""
    found = status_of(ids, lookup, nodes, key, value, "id")
    sums = F.count("*").alias("ids"), F.sum(weight).alias("weight")
    lost = found.filter("status <> 'ok'").groupBy("status").agg(*sums).select("status", F.lit(0).cast("long").alias("id"), "ids", "weight")
    by = found.filter("status = 'ok'").groupBy(F.col(value).alias("id")).agg(*sums).join(pairs, "id").groupBy("anc_id").agg(F.sum("ids").alias("ids"), F.sum("weight").alias("weight"))
    return lost.union(by.select(F.lit("ok"), F.col("anc_id").cast("long"), "ids", "weight"))


def match_rates(couples: DataFrame, pairs: DataFrame, nodes: DataFrame, a: str, b: str, levels: dict[str, int], good: int) -> DataFrame:
    """(level, tested, matched, level_distance) of two predictions, for the couples in which b's level is at or
    below each level: they match where the common node's level is ``good`` or below, or is b itself; the
    distance is the mean step in levels from b to the common node. A node without a level has that of
    the nearest node above with one."""
    at = F.coalesce(*[F.when(F.col("anc_rank") == k, v) for k, v in levels.items()])
    own = with_info(pairs, nodes, "rank").withColumn("_level", at).filter("_level IS NOT NULL").groupBy("id").agg(F.min_by("_level", "dist").alias("_level"))
    of = lambda x, to: own.select(F.col("id").alias(x), F.col("_level").alias(to))
    x = lowest_common(pairs, couples, a, b).join(of(b, "level_b"), b).join(of("lcs", "level_lcs"), "lcs")
    x = x.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels.values()]))).filter(F.col("level_b") <= F.col("level"))
    hit = (F.col("level_lcs") <= good) | (F.col("dist_b") == 0)
    return x.groupBy("level").agg(F.count("*").alias("tested"), F.count_if(hit).alias("matched"), F.avg(F.col("level_lcs") - F.col("level_b")).alias("level_distance"))


def annotation_vote(hits: DataFrame, pairs: DataFrame, nodes: DataFrame, levels: dict[str, int], sample: str, node: str, weight: str, least: int = 4, least_here: int = 2, share: float = 0.75) -> DataFrame:
    """(sample, vote): each hit counts, with its weight, for its node and all above; from the lowest level
    up, the first node wins that has all hits, or, of ``least`` or more, ``least_here`` and the share.

    Hits are shuffled by sample before they are counted, as hardly two of a task are of one sample and node until then; ``pairs`` may
    be those of the nodes that hits can have, which are broadcast if they are few.
    """
    level = F.create_map(*[F.lit(x) for kv in levels.items() for x in kv])[F.col("level")]
    up = level_rows(pairs, nodes, list(levels)).groupBy(F.col("id").alias(node)).agg(F.collect_list(F.struct(level.alias("level"), F.col("clade").alias("vote"))).alias("_up"))
    parts = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = hits.select(sample, node, F.col(weight).alias("_w")).repartition(parts, sample).join(summed(up), node, "left")
    # a hit's first row, of no node, counts for the sample as a whole
    whole = F.array(F.struct(F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("vote")))
    x = x.select(sample, "_w", F.explode(F.concat(whole, F.coalesce("_up", F.array().cast(up.schema["_up"].dataType)))).alias("_x"))
    sums = x.groupBy(sample, F.col("_x.level").alias("level"), F.col("_x.vote").alias("vote")).agg(F.count("*").alias("here"), F.sum("_w").alias("weight"))
    of, all_of = Window.partitionBy(sample), F.col("level").isNull()
    named = sums.withColumn("hits", F.max(F.when(all_of, F.col("here"))).over(of)).withColumn("all_weight", F.max(F.when(all_of, F.col("weight"))).over(of))
    part = F.col("weight") / F.col("all_weight")
    ok = (F.col("here") == F.col("hits")) | ((F.col("hits") >= least) & (F.col("here") >= least_here) & (part >= share))
    won = named.filter(~all_of & ok).groupBy(sample).agg(F.min(F.struct("level", (-part).alias("part"), "vote")).alias("_m"))
    return won.select(sample, F.col("_m.vote").alias("vote"), F.col("_m.level").alias("level"))


def host_candidates(names: DataFrame, name: str, fillers: list[str]) -> DataFrame:
    """(name, words, host): what a virus name says of its host, by falling prefixes of the words before the
    first that contains phage or virus, a filler as the first word left out.

    What stands before phage in that word is a last word: itself and with the endings bacter, bacterium and
    bacteria; cyanophage gives cyanobacteria, bacteriophage and virophage give none.
    """
    words = F.filter(F.split(F.lower(name), r"\s+"), lambda w: w != "")
    words = F.when(F.get(words, F.lit(0)).isin(fillers), F.slice(words, F.lit(2), F.size(words))).otherwise(words)
    at = F.array_position(F.transform("_w", lambda w: w.contains("phage") | w.contains("virus")), True).cast("int")
    last = F.get("_w", F.col("_at") - 1)
    stem = F.when(last.contains("phage"), F.substring_index(last, "phage", 1)).otherwise("")
    ends = F.when(last == "cyanophage", F.array(F.lit("cyanobacteria"))).when(~F.col("_stem").isin("", "bacterio", "viro"), F.transform(F.array(*[F.lit(x) for x in ("", "bacter", "bacterium", "bacteria")]), lambda x: F.concat("_stem", x)))
    x = names.select(name, words.alias("_w")).filter(F.size("_w") > 0).withColumn("_at", at).withColumn("_stem", F.coalesce(stem, F.lit("")))
    x = x.select(name, F.when(F.col("_at") > 0, F.slice("_w", F.lit(1), F.col("_at") - 1)).otherwise(F.col("_w")).alias("_head"), F.coalesce(ends, F.array().cast("array<string>")).alias("_ends"))
    whole = F.transform("_ends", lambda e: F.struct((F.size("_head") + 1).alias("words"), F.concat_ws(" ", F.col("_head"), e).alias("host")))
    counts = F.when(F.size("_head") > 0, F.sequence(F.size("_head"), F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    short = F.transform(counts, lambda n: F.struct(n.alias("words"), F.array_join(F.slice("_head", F.lit(1), n), " ").alias("host")))
    return x.select(name, F.explode(F.concat(whole, short)).alias("_c")).select(name, "_c.words", "_c.host")


def picked_per_group(df: DataFrame, group: str, ident: str, n: int, seed: int) -> DataFrame:
    return first_by(df, [group], [seeded(ident, seed), F.col(ident)], n)


def train_flags(totals: DataFrame, min_train: int, min_test: int, ratio: float) -> DataFrame:
    """Nodes with enough samples to be trained on, and how many of them are for testing."""
    test = F.greatest(F.lit(min_test), F.floor(F.col("total") * ratio)).cast("long")
    return totals.withColumn("trainable", F.col("total") >= min_train + min_test).withColumn("test", F.when(F.col("total") >= min_train + min_test, test).otherwise(0))


def test_terminals(leaves: DataFrame, group: str, ident: str, n: str, target: str, seed: int) -> DataFrame:
    """Whole terminals that go to the test side: in seeded order while their sum stays within the group's
    target; where none fits, the smallest one."""
    x = in_seeded_order(leaves, group, ident, seed, F.col(n)).withColumn("_in", F.col("_run") <= F.col(target))
    sums = x.groupBy(F.col(group).alias("_group")).agg(F.bool_or("_in").alias("_some"), F.min(F.struct(n, ident)).alias("_least"))
    x = x.join(summed(sums), F.col(group).eqNullSafe(F.col("_group")))
    smallest = ~F.col("_some") & (F.col(f"_least.{ident}") == F.col(ident))
    return x.withColumn("is_test", F.col("_in") | smallest).select(*leaves.columns, "is_test")


def checked_counts(nodes: DataFrame, totals: DataFrame, own: DataFrame) -> DataFrame:
    """One row of counts: nodes with a total (id, total), those above their parent's total, and those without
    rows of their own (``own``: id) whose total isn't the sum of their children's. Both must be 0."""
    child = totals.join(nodes.select("id", "idpar"), "id").select(F.col("idpar").alias("id"), F.col("total").alias("_child"))
    met = totals.join(child, "id")
    sums = met.groupBy("id", "total").agg(F.sum("_child").alias("_sum"), F.count_if(F.col("_child") > F.col("total")).alias("_above"))
    sums = sums.join(own.select("id").distinct().withColumn("_own", F.lit(1)), "id", "left")
    bad = sums.agg(F.coalesce(F.sum("_above"), F.lit(0)).alias("above_parent"), F.count_if(F.col("_own").isNull() & (F.col("_sum") != F.col("total"))).alias("unlike_children"))
    return totals.agg(F.count("*").alias("nodes")).join(F.broadcast(bad))


def allocate_down(nodes: DataFrame, depth: DataFrame, root: int, amount: int, seed: int) -> DataFrame:
    """(id, amount): an amount split equally at each branch; what can't be split goes to the children
    that come first in seeded order."""
    tree = cut(nodes.select("id", "idpar").join(depth, "id"))
    most = tree.agg(F.max("depth")).first()[0]
    level = tree.filter(F.col("id") == root).select("id", F.lit(amount).cast("long").alias("amount"))
    out = level
    top = tree.filter(F.col("id") == root).first()
    if top is None:  # no tree, or not this root
        return out
    start = top.depth
    for d in range(start + 1, most + 1):
        below = tree.filter(F.col("depth") == d).join(level.select(F.col("id").alias("idpar"), "amount"), "idpar")
        of = Window.partitionBy("idpar")
        k, place = F.count("*").over(of), F.row_number().over(of.orderBy(seeded("id", seed), "id"))
        share = F.floor(F.col("amount") / k) + F.when(place <= F.col("amount") % k, 1).otherwise(0)
        level = cut(below.select("id", share.alias("amount")))
        out = out.union(level)
    return out
