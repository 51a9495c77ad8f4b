"""Samples and test splits that are chosen along a tree, level by level from below.

Each level is one job and its results are written once, so that the jobs are as many as the tree is deep.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.functions.columns import seeded
from cladeflow.operators.common import cut, first_by
from cladeflow.operators.tree import depths, subtree_totals, under


def representatives_up(nodes: DataFrame, depth: DataFrame, items: DataFrame, seed: int, cap: int) -> DataFrame:
    """(id, source, item, status): for each node a sample of the items below it.

    A leaf has all its own ``items`` (id, item). Any other node has as many of each child's items, and of its own, as
    the median over those lists that aren't empty (rounded down), ``cap`` at most; fewer where a list is
    shorter. ``source`` is the child, or the node itself. Status says what a model of the node would be
    trained on: "direct" where it has own items, "indirect" where two lists or more met, else null.

    Lists are only cut where they meet, in the order of a hash of item and node, so that a long list
    is cut down to ``cap`` in each task before it is shuffled.
    """
    inner = nodes.select(F.col("idpar").alias("id")).distinct().withColumn("_inner", F.lit(True))
    tree = cut(nodes.select("id", "idpar").join(depth, "id").join(inner, "id", "left"))
    own = items.join(tree, "id").select("id", "idpar", "depth", "_inner", F.col("id").alias("source"), "item")
    own = cut(own)
    level = own.agg(F.max("depth")).first()[0]
    if level is None:
        return items.select("id", F.col("id").alias("source"), "item", F.lit(None).cast("string").alias("status"))
    out, below = [], None
    while level >= 0:
        lists = own.filter(F.col("depth") == level).select("id", "idpar", "_inner", "source", "item")
        if below is not None:
            here = tree.filter(F.col("depth") == level).select("id", "idpar", "_inner")
            lists = lists.union(below.select(F.col("idpar").alias("id"), F.col("id").alias("source"), "item").join(here, "id").select(*lists.columns))
        sizes = lists.groupBy("id", "source").agg(F.count("*").alias("n"))
        many = F.least(F.floor(F.percentile("n", 0.5)), F.lit(cap))
        status = F.when(F.bool_or(F.col("source") == F.col("id")), "direct").when(F.count("*") >= 2, "indirect")
        met = sizes.groupBy("id").agg(many.alias("_many"), status.alias("status"))
        order = [seeded(F.concat(F.col("item").cast("string"), F.lit("-"), F.col("id").cast("string")), seed), F.col("item")]
        cut_down = first_by(lists.filter("_inner"), ["id", "source"], order, cap).join(met, "id")
        cut_down = first_by_column(cut_down, ["id", "source"], order, "_many").drop("_many")
        whole = lists.filter("_inner IS NULL").withColumn("status", F.lit("direct"))
        below = cut(cut_down.unionByName(whole).select("id", "idpar", "source", "item", "status"))
        out.append(below.select("id", "source", "item", "status"))
        level -= 1
    return reduce(lambda a, b: a.union(b), out)


def first_by_column(df: DataFrame, keys: list[str], order: list, most: str) -> DataFrame:
    """The first rows of each key, as many as a column says."""
    at = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_at", F.row_number().over(at)).filter(F.col("_at") <= F.col(most)).drop("_at")


def test_split(nodes: DataFrame, pairs: DataFrame, counts: DataFrame, terminal: Column, unclassified: Column, min_train: Column, min_test: Column, ratio: Column, seed: int) -> DataFrame:
    """(id, total, n_test, n_train, is_test, has_test, is_terminal): which subtrees test a classifier of the tree's nodes, and
    how many samples that leaves to train on.

    ``counts`` (id, n) are samples at nodes, the other arguments columns of ``nodes``. A terminal goes to one
    side with all that is below it. From the lowest level up, each node that isn't below a terminal or
    an unclassified node sums up what its children have; its target is the share ``ratio`` of
    the samples that no unclassified child holds, so that ``min_train`` stay, and ``min_test`` at least. Terminal children
    are added in seeded order wherever one fits into what is left of the target and leaves enough to
    train; where that gives less than ``min_test``, the smallest left is added, if it then suffices. A
    child that has no test samples and too few to train counts as a terminal. An unclassified child isn't
    trained on where its parent has test samples, as it may be one of them.

    The children of one node are put in order in one row (as many as a taxonomy's node has, not the samples).
    """
    flags = nodes.select("id", "idpar", terminal.alias("_term"), unclassified.alias("_unclass"), min_train.cast("long").alias("_min_train"), min_test.cast("long").alias("_min_test"), ratio.cast("double").alias("_ratio"))
    flags = flags.fillna(False, ["_term", "_unclass"]).join(depths(pairs), "id").join(subtree_totals(pairs, counts.withColumnRenamed("n", "_n"), "_n"), "id", "left")
    flags = flags.withColumn("total", F.coalesce("total", F.lit(0)).cast("long"))
    below_unclass = under(pairs, flags.filter("_unclass").select("id")).withColumn("_lost", F.lit(True))
    # terminals are never the root itself; nodes at or below one are not looked into
    below_term = under(pairs, flags.filter("_term AND depth > 0").select("id")).withColumn("_closed", F.lit(True))
    loose = flags.filter("_unclass").groupBy(F.col("idpar").alias("id")).agg(F.sum("total").alias("_loose"))
    tree = flags.join(below_unclass, "id", "left").join(below_term, "id", "left").join(loose, "id", "left").fillna(False, ["_lost", "_closed"])
    held = F.col("total") - F.coalesce("_loose", F.lit(0))
    target = F.greatest(F.least(F.round(held * F.col("_ratio")).cast("long"), held - F.col("_min_train")), F.col("_min_test"))
    tree = cut(tree.withColumn("_target", target).withColumn("_open", ~F.col("_closed") & ~F.col("_lost") & (F.col("total") > 0)))
    most = tree.agg(F.max("depth")).first()[0]
    child = "struct<h:string,id:long,total:long>"
    state = "struct<left:long,test:long,train:long,picked:array<long>>"
    done, picked, below = [], [], None
    zero = F.lit(0).cast("long")
    for d in range(most if most is not None else -1, -1, -1):
        here = tree.filter((F.col("depth") == d) & F.col("_open"))
        given = tree.filter((F.col("depth") == d + 1) & F.col("_term") & ~F.col("_lost") & (F.col("total") > 0)).select("id", "idpar", "total", F.lit(True).alias("_is_term"), zero.alias("n_test"), F.col("total").alias("n_train"))
        kids = given if below is None else given.union(below.select("id", "idpar", "total", "_is_term", "n_test", "n_train"))
        one = F.struct(seeded("id", seed).alias("h"), F.col("id").cast("long").alias("id"), "total")
        terms = F.array_sort(F.filter(F.collect_list(F.when(F.col("_is_term"), one)), lambda x: x.isNotNull())).cast(f"array<{child}>")
        sums = kids.groupBy(F.col("idpar").alias("id")).agg(F.sum("n_test").alias("_test"), F.sum("n_train").alias("_train"), terms.alias("_kids"))
        x = here.join(sums, "id", "left").withColumn("_test", F.coalesce("_test", zero)).withColumn("_train", F.coalesce("_train", zero)).withColumn("_kids", F.coalesce("_kids", F.array().cast(f"array<{child}>")))
        start = F.struct((F.col("_target") - F.col("_test")).alias("left"), F.col("_test").alias("test"), F.col("_train").alias("train"), F.array().cast("array<long>").alias("picked")).cast(state)

        def added(s: Column, c: Column) -> Column:
            return F.struct((s["left"] - c["total"]).alias("left"), (s["test"] + c["total"]).alias("test"), (s["train"] - c["total"]).alias("train"), F.concat(s["picked"], F.array(c["id"])).alias("picked")).cast(state)

        fits = lambda s, c: (c["total"] <= s["left"]) & (s["train"] - c["total"] >= F.col("_min_train"))
        x = x.withColumn("_s", F.aggregate("_kids", start, lambda s, c: F.when(fits(s, c), added(s, c)).otherwise(s)))
        s = F.col("_s")
        rest = F.filter("_kids", lambda c: ~F.array_contains(F.col("_s")["picked"], c["id"]))
        x = x.withColumn("_next", F.array_min(F.transform(rest, lambda c: F.struct(c["total"].alias("total"), c["h"].alias("h"), c["id"].alias("id")))))
        n = F.col("_next")
        fill = (s["test"] < F.col("_min_test")) & (s["test"] + n["total"] >= F.col("_min_test")) & (s["train"] - n["total"] >= F.col("_min_train"))
        room = F.col("_target") - F.col("_test") > 0
        x = x.withColumn("_s", F.when(~room, start).when(fill, added(s, n)).otherwise(s))
        got = x.select("id", "idpar", "total", "_min_train", "_min_test", F.col("_s.test").alias("n_test"), F.when(F.col("_s.test") == 0, F.col("total")).otherwise(F.col("_s.train")).alias("n_train"), F.col("_s.picked").alias("_picked"))
        below = cut(got.withColumn("_is_term", (F.col("n_test") == 0) & (F.col("n_train") < F.col("_min_train"))))
        done.append(below.select("id", "n_test", "n_train", (F.col("n_test") >= F.col("_min_test")).alias("has_test"), "_is_term"))
        picked.append(below.select(F.explode("_picked").alias("id")))
    if not done:
        return tree.select("id", "total", zero.alias("n_test"), zero.alias("n_train"), F.lit(False).alias("is_test"), F.lit(False).alias("has_test"), F.lit(False).alias("is_terminal"))
    seen = cut(reduce(lambda a, b: a.union(b), done))
    tests = under(pairs, reduce(lambda a, b: a.union(b), picked)).withColumn("is_test", F.lit(True))
    # under an unclassified node samples train where the node above the topmost such has no test samples
    tops = tree.filter("_unclass").join(tree.filter("_lost").select(F.col("id").alias("idpar"), F.lit(True).alias("_deep")), "idpar", "left").filter("_deep IS NULL")
    tested = tops.join(seen.filter("n_test > 0").select(F.col("id").alias("idpar")), "idpar", "left_semi").select("id")
    barred = under(pairs, tested).withColumn("_barred", F.lit(True))
    given = tree.filter("_term AND NOT _lost AND total > 0 AND depth > 0").join(tree.filter("_open").select(F.col("id").alias("idpar")), "idpar", "left_semi")
    terminals = given.select("id").union(seen.filter("_is_term").select("id").join(tree.filter("depth > 0").select("id"), "id", "left_semi"))
    terminals = under(pairs, terminals).withColumn("is_terminal", F.lit(True))
    out = tree.select("id", "total").join(seen.drop("_is_term"), "id", "left").join(tests, "id", "left").join(barred, "id", "left").join(terminals, "id", "left")
    out = out.fillna(False, ["is_test", "has_test", "_barred", "is_terminal"])
    n_test = F.when(F.col("is_test"), F.col("total")).otherwise(F.coalesce("n_test", zero))
    n_train = F.when(F.col("is_test") | F.col("_barred"), zero).otherwise(F.coalesce("n_train", "total"))
    return out.select("id", "total", n_test.alias("n_test"), n_train.alias("n_train"), "is_test", (F.col("has_test") & ~F.col("is_test")).alias("has_test"), "is_terminal")
