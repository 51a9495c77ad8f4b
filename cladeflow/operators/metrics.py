"""Benchmark pairs and metrics of classification; label 0 is the reject, -1 always wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.operators.tree import lowest_common, subtree_totals, with_info


def confusion(pairs: DataFrame, keys: list[str], test: str, pred: str) -> DataFrame:
    return pairs.groupBy(*keys, test, pred).agg(F.count("*").alias("cnt"))


def class_weights(conf: DataFrame, keys: list[str], test: str) -> DataFrame:
    """Rows of each test class, and the largest class over it as a weight."""
    n = conf.groupBy(*keys, test).agg(F.sum("cnt").alias("n"))
    top = F.max("n").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))
    return n.withColumn("weight", top / F.col("n"))


def weighted(conf: DataFrame, weights: DataFrame, keys: list[str], test: str) -> DataFrame:
    return conf.join(weights.select(*keys, test, "weight"), [*keys, test]).withColumn("w", F.col("cnt") * F.col("weight"))


def sensitivity(conf: DataFrame, keys: list[str], test: str, pred: str, value: str = "w") -> DataFrame:
    hit = F.sum(F.when(F.col(test) == F.col(pred), F.col(value)).otherwise(0))
    return conf.groupBy(*keys, test).agg((hit / F.sum(value)).alias("sens"))


def specificity(conf: DataFrame, keys: list[str], test: str, pred: str, value: str = "w") -> DataFrame:
    """Precision of each predicted class that has test rows; rejects and wrong-by-rule have none."""
    tested = conf.select(*keys, F.col(test).alias(pred)).distinct()
    hit = F.sum(F.when(F.col(test) == F.col(pred), F.col(value)).otherwise(0))
    return conf.filter(F.col(pred) > 0).join(tested, [*keys, pred], "left_semi").groupBy(*keys, pred).agg((hit / F.sum(value)).alias("spec"))


def accuracy(conf: DataFrame, keys: list[str], test: str, pred: str) -> DataFrame:
    hit = F.sum(F.when(F.col(test) == F.col(pred), F.col("cnt")).otherwise(0))
    return conf.groupBy(*keys).agg((hit / F.sum("cnt")).alias("acc"))


def macro(sens: DataFrame, spec: DataFrame, keys: list[str]) -> DataFrame:
    return sens.groupBy(*keys).agg(F.avg("sens").alias("sens")).join(spec.groupBy(*keys).agg(F.avg("spec").alias("spec")), keys, "full")


def balanced_confusion(conf: DataFrame, test: str, pred: str) -> DataFrame:
    """Each row of the confusion matrix scaled to the largest class, rounded."""
    n = F.sum("cnt").over(Window.partitionBy(test))
    x = conf.withColumn("_n", n)
    top = x.agg(F.max("_n").alias("_top"))
    return x.join(F.broadcast(top)).withColumn("balanced", F.floor(F.col("cnt") * F.col("_top") / F.col("_n") + 0.5)).drop("_n", "_top")


def summary(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, least and population deviation over classes that have a value."""
    return values.groupBy(*keys).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.stddev_pop(value).alias("sd"))


def abundance(rows: DataFrame, sample: str, clade: str, weight: str, least: float, samples: list) -> DataFrame:
    """A column of weights for each sample, for clades whose weight in some sample is ``least`` or more."""
    sums = rows.groupBy(sample, clade).agg(F.sum(weight).alias("_w"))
    big = sums.groupBy(clade).agg(F.max("_w").alias("_m")).filter(F.col("_m") >= least).select(clade)
    return sums.join(big, clade, "left_semi").groupBy(clade).pivot(sample, samples).agg(F.sum("_w")).na.fill(0)


def benchmark_pairs(scores: DataFrame, truth: DataFrame, models: DataFrame, nodes: DataFrame, pairs: DataFrame, levels: dict[str, int]) -> DataFrame:
    """(sample, lev_exc, lev_pred, test, pred, truth, best, model, score, n_models): what is predicted where all
    models near the truth are left out, for each level up to which they are.

    ``scores`` (sample, model, score), ``truth`` (sample, node), ``models`` (model, node, leaf); ``levels`` are ranks from the
    bottom up, the last of which is never left out. Only models of which ``leaf`` holds take part, and samples whose
    node has such a model. For each level at which the truth has a node, the best model is taken that isn't under that
    node nor in the truth's own lineage (ties to the smaller model), and a row given for each higher level of the truth: its node
    there, and that of the model's node, -1 where it has none. ``n_models`` counts the nodes with a
    model that the truth's next level has besides what is left out; without one there is no row. Level 0
    leaves nothing out; it has rows for all levels and one, of level 0, for the nodes themselves.

    A model is out of a zone if its branch leaves the truth's lineage above it, so that a sample's models
    are first reduced to the best of each branch, and each zone takes the best of the branches above.
    """
    usable = models.filter("leaf").select("model", F.col("node").alias("best"))
    placed = usable.select(F.col("best").alias("id")).distinct()
    held = subtree_totals(pairs, placed.withColumn("_one", F.lit(1)), "_one").withColumnRenamed("total", "held")
    ranked = with_info(pairs, nodes, "rank").withColumn("level", F.coalesce(*[F.when(F.col("anc_rank") == k, v) for k, v in levels.items()])).filter("level IS NOT NULL")
    fixed = ranked.groupBy("id", "level").agg(F.min_by("anc_id", "dist").alias("at"), F.min("dist").alias("dist"))
    lineage = fixed.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("level", "at"))).alias("lineage"))

    # zones of a node: level, steps up to it, and nodes with models that the next level has besides
    steps = fixed.join(placed, "id", "left_semi").join(held.select(F.col("id").alias("at"), "held"), "at")
    steps = steps.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("level", "dist", "held"))).alias("_z"))
    zones = F.transform("_z", lambda z, i: F.struct(z["level"].alias("level"), z["dist"].alias("dist"), (F.get("_z", i + 1)["held"] - z["held"]).alias("n_models")))
    zones = F.filter(zones, lambda z: (z["level"] < max(levels.values())) & (z["n_models"] >= 1))
    none = F.struct(F.lit(0).alias("level"), F.lit(-1).alias("dist"), F.col("held").alias("n_models"))
    steps = placed.join(steps, "id", "left").join(held, "id").select("id", F.concat(F.array(none), F.coalesce(zones, F.array().cast("array<struct<level:int,dist:int,n_models:bigint>>"))).alias("zones"))

    # the best model of each branch of each sample
    x = scores.join(usable, "model").join(truth.select("sample", F.col("node").alias("truth")), "sample").join(placed.select(F.col("id").alias("truth")), "truth", "left_semi")
    met = lowest_common(pairs, x.select("truth", "best").distinct(), "truth", "best").select("truth", "best", "dist_a", "dist_b")
    x = x.join(met, ["truth", "best"])
    one = F.struct((-F.col("score")).alias("minus"), F.col("model"), F.col("best"))
    branches = x.groupBy("sample", "truth", "dist_a").agg(F.min(one).alias("any"), F.min(F.when(F.col("dist_b") > 0, one)).alias("off"))
    gathered = branches.groupBy("sample", "truth").agg(F.collect_list(F.struct("dist_a", "any", "off")).alias("_b"))

    y = gathered.join(steps.withColumnRenamed("id", "truth"), "truth").select("sample", "truth", "_b", F.explode("zones").alias("_zone"))
    above = F.array_min(F.transform(F.filter("_b", lambda b: b["dist_a"] > F.col("_zone.dist")), lambda b: b["off"]))
    won = F.when(F.col("_zone.level") == 0, F.array_min(F.transform("_b", lambda b: b["any"]))).otherwise(above)
    y = y.withColumn("_won", won).filter("_won IS NOT NULL")
    y = y.select("sample", "truth", F.col("_zone.level").alias("lev_exc"), F.col("_zone.n_models").alias("n_models"), F.col("_won.best").alias("best"), F.col("_won.model").alias("model"), (-F.col("_won.minus")).alias("score"))
    y = y.join(lineage.select(F.col("id").alias("truth"), F.col("lineage").alias("_of_truth")), "truth", "left").join(lineage.select(F.col("id").alias("best"), F.col("lineage").alias("_of_best")), "best", "left")
    of = F.coalesce("_of_truth", F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<bigint>")))
    told = F.transform(F.filter(F.map_entries(of), lambda e: e["key"] > F.col("lev_exc")), lambda e: F.struct(e["key"].alias("lev_pred"), e["value"].cast("long").alias("test"), F.coalesce(F.element_at("_of_best", e["key"]).cast("long"), F.lit(-1).cast("long")).alias("pred")))
    itself = F.array(F.struct(F.lit(0).alias("lev_pred"), F.col("truth").cast("long").alias("test"), F.col("best").cast("long").alias("pred")))
    y = y.withColumn("_r", F.explode(F.when(F.col("lev_exc") == 0, F.concat(itself, told)).otherwise(told)))
    return y.select("sample", "lev_exc", "_r.lev_pred", "_r.test", "_r.pred", "truth", "best", "model", "score", "n_models")
