"""Classifiers: parameter grids and scans, one-versus-rest decisions, cross-validation, confidence, components."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeflow.functions.columns import hash01, seeded
from cladeflow.operators.common import first_by, small, summed
from cladeflow.operators.models import folds, soft_decision

#: Sets of parameters that one scan tries at most, and labels that get a model of their own at most.
MAX_SETS, MAX_LABELS = 10_000, 10_000


def linear_scale(start: float, stop: float, step: float = 1) -> list[float]:
    """Values from ``start`` to below ``stop``."""
    return [start + k * step for k in range(max(0, -int(-(stop - start) // step)))]


def power_scale(base: float, start: int, stop: int, step: int = 1) -> list[float]:
    """Powers of ``base`` with exponents from ``start`` to below ``stop``."""
    return [float(base) ** k for k in range(start, stop, step)]


def scan(rows: DataFrame, grid: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """``grid`` (id and parameters, at most ``MAX_SETS`` rows) with a metric of all rows for each set: an
    aggregate over the rows' and the parameters' columns. All sets are tried in one pass over the rows,
    and what is shuffled is a partial sum for each set and task."""
    sets = grid.limit(MAX_SETS + 1).collect()
    if len(sets) > MAX_SETS:
        raise ValueError(f"more than {MAX_SETS} sets of parameters")
    if not sets:
        return grid.withColumns({k: F.lit(None).cast("double") for k in metrics})
    kinds = dict(grid.dtypes)
    tried = F.array(*[F.struct(*[F.lit(r[c]).cast(kinds[c]).alias(c) for c in grid.columns]) for r in sets])
    found = rows.withColumn("_set", F.explode(tried)).select(*rows.columns, "_set.*").groupBy("id").agg(*[m.alias(k) for k, m in metrics.items()])
    return grid.join(found, "id", "left")


def best_set(scanned: DataFrame, metric: str) -> DataFrame:
    """The set with the highest metric; of equals the first."""
    return scanned.orderBy(F.desc_nulls_last(metric), "id").limit(1)


def one_vs_rest(rows: DataFrame, asked: DataFrame, ident: str, features: str, label: str, least: int = 1, **svm) -> tuple[DataFrame, DataFrame]:
    """A linear model of each label with ``least`` rows or more against all others.

    Returns the decisions (id, label, y) on ``asked``, and (label, wf): half the square of each model's
    weights. A label without a model has no decisions.
    """
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector, vector_to_array

    counts = rows.groupBy(label).agg(F.count("*").alias("n")).filter(F.col("n") >= least).limit(MAX_LABELS + 1).collect()
    if len(counts) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    as_vector = array_to_vector(F.col(features).cast("array<double>")).alias("features")
    known = rows.select(F.col(label).alias("_true"), as_vector).persist()
    put = asked.select(ident, as_vector)
    parts, norms = [], []
    try:
        for v in sorted(r[0] for r in counts if r[0] is not None):
            model = LinearSVC(**svm).fit(known.withColumn("label", (F.col("_true") == v).cast("double")))
            parts.append(model.transform(put).select(ident, F.lit(v).alias(label), vector_to_array("rawPrediction")[1].alias("y")))
            norms.append((v, float(model.coefficients.dot(model.coefficients)) / 2))
    finally:
        known.unpersist()
    kind = dict(rows.dtypes)[label]
    norms = rows.sparkSession.createDataFrame(norms, f"{label} {kind}, wf double")
    if not parts:
        return asked.select(ident, F.lit(None).cast(kind).alias(label), F.lit(None).cast("double").alias("y")).limit(0), norms
    return reduce(lambda a, b: a.union(b), parts), norms


def reliability(decisions: DataFrame, truth: DataFrame, norms: DataFrame, ident: str, label: str, c: float = 1.0) -> DataFrame:
    """(label, srm): how far each label's model can be trusted, by the margins that its training rows keep:
    exp of -(wf + c * sum of max(0, 1 - l * y)) / (c * rows), l being 1 or -1."""
    x = decisions.join(truth.select(ident, F.col(label).alias("_true")), ident)
    lacks = F.greatest(F.lit(0.0), 1 - F.when(F.col("_true") == F.col(label), 1.0).otherwise(-1.0) * F.col("y"))
    sums = x.groupBy(label).agg(F.sum(lacks).alias("lack"), F.count("*").alias("n")).join(small(norms), label)
    return sums.select(label, F.exp(-(F.col("wf") + c * F.col("lack")) / (c * F.col("n"))).alias("srm"))


def classified(decisions: DataFrame, ident: str, label: str, thresholds: list[float], known: DataFrame | None = None, trust: DataFrame | None = None) -> DataFrame:
    """(id, threshold, pred) for each threshold: the label with the highest decision, the first of equals, or 0
    where that is below the threshold.

    ``known`` (label) masks labels that have no model; ``trust`` (label, srm) turns decisions into soft
    ones times that factor.
    """
    d = decisions if known is None else decisions.join(summed(known.select(label).distinct()), label, "left_semi")
    if trust is not None:
        d = d.join(summed(trust), label).withColumn("y", soft_decision(F.col("y")) * F.col("srm"))
    best = first_by(d.select(ident, label, "y"), [ident], [F.desc("y"), F.col(label)])
    each = best.withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    return each.select(ident, "threshold", F.when(F.col("y") >= F.col("threshold"), F.col(label)).otherwise(0).alias("pred"))


def cross_validated(rows: DataFrame, ident: str, n: int, seed: int, predict: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Each of ``n`` folds predicted by a model of the others: what ``predict`` (training rows, test rows) gives,
    all folds together, each row with its fold."""
    dealt = folds(rows, ident, n, seed).persist()
    try:
        parts = [predict(dealt.filter(F.col("fold") != k).drop("fold"), dealt.filter(F.col("fold") == k).drop("fold")).withColumn("fold", F.lit(k)) for k in range(n)]
    finally:
        dealt.unpersist()
    return reduce(lambda a, b: a.unionByName(b), parts)


def fit_confidence(pairs: DataFrame, correct: Column, score: Column, length: Column, level: Column, e: float = 4.0, iterations: int = 20) -> dict[str, float]:
    """Coefficients of ``models.confidence``, fitted on benchmark pairs: score per symbol, a root of the length,
    the level (90 counts as 115), and the first two multiplied."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    lev = F.when(level == 90, 115).otherwise(level).cast("double")
    x = pairs.select(correct.cast("double").alias("label"), (score / length).alias("s"), F.pow(length.cast("double"), F.lit(-1.0 / e)).alias("n"), lev.alias("lev"))
    x = x.withColumn("sn", F.col("s") * F.col("n")).na.drop()
    model = LogisticRegression(maxIter=iterations).fit(VectorAssembler(inputCols=["s", "n", "lev", "sn"], outputCol="features").transform(x))
    return {"b0": float(model.intercept), **{f"b{k + 1}": float(v) for k, v in enumerate(model.coefficients)}, "e": e}


def standardised(df: DataFrame, features: str) -> DataFrame:
    """Array columns centred and scaled to a deviation of one, place by place; a constant place becomes 0."""
    places = df.select(F.posexplode(F.col(features).cast("array<double>")).alias("_p", "_x")).groupBy("_p").agg(F.avg("_x").alias("m"), F.stddev_pop("_x").alias("d"))
    stats = places.agg(F.array_sort(F.collect_list(F.struct("_p", "m", "d"))).alias("_s"))
    scaled = F.zip_with(F.col(features).cast("array<double>"), "_s", lambda x, s: F.when(s["d"] > 0, (x - s["m"]) / s["d"]).otherwise(0.0))
    return df.join(F.broadcast(stats)).withColumn(features, scaled).drop("_s")


def null_features(df: DataFrame, ident: str, features: str, how: str, seed: int) -> DataFrame:
    """Features without what they tell: "shuffled", each row's values in an order by hash, or "random", numbers
    from 0 to below 1. Both follow from the seed."""
    keyed = lambda i: F.concat(F.col(ident).cast("string"), F.lit("-"), i.cast("string"))
    values = F.col(features).cast("array<double>")
    if how == "random":
        return df.withColumn(features, F.transform(values, lambda x, i: hash01(keyed(i), seed)))
    pairs = F.array_sort(F.transform(values, lambda x, i: F.struct(seeded(keyed(i), seed).alias("h"), x.alias("x"))))
    return df.withColumn(features, F.transform(pairs, lambda p: p["x"]))


def principal_components(df: DataFrame, features: str, k: int, to: str = "components", scale_before: bool = False, scale_after: bool = False) -> DataFrame:
    """Rows with their first ``k`` components (an array; signs are arbitrary)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = standardised(df, features) if scale_before else df
    x = x.withColumn("_v", array_to_vector(F.col(features).cast("array<double>")))
    x = PCA(k=k, inputCol="_v", outputCol="_p").fit(x).transform(x).withColumn(to, vector_to_array("_p")).drop("_v", "_p")
    return standardised(x, to) if scale_after else x
