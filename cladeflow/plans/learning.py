"""Registered queries: parameter scans, decisions, confidence, prediction rows and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.functions import columns as fn
from cladeflow.operators import learning as op
from cladeflow.operators import models, tree
from cladeflow.plans.files import scratch
from cladeflow.plans.registry import Tables, query
from cladeflow.plans.trees import CLOSURE, WIDE, both
from cladeflow.sources import readers, writers

DECISIONS = "d AS (SELECT vec_id, generate_subscripts(embedding, 1)::INT AS label, unnest(embedding)::DOUBLE * 10 AS y FROM embeddings)"


def decisions(t: Tables) -> DataFrame:
    """Each component of an embedding as the decision of a model for its place."""
    d = t.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "y"))
    return d.select("vec_id", (F.col("i") + 1).alias("label"), (F.col("y").cast("double") * 10).alias("y"))


def scales(t: Tables) -> DataFrame:
    """A linear scale over the quantities and a power scale up to the largest line number, crossed."""
    r = t.lineitem.agg(F.min("l_quantity"), F.max("l_quantity"), F.max("l_linenumber")).first()
    c = op.linear_scale(float(r[0] or 0), float(r[1] or 0), 7.0)
    g = [x for x in op.power_scale(2, 0, 16) if x <= (r[2] or 0)]
    return models.grid(t.spark, {"c": c, "g": g}).select("c", "g", F.col("id").cast("long").alias("id"))


GRID = """r AS (SELECT min(l_quantity) AS low, max(l_quantity) AS high, max(l_linenumber) AS most FROM lineitem),
    grid AS (SELECT c, g, row_number() OVER (ORDER BY c, g) - 1 AS id FROM (SELECT low + 7.0::DOUBLE * unnest(range(0, ceil((high - low) / 7)::BIGINT)) AS c FROM r), (SELECT pow(2, k)::DOUBLE AS g FROM r, range(0, 16) x(k) WHERE pow(2, k) <= most))"""


@query(f"WITH {GRID} SELECT c, g, id FROM grid")
def p18_parameter_grid(t: Tables) -> DataFrame:
    return scales(t)


@query(f"""WITH {GRID} SELECT id, c, g, count(*) FILTER (WHERE (l_quantity * g > c) = (l_returnflag = 'R')) AS hits, count(*) AS n FROM lineitem, grid GROUP BY 1, 2, 3""")
def p18_parameter_scan(t: Tables) -> DataFrame:
    right = (F.col("l_quantity") * F.col("g") > F.col("c")) == (F.col("l_returnflag") == "R")
    found = op.scan(t.lineitem.select("l_quantity", "l_returnflag"), scales(t), {"hits": F.count_if(right), "n": F.count(F.lit(1))})
    return found.select("id", "c", "g", "hits", "n")


@query(f"""WITH {GRID}, s AS (SELECT id, c, g, count(*) FILTER (WHERE (l_quantity * g > c) = (l_returnflag = 'R')) AS hits FROM lineitem, grid GROUP BY 1, 2, 3)
    SELECT id, c, g, hits FROM s ORDER BY hits DESC, id LIMIT 1""")
def p18_best_parameters(t: Tables) -> DataFrame:
    return op.best_set(p18_parameter_scan(t), "hits").select("id", "c", "g", "hits")


@query(f"""WITH {DECISIONS}, known AS (SELECT DISTINCT label + 1 AS label FROM embeddings), b AS (SELECT vec_id, d.label, y FROM d JOIN known ON d.label = known.label QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY y DESC, d.label) = 1)
    SELECT vec_id, threshold::DOUBLE AS threshold, CASE WHEN y >= threshold THEN label ELSE 0 END AS pred FROM b, (VALUES (0.5), (1.5), (2.5)) v(threshold)""")
def p12_thresholds(t: Tables) -> DataFrame:
    known = t.embeddings.select((F.col("label") + 1).alias("label")).distinct()
    return op.classified(decisions(t), "vec_id", "label", [0.5, 1.5, 2.5], known)


RELIABLE = f"""{DECISIONS}, truth AS (SELECT vec_id, label + 1 AS truth FROM embeddings), norms AS (SELECT label + 1 AS label, count(*)::DOUBLE / 100 AS wf FROM embeddings GROUP BY 1),
    trust AS (SELECT d.label, exp(-(any_value(wf) + 0.5 * sum(greatest(0, 1 - CASE WHEN truth = d.label THEN 1 ELSE -1 END * y))) / (0.5 * count(*))) AS srm FROM d JOIN truth USING (vec_id) JOIN norms ON d.label = norms.label GROUP BY 1)"""


def trust(t: Tables) -> DataFrame:
    own = t.embeddings.select("vec_id", (F.col("label") + 1).alias("label"))
    norms = own.groupBy("label").agg((F.count("*").cast("double") / 100).alias("wf"))
    return op.reliability(decisions(t), own, norms, "vec_id", "label", 0.5)


@query(f"WITH {RELIABLE} SELECT label, round(srm, 8) AS srm FROM trust")
def p13_reliability(t: Tables) -> DataFrame:
    return trust(t).select("label", F.round("srm", 8).alias("srm"))


@query()
def p12_one_vs_rest(t: Tables) -> DataFrame:
    """Linear one-versus-rest models on embeddings, soft decisions by reliability; models have no SQL form."""
    e = t.embeddings.select("vec_id", "embedding", "label")
    found, norms = op.one_vs_rest(e, e, "vec_id", "embedding", "label", least=5, maxIter=5, regParam=0.1)
    return op.classified(found, "vec_id", "label", [-1.0, 0.0], trust=op.reliability(found, e, norms, "vec_id", "label"))


@query()
def p17_cross_validation(t: Tables) -> DataFrame:
    """Each fold predicted by a linear model of the others, one metric pass over all; no SQL form."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    def predict(known: DataFrame, asked: DataFrame) -> DataFrame:
        fitted = LogisticRegression(maxIter=5, regParam=0.1).fit(known)
        return fitted.transform(asked).select("vec_id", F.col("label").alias("test"), F.col("prediction").alias("pred"))

    x = t.embeddings.select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    told = op.cross_validated(x, "vec_id", 3, 4, predict)
    return told.groupBy("fold").agg(F.count("*").alias("n"), F.avg((F.col("test") == F.col("pred")).cast("double")).alias("acc"))


@query()
def p8_fitted_confidence(t: Tables) -> DataFrame:
    """The coefficients of the confidence model, fitted on line items as benchmark pairs; no SQL form."""
    fitted = op.fit_confidence(t.lineitem, F.col("l_returnflag") == "R", F.col("l_extendedprice") / 1e5 * F.col("l_quantity"), F.col("l_quantity"), F.col("l_linenumber") * 10)
    return t.spark.createDataFrame(sorted(fitted.items()), "name string, value double")


@query()
def k18_pca(t: Tables) -> DataFrame:
    """Two principal components of scaled embeddings; signs are arbitrary, so that there is no SQL form."""
    x = op.principal_components(t.embeddings.select("vec_id", "embedding"), "embedding", 2, scale_before=True)
    return x.select("vec_id", F.abs(F.col("components")[0]).alias("p1"), F.abs(F.col("components")[1]).alias("p2"))


@query("""WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), s AS (SELECT i, avg(v) AS m, stddev_pop(v) AS d FROM x GROUP BY 1)
    SELECT vec_id, round(sum((v - m) / d * i), 4) AS checked FROM x JOIN s USING (i) WHERE d > 0 GROUP BY 1""")
def k18_scaled_features(t: Tables) -> DataFrame:
    x = op.standardised(t.embeddings.select("vec_id", "embedding"), "embedding")
    total = F.aggregate(F.transform("embedding", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return x.select("vec_id", F.round(total, 4).alias("checked"))


@query("""WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), o AS (SELECT vec_id, v, row_number() OVER (PARTITION BY vec_id ORDER BY md5(vec_id || '-' || i || ':11'), v) AS place FROM x)
    SELECT vec_id, round(sum(v * place), 5) AS checked FROM o GROUP BY 1""")
def k18_null_model(t: Tables) -> DataFrame:
    x = op.null_features(t.embeddings.select("vec_id", "embedding"), "vec_id", "embedding", "shuffled", 11)
    total = F.aggregate(F.transform("embedding", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return x.select("vec_id", F.round(total, 5).alias("checked"))


@query(f"""{CLOSURE}, {WIDE}, s AS (SELECT l_orderkey AS id, sum(l_quantity)::DOUBLE AS len, arg_max(l_suppkey, (l_extendedprice, -l_suppkey)) AS idscore, max(l_extendedprice)::DOUBLE AS score FROM lineitem GROUP BY 1 HAVING sum(l_quantity) >= 20),
    p AS (SELECT s.*, s_name AS namescore, CASE WHEN s_nationkey = 7 THEN 108 ELSE 100 + s_nationkey END AS taxid FROM s JOIN supplier ON idscore = s_suppkey),
    x AS (SELECT p.*, t.name, t.rank, coalesce(o_totalprice, len) AS weight, coalesce(w.nation, w.region) AS taxid_nation, coalesce(w.region) AS taxid_region FROM p JOIN tree t ON taxid = t.id JOIN wide w ON taxid = w.id LEFT JOIN orders o ON p.id = o_orderkey AND o_orderstatus = 'F')
    SELECT x.id, len, taxid, x.name, x.rank, weight, idscore, namescore, taxid_nation, n.name AS name_nation, round(1 / (1 + exp(-(-0.5 + 2 * score / len / 1000 + 1.5 * pow(len, -0.25) + 0.01 * CASE WHEN x.rank IS NULL THEN 40 ELSE 30 END + 0.8 * score / len / 1000 * pow(len, -0.25)))), 2) AS score_nation,
        taxid_region, r.name AS name_region, round(1 / (1 + exp(-(-0.5 + 2 * score / len / 1000 + 1.5 * pow(len, -0.25) + 0.01 * 40 + 0.8 * score / len / 1000 * pow(len, -0.25)))), 2) AS score_region
    FROM x LEFT JOIN tree n ON taxid_nation = n.id LEFT JOIN tree r ON taxid_region = r.id""")
def p9_full_rows(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    best = F.max(F.struct("l_extendedprice", (-F.col("l_suppkey")).alias("m"))).alias("b")
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_quantity").cast("double").alias("len"), best)
    s = s.select("id", "len", (-F.col("b.m")).alias("idscore"), (F.col("b.l_extendedprice") / 1000).alias("score"))
    meta = t.supplier.select(F.col("s_suppkey").alias("idscore"), F.col("s_name").alias("namescore"), (F.col("s_nationkey") + 100).cast("long").alias("taxid"))
    given = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("given"))
    mapped = t.nation.filter("n_nationkey = 7").select((F.col("n_nationkey") + 100).cast("long").alias("taxid"), (F.col("n_nationkey") + 101).cast("long").alias("to"))
    out = models.prediction_rows(s, meta, nodes, pairs, {"customer": 20, "nation": 30, "region": 40, "root": 100}, ["nation", "region"], 20, given, mapped)
    return out.withColumn("taxid", F.col("taxid").cast("int")).select("id", "len", "taxid", "name", "rank", "weight", "idscore", "namescore", "taxid_nation", "name_nation", "score_nation", "taxid_region", "name_region", "score_region")


@query(f"""{CLOSURE}, g AS (SELECT l_partkey AS gi, count(*) AS n FROM lineitem GROUP BY 1), l AS (SELECT s_suppkey * 3 AS gi, CASE WHEN s_suppkey % 5 = 0 THEN 0 WHEN s_suppkey % 7 = 0 THEN 999 ELSE 100 + s_nationkey END AS taxid FROM supplier),
    st AS (SELECT gi, n, l.taxid, CASE WHEN l.taxid IS NULL THEN 'missing' WHEN l.taxid = 0 THEN 'zero' WHEN t.id IS NULL THEN 'no node' ELSE 'ok' END AS status FROM g LEFT JOIN l USING (gi) LEFT JOIN tree t ON l.taxid = t.id)
    SELECT status, 0::BIGINT AS id, count(*) AS ids, sum(n)::BIGINT AS weight FROM st WHERE status <> 'ok' GROUP BY 1 UNION ALL SELECT 'ok', anc_id, count(*), sum(n)::BIGINT FROM st JOIN closure c ON taxid = c.id WHERE status = 'ok' GROUP BY 2""")
def p11_report_from_ids(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    ids = t.lineitem.groupBy(F.col("l_partkey").alias("gi")).agg(F.count("*").alias("n"))
    k = F.col("s_suppkey")
    lookup = t.supplier.select((k * 3).alias("gi"), F.when(k % 5 == 0, 0).when(k % 7 == 0, 999).otherwise(F.col("s_nationkey") + 100).cast("long").alias("taxid"))
    return models.taxonomy_report(ids, lookup, nodes, pairs, "gi", "taxid", "n")


ALLOCATED = """kids AS (SELECT id, idpar, count(*) OVER (PARTITION BY idpar) AS k, row_number() OVER (PARTITION BY idpar ORDER BY md5(id || ':3'), id) AS place FROM tree WHERE idpar <> 0),
    alloc AS (SELECT 1::BIGINT AS id, 10000::BIGINT AS amount UNION ALL SELECT kids.id, (alloc.amount // k + CASE WHEN place <= alloc.amount % k THEN 1 ELSE 0 END)::BIGINT FROM kids JOIN alloc ON kids.idpar = alloc.id)"""


@query(f"{CLOSURE}, {ALLOCATED} SELECT id, amount FROM alloc")
def p31_allocated_to_all(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    return models.allocate_down(nodes, tree.depths(pairs), 1, 10_000, 3)


SCORED = "scored AS (SELECT 1000 + o_custkey AS id, o_totalprice::DECIMAL(18,2) AS score FROM orders UNION ALL SELECT 100 + s_nationkey, s_acctbal::DECIMAL(18,2) FROM supplier WHERE s_nationkey % 4 = 0)"


@query(f"""{CLOSURE}, {SCORED}, own AS (SELECT id, sum(score) AS s, count(*) AS n FROM scored GROUP BY 1), blocked AS (SELECT c.id, min(dist) AS stop FROM closure c JOIN own o ON c.anc_id = o.id WHERE dist > 0 GROUP BY 1)
    SELECT anc_id AS id, sum(s)::DOUBLE / sum(n)::DOUBLE AS score, sum(n)::BIGINT AS n FROM own JOIN closure USING (id) LEFT JOIN blocked USING (id) WHERE stop IS NULL OR dist < stop GROUP BY 1""")
def t24_scores_with_fallback(t: Tables) -> DataFrame:
    given = t.orders.select((F.col("o_custkey") + 1000).alias("id"), F.col("o_totalprice").cast("decimal(18,2)").alias("score"))
    given = given.union(t.supplier.filter("s_nationkey % 4 = 0").select((F.col("s_nationkey") + 100).cast("long"), F.col("s_acctbal").cast("decimal(18,2)")))
    return tree.scores_with_fallback(both(t)[1], given).select("id", "score", "n")


@query(f"""{CLOSURE}, lev AS (SELECT id, CASE rank WHEN 'customer' THEN 20 WHEN 'nation' THEN 30 WHEN 'region' THEN 40 WHEN 'root' THEN 100 END AS own FROM tree), levels AS (SELECT c.id, arg_min(own, dist) FILTER (WHERE own IS NOT NULL) AS level FROM closure c JOIN lev ON c.anc_id = lev.id GROUP BY 1),
    p AS (SELECT o_orderkey, 1000 + o_custkey AS a, CASE WHEN o_orderkey % 2 = 0 THEN 100 + o_orderkey % 25 ELSE 1000 + (o_custkey * 3 + 1) % 150 END AS b FROM orders),
    m AS (SELECT o_orderkey, a, b, x.anc_id AS lcs, x.dist AS dist_a, y.dist AS dist_b FROM p JOIN closure x ON a = x.id JOIN closure y ON b = y.id AND x.anc_id = y.anc_id QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY x.dist) = 1),
    z AS (SELECT m.*, la.level AS level_a, lb.level AS level_b, lc.level AS level_lcs FROM m JOIN levels la ON a = la.id JOIN levels lb ON b = lb.id JOIN levels lc ON lcs = lc.id)
    SELECT level, count(*) AS tested, sum(CASE WHEN level_lcs <= 30 OR dist_b = 0 THEN 1 ELSE 0 END)::BIGINT AS matched, round(avg(level_lcs - level_b), 6) AS level_distance FROM z, (VALUES (20), (30), (40), (100)) v(level) WHERE level_b <= level GROUP BY 1""")
def p21_match_rates(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    b = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 25 + 100).otherwise((F.col("o_custkey") * 3 + 1) % 150 + 1000)
    p = t.orders.select("o_orderkey", (F.col("o_custkey") + 1000).alias("a"), b.alias("b"))
    rates = models.match_rates(p, pairs, nodes, "a", "b", {"customer": 20, "nation": 30, "region": 40, "root": 100}, 30)
    return rates.select("level", "tested", "matched", F.round("level_distance", 6).alias("level_distance"))


@query("""SELECT p_partkey::VARCHAR AS id, 'CDS' AS type, p_brand AS brand, p_size::VARCHAR AS size FROM part""")
def src15_annotation_lines(t: Tables) -> DataFrame:
    at = scratch(t)
    writers.write_lines(t.part, F.concat_ws("\t", F.lit("CDS"), F.col("p_partkey").cast("string"), F.lit("brand"), "p_brand", F.lit("size"), F.col("p_size").cast("string")), at)
    back = readers.read_key_values(t.spark, at, ["type", "id"])
    return back.select("id", "type", F.col("attrib")["brand"].alias("brand"), F.col("attrib")["size"].alias("size"))


@query("""SELECT s_name AS name, CASE WHEN s_suppkey % 3 <> 0 THEN 'T' || s_suppkey END AS tree, n_name AS strict_phylum, r_name AS relaxed_phylum, n_nationkey::BIGINT AS strict_taxon_id, s_acctbal AS bootstrap
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def src16_annotation_records(t: Tables) -> DataFrame:
    at = scratch(t)
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    strict = F.struct(F.col("n_name").alias("phylum"), F.lit("1").alias("phylum_outgroup"))
    record = s.select(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, "NO_TREE").otherwise(F.concat(F.lit("T"), F.col("s_suppkey").cast("string"))).alias("tree"), strict.alias("strict_consensus"), F.struct(F.col("r_name").alias("phylum")).alias("relaxed_consensus"), F.col("n_nationkey").cast("string").alias("strict_taxon_id"), F.col("s_acctbal").cast("string").alias("bootstrap"))
    record.write.mode("overwrite").json(at)
    back = readers.read_annotations(t.spark, at, ["phylum"])
    return back.select("name", "tree", "strict_phylum", "relaxed_phylum", "strict_taxon_id", "bootstrap")


@query("SELECT 'r' || o_orderkey AS id_read, 'c' || o_custkey AS cont1, CASE WHEN o_orderkey % 2 = 0 THEN 'c' || (o_custkey + 1) END AS cont2 FROM orders WHERE o_orderstatus <> 'P'")
def src18_read_status(t: Tables) -> DataFrame:
    at, key, contig = scratch(t), F.col("o_orderkey"), F.col("o_custkey")
    full = F.concat_ws("\t", F.concat(F.lit("r"), key.cast("string")), F.lit("Assembled"), F.concat(F.lit("c"), contig.cast("string")), F.lit("1"), F.lit("+"), F.when(key % 2 == 0, F.concat(F.lit("c"), (contig + 1).cast("string"))))
    short = F.concat_ws("\t", F.concat(F.lit("r"), key.cast("string")), F.lit("Singleton"))
    writers.write_lines(t.orders, F.when(F.col("o_orderstatus") == "P", short).otherwise(full), at)
    return readers.read_status(t.spark, at)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, printf('%.2f%%', l_discount * 100) AS percent, CASE l_linenumber % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.75 WHEN 3 THEN 0.5 ELSE 0.25 END::DOUBLE AS conf FROM lineitem""")
def x5_x10_percent_and_confidence(t: Tables) -> DataFrame:
    words = F.array(*[F.lit(w) for w in fn.CONFIDENCE])
    word = F.get(words, F.col("l_linenumber") % 5)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", fn.percent(F.col("l_discount")).alias("percent"), fn.confidence(word).alias("conf"))
