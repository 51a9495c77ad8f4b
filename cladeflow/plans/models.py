"""Registered queries: models, predictions, votes, sampling plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.operators import tree
from cladeflow.operators import models as op
from cladeflow.plans.registry import Tables, query
from cladeflow.plans.sequences import kmers_sql, seqs, seqs_sql
from cladeflow.plans.trees import CLOSURE, DEPTH, both

MODEL = f"""{seqs_sql()}, """ + """g AS (SELECT lang AS doc_id, seq FROM seqs),
    m3 AS (SELECT doc_id AS model, kmer, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(range(1, length(seq) - 1), lambda i: substr(seq, i::INT, 3))) AS kmer FROM g WHERE length(seq) >= 3) GROUP BY 1, 2),
    m1 AS (SELECT doc_id AS model, kmer, count(*) AS n FROM (SELECT doc_id, unnest(string_split(seq, '')) AS kmer FROM g) WHERE kmer <> '' GROUP BY 1, 2),
    t3 AS (SELECT model, left(kmer, 2) AS context, right(kmer, 1) AS next, ln((n + 1) / (sum(n) OVER (PARTITION BY model, left(kmer, 2)) + 4)) AS logp FROM m3),
    t1 AS (SELECT model, kmer AS next, ln((n + 1) / (sum(n) OVER (PARTITION BY model) + 4)) AS logp FROM m1)"""
SCORES = f"""{MODEL}, test AS (SELECT doc_id, lang, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents),
    tk AS (SELECT doc_id, kmer, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(range(1, length(seq) - 1), lambda i: substr(seq, i::INT, 3))) AS kmer FROM test WHERE length(seq) >= 3) GROUP BY 1, 2),
    sc AS (SELECT doc_id, m.model, sum(n * coalesce(t3.logp, t1.logp, -1.3862943611198906)) AS score FROM tk, (SELECT DISTINCT model FROM t3) m LEFT JOIN t3 ON t3.model = m.model AND context = left(kmer, 2) AND t3.next = right(kmer, 1) LEFT JOIN t1 ON t1.model = m.model AND t1.next = right(kmer, 1) GROUP BY 1, 2)"""


def trained(t: Tables) -> DataFrame:
    s = seqs(t).select("lang", "seq")
    table = op.train(s, "lang", "seq", 2)
    return table.filter("length(context) <> 1")


def scored(t: Tables) -> DataFrame:
    return op.score(seqs(t), "doc_id", "seq", trained(t), "lang", 2)


@query(f"WITH {MODEL} SELECT model AS lang, context, next, round(logp, 6) AS logp FROM t3 UNION ALL SELECT model, '', next, round(logp, 6) FROM t1")
def p1_trained_models(t: Tables) -> DataFrame:
    return trained(t).withColumn("logp", F.round("logp", 6))


@query(f"WITH {SCORES} SELECT doc_id, model AS lang, round(score, 4) AS score FROM sc")
def p2_scores(t: Tables) -> DataFrame:
    return scored(t).withColumn("score", F.round("score", 4))


def _backoff_sql(order: int) -> str:
    """Contexts of all lengths; each symbol takes the longest after which the model has seen it."""
    counts = ", ".join(kmers_sql(k, f"b{k}").replace("doc_id", "lang") for k in range(1, order + 2))
    tables = ", ".join(f"p{k} AS (SELECT lang AS model, kmer, ln((n + 1) / (sum(n) OVER (PARTITION BY lang, left(kmer, {k - 1})) + 4)) AS logp FROM b{k})" for k in range(1, order + 2))
    longest = "coalesce(" + ", ".join(f"p{k}.logp" for k in range(order + 1, 0, -1)) + ", -1.3862943611198906)"
    joins = " ".join(f"LEFT JOIN p{k} ON p{k}.model = m.model AND p{k}.kmer = right(s.kmer, {k})" for k in range(1, order + 2))
    return f"{counts}, {tables}, {kmers_sql(order + 1, 's')} SELECT doc_id, m.model AS lang, round(sum(s.n * {longest}), 4) AS score FROM s, (SELECT DISTINCT lang AS model FROM seqs WHERE lang IS NOT NULL) m {joins} GROUP BY 1, 2"


@query(f"WITH {seqs_sql()}, {_backoff_sql(4)}")
def p2_backoff_scores(t: Tables) -> DataFrame:
    """Contexts of 0 to 4 symbols."""
    s = seqs(t)
    return op.score(s, "doc_id", "seq", op.train(s, "lang", "seq", 4), "lang", 4).withColumn("score", F.round("score", 4))


@query("SELECT l_orderkey, l_suppkey % 10 AS score_id, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2")
def p3_shared_score_ids(t: Tables) -> DataFrame:
    ids = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_suppkey") % 10).alias("score_id"))
    s = t.lineitem.select("l_orderkey", "l_suppkey", F.col("l_extendedprice").alias("score"))
    return op.best_of_shared(s, "l_orderkey", "l_suppkey", ids, "score_id")


@query("WITH u AS (SELECT user_id, event_id, value FROM events) SELECT user_id, arg_max(event_id, (value, -event_id)) AS best, max(value) AS score FROM u GROUP BY 1")
def p4_combined_scores(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_id", F.col("value").alias("score"))
    whole = op.combined(e.filter("event_type IN ('view', 'click')"), e.filter("event_type NOT IN ('view', 'click')"), "user_id")
    return op.first_by(whole, ["user_id"], [F.desc("score"), F.col("event_id")]).select("user_id", F.col("event_id").alias("best"), "score")


@query(f"WITH {SCORES} SELECT doc_id, model AS lang, round(score, 4) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, model) = 1")
def p5_predictions(t: Tables) -> DataFrame:
    return op.predictions(scored(t), "doc_id", "lang", t.documents.select("lang").distinct()).select("doc_id", "lang", F.round("score", 4).alias("score"))


@query(f"""{CLOSURE}, bad AS (SELECT DISTINCT id FROM closure WHERE anc_id IN (10)), long AS (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) >= 100)
    SELECT l_orderkey, l_suppkey FROM lineitem JOIN long USING (l_orderkey) JOIN supplier ON l_suppkey = s_suppkey WHERE 100 + s_nationkey NOT IN (SELECT id FROM bad)
    QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_suppkey) = 1""")
def p6_prediction_mode(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    bad = tree.under(pairs, nodes.filter("id = 10"))
    ok = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_nationkey") + 100).cast("long").alias("id")).join(bad, "id", "left_anti")
    long = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("n")).filter("n >= 100").select("l_orderkey")
    rows = t.lineitem.select("l_orderkey", "l_suppkey", "l_extendedprice").join(long, "l_orderkey", "left_semi").join(ok, "l_suppkey")
    return op.first_by(rows, ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_suppkey")]).select("l_orderkey", "l_suppkey")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(1 / (1 + exp(-(-0.5 + 2 * s + 1.5 * n + 0.01 * lev + 0.8 * s * n))), 6) AS conf FROM (SELECT *, l_extendedprice / 100000 / l_quantity AS s, pow(l_quantity, -0.25) AS n, CASE WHEN l_linenumber * 30 = 90 THEN 115 ELSE l_linenumber * 30 END AS lev FROM lineitem)""")
def p7_confidence(t: Tables) -> DataFrame:
    c = op.confidence(F.col("l_extendedprice") / 100000, F.col("l_quantity"), F.col("l_linenumber") * 30)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(c, 6).alias("conf"))


@query(f"""{CLOSURE}, s AS (SELECT o_orderkey AS id, count(*) AS len, arg_max(l_suppkey, (l_extendedprice, -l_suppkey)) AS idscore, max(l_extendedprice) AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(*) >= 3)
    SELECT s.id, len, 100 + s_nationkey AS taxid, n_name AS name, coalesce(CASE WHEN s.id % 3 = 0 THEN 2.5 END, len) AS weight, idscore, r_name AS name_region, score FROM s JOIN supplier ON idscore = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def p9_prediction_rows(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("len"), F.max(F.struct("l_extendedprice", (-F.col("l_suppkey")).alias("m"))).alias("b")).filter("len >= 3")
    s = s.select("id", "len", (-F.col("b.m")).alias("idscore"), F.col("b.l_extendedprice").alias("score"))
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    x = s.join(t.supplier, F.col("idscore") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    weight = F.coalesce(F.when(F.col("id") % 3 == 0, 2.5), F.col("len").cast("double"))
    return x.select("id", "len", (F.col("s_nationkey") + 100).alias("taxid"), F.col("n_name").alias("name"), weight.alias("weight"), "idscore", F.col("r_name").alias("name_region"), "score")


@query("SELECT l_orderkey, coalesce(o_totalprice, q) AS weight FROM (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey")
def p10_sample_weights(t: Tables) -> DataFrame:
    given = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("given"))
    q = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    return q.join(given, "l_orderkey", "left").select("l_orderkey", F.coalesce("given", "q").alias("weight"))


@query("SELECT n_name, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def p11_taxonomy_report(t: Tables) -> DataFrame:
    n = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    by = n.join(t.supplier.select("s_suppkey", F.col("s_nationkey").alias("n_nationkey")), "s_suppkey").groupBy("n_nationkey").agg(F.sum("n").alias("n"))
    return by.join(t.nation, "n_nationkey").select("n_name", "n")


@query("SELECT vec_id, round(sign(y) * (1 - exp(-abs(y))), 8) AS soft FROM (SELECT vec_id, embedding[1]::DOUBLE * 10 AS y FROM embeddings)")
def p13_soft_decision(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.round(op.soft_decision(F.col("embedding")[0].cast("double") * 10), 8).alias("soft"))


@query("""WITH d AS (SELECT vec_id, generate_subscripts(embedding, 1)::INT AS label, unnest(embedding) AS y FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY y DESC, label) AS k FROM d),
    b AS (SELECT vec_id, max(CASE WHEN k = 1 THEN label END) AS label, max(CASE WHEN k = 1 THEN y END) AS top, max(CASE WHEN k = 2 THEN y END) AS second FROM r GROUP BY 1)
    SELECT vec_id, CASE WHEN top::DOUBLE - second::DOUBLE > 0.05 THEN label ELSE 0 END AS pred FROM b""")
def p14_rejects(t: Tables) -> DataFrame:
    d = t.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "y")).select("vec_id", (F.col("i") + 1).alias("label"), F.col("y").cast("double").alias("y"))
    return op.with_rejects(op.two_best(d, "vec_id", "label", "y"), "label", "margin", 0.05).select("vec_id", "pred")


@query("WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY md5(vec_id || ':4'), vec_id) - 1 AS k FROM embeddings) SELECT vec_id, (k % 5)::INT AS fold FROM r")
def p16_folds(t: Tables) -> DataFrame:
    return op.folds(t.embeddings.select("vec_id"), "vec_id", 5, 4)


@query(f"""{CLOSURE}, h AS (SELECT l_orderkey AS s, 100 + s_nationkey AS node, (20 - l_linenumber)::BIGINT AS w FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
    tot AS (SELECT s, count(*) AS hits, sum(w) AS aw FROM h GROUP BY 1), up AS (SELECT s, anc_id, count(*) AS here, sum(w) AS w FROM h JOIN closure ON node = id GROUP BY 1, 2),
    ok AS (SELECT s, anc_id, CASE t.rank WHEN 'nation' THEN 1 WHEN 'region' THEN 2 WHEN 'root' THEN 3 END AS level, w / aw AS part FROM up JOIN tot USING (s) JOIN tree t ON anc_id = t.id WHERE t.rank IS NOT NULL AND (here = hits OR (hits >= 4 AND here >= 2 AND w / aw >= 0.75)))
    SELECT s AS l_orderkey, anc_id AS vote, level FROM ok QUALIFY row_number() OVER (PARTITION BY s ORDER BY level, part DESC, anc_id) = 1""")
def p19_annotation_vote(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    s = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_nationkey") + 100).cast("long").alias("node"))
    h = t.lineitem.join(s, "l_suppkey").select("l_orderkey", "node", (20 - F.col("l_linenumber")).cast("long").alias("w"))
    held = pairs.join(s.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
    return op.annotation_vote(h, held, nodes, {"nation": 1, "region": 2, "root": 3}, "l_orderkey", "node", "w")


@query(f"""{CLOSURE}, {DEPTH}, p AS (SELECT o_orderkey, 1000 + o_custkey AS a, 100 + (o_orderkey % 25) AS b FROM orders),
    m AS (SELECT o_orderkey, x.anc_id AS lcs, x.dist AS up FROM p JOIN closure x ON a = x.id JOIN closure y ON b = y.id AND x.anc_id = y.anc_id QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY x.dist) = 1)
    SELECT depth, count(*) AS n, sum(count(*)) OVER (ORDER BY depth DESC)::BIGINT AS cum FROM m JOIN depth ON lcs = id GROUP BY 1""")
def p22_host_levels(t: Tables) -> DataFrame:
    _, pairs = both(t)
    p = t.orders.select("o_orderkey", (F.col("o_custkey") + 1000).alias("a"), (F.col("o_orderkey") % 25 + 100).alias("b"))
    n = tree.lowest_common(pairs, p, "a", "b").join(tree.depths(pairs).withColumnRenamed("id", "lcs"), "lcs").groupBy("depth").agg(F.count("*").alias("n"))
    return n.withColumn("cum", F.sum("n").over(Window.orderBy(F.desc("depth"))))


@query(f"""{CLOSURE}, p AS (SELECT o_orderkey, 1000 + o_custkey AS a, 1000 + (o_custkey * 3 + 1) % 150 AS b FROM orders)
    SELECT o_orderkey, x.anc_id AS lcs, x.dist + y.dist AS steps FROM p JOIN closure x ON a = x.id JOIN closure y ON b = y.id AND x.anc_id = y.anc_id QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY x.dist) = 1""")
def p21_compared_predictions(t: Tables) -> DataFrame:
    p = t.orders.select("o_orderkey", (F.col("o_custkey") + 1000).alias("a"), (F.expr("(o_custkey * 3 + 1) % 150") + 1000).alias("b"))
    return tree.lowest_common(both(t)[1], p, "a", "b").select("o_orderkey", "lcs", (F.col("dist_a") + F.col("dist_b")).alias("steps"))


@query("""WITH w AS (SELECT DISTINCT p_name, list_filter(string_split(lower(p_name) , ' '), lambda x: x <> '' AND x NOT IN ('small', 'hot')) AS w FROM part)
    SELECT p_name, unnest(range(1, len(w) + 1)) AS words, array_to_string(w[1:unnest(range(1, len(w) + 1))], ' ') AS host FROM w WHERE len(w) > 0""")
def p23_host_candidates(t: Tables) -> DataFrame:
    out = op.host_candidates(t.part.select("p_name").distinct(), "p_name", ["small", "hot"])
    return out.withColumn("words", F.col("words").cast("long"))


@query("SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(c_custkey || ':7'), c_custkey) <= 3")
def p26_random_picks(t: Tables) -> DataFrame:
    return op.picked_per_group(t.customer.select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey", 3, 7)


@query(f"WITH {seqs_sql()}, m AS (SELECT unnest(['lang_' || lang, 'source_' || source]) AS model, seq FROM seqs) SELECT model, count(*) AS n, sum(length(seq))::BIGINT AS len FROM m GROUP BY 1")
def p27_sequences_of_models(t: Tables) -> DataFrame:
    s = seqs(t)
    models = F.array(F.concat(F.lit("lang_"), "lang"), F.concat(F.lit("source_"), "source"))
    listed = t.documents.select("doc_id", F.explode(models).alias("model"))
    return s.select("doc_id", "seq").join(listed, "doc_id").groupBy("model").agg(F.count("*").alias("n"), F.sum(F.length("seq")).alias("len"))


@query(f"""{CLOSURE}, s AS (SELECT anc_id AS id, count(*) AS total FROM closure JOIN orders ON id = 1000 + o_custkey GROUP BY 1)
    SELECT id, total, total >= 150 AS trainable, CASE WHEN total >= 150 THEN greatest(50, floor(total * 0.1)) ELSE 0 END::BIGINT AS test FROM s""")
def p29_train_flags(t: Tables) -> DataFrame:
    o = t.orders.select((F.col("o_custkey") + 1000).alias("id"), F.lit(1).alias("one"))
    return op.train_flags(tree.subtree_totals(both(t)[1], o, "one"), 100, 50, 0.1)


@query("""WITH n AS (SELECT c_nationkey AS g, c_custkey AS id, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2), r AS (SELECT *, floor(sum(n) OVER (PARTITION BY g) * 0.2) AS target FROM n),
    x AS (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY md5(id || ':13'), id) <= target AS inside FROM r)
    SELECT g, id, inside OR (NOT bool_or(inside) OVER (PARTITION BY g) AND row_number() OVER (PARTITION BY g ORDER BY n, id) = 1) AS is_test FROM x""")
def p30_test_terminals(t: Tables) -> DataFrame:
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")).join(t.customer, "c_custkey").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("id"), "n")
    n = n.withColumn("target", F.floor(F.sum("n").over(Window.partitionBy("g")) * 0.2))
    return op.test_terminals(n, "g", "id", "n", "target", 13).select("g", "id", "is_test")


@query("SELECT CASE WHEN rank = 'root' THEN 0 ELSE 1 END AS below, 10000::BIGINT AS total FROM (VALUES ('root'), ('region')) t(rank)")
def p31_allocated_counts(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    depth = tree.depths(pairs)
    out = op.allocate_down(nodes, depth, 1, 10_000, 3).join(depth, "id")
    return out.filter("depth <= 1").groupBy(F.least("depth", F.lit(1)).alias("below")).agg(F.sum("amount").alias("total"))


@query(f"""{CLOSURE}, s AS (SELECT anc_id AS id, count(*) AS total FROM closure JOIN orders ON id = 1000 + o_custkey GROUP BY 1) SELECT s.id, least(floor(p.total / count(*) OVER (PARTITION BY t.idpar)), s.total)::BIGINT AS target, s.total >= 80 AS enough
    FROM s JOIN tree t USING (id) JOIN s p ON p.id = t.idpar WHERE t.rank = 'nation'""")
def p36_training_targets(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    s = tree.subtree_totals(pairs, t.orders.select((F.col("o_custkey") + 1000).alias("id"), F.lit(1).alias("one")), "one")
    x = s.join(nodes.filter("rank = 'nation'"), "id").join(s.select(F.col("id").alias("idpar"), F.col("total").alias("up")), "idpar")
    return x.select("id", F.least(F.floor(F.col("up") / F.count("*").over(Window.partitionBy("idpar"))), "total").alias("target"), (F.col("total") >= 80).alias("enough"))


@query("SELECT o_orderkey, coalesce(l.q, 0) AS label FROM orders LEFT JOIN (SELECT s_suppkey AS h, s_nationkey % 4 + 1 AS q FROM supplier WHERE s_acctbal > 3000) l ON o_custkey % 50 = h")
def p33_host_labels(t: Tables) -> DataFrame:
    h = t.supplier.filter("s_acctbal > 3000").select(F.col("s_suppkey").alias("h"), (F.col("s_nationkey") % 4 + 1).alias("q"))
    return t.orders.select("o_orderkey", (F.col("o_custkey") % 50).alias("h")).join(h, "h", "left").select("o_orderkey", F.coalesce("q", F.lit(0)).alias("label"))


@query(f"WITH {SCORES} SELECT lang, count(*) AS n, sum((lang = model)::INT)::BIGINT AS hits FROM (SELECT doc_id, model FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, model) = 1) JOIN test USING (doc_id) GROUP BY 1")
def p_language_hits(t: Tables) -> DataFrame:
    best = op.first_by(scored(t), ["doc_id"], [F.desc("score"), F.col("lang")]).select("doc_id", F.col("lang").alias("model"))
    return best.join(t.documents.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum((F.col("lang") == F.col("model")).cast("int")).alias("hits"))


