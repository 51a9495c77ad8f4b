"""Registered queries over the tree of regions, nations and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.operators import tree as op
from cladeflow.operators.common import first_by
from cladeflow.plans.registry import Tables, query

RANKS = ["customer", "nation", "region", "root"]

TREE = """tree AS (SELECT 1::BIGINT AS id, 0::BIGINT AS idpar, 'root' AS rank, 'root' AS name UNION ALL SELECT 10 + r_regionkey, 1, 'region', r_name FROM region
    UNION ALL SELECT 100 + n_nationkey, 10 + n_regionkey, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 'nation' END, n_name FROM nation
    UNION ALL SELECT 1000 + c_custkey, 100 + c_nationkey, 'customer', c_name FROM customer)"""
CLOSURE = f"""WITH RECURSIVE {TREE}, closure(id, anc_id, dist) AS (SELECT id, id, 0 FROM tree
    UNION ALL SELECT c.id, t.idpar, c.dist + 1 FROM closure c JOIN tree t ON c.anc_id = t.id WHERE t.idpar <> 0)"""
DEPTH = "depth AS (SELECT id, max(dist) AS depth FROM closure GROUP BY 1)"
WIDE = """wide AS (SELECT t.id, min(CASE WHEN a.rank = 'customer' THEN a.id END) AS customer, min(CASE WHEN a.rank = 'nation' THEN a.id END) AS nation,
    min(CASE WHEN a.rank = 'region' THEN a.id END) AS region, min(CASE WHEN a.rank = 'root' THEN a.id END) AS root FROM tree t JOIN closure c ON t.id = c.id JOIN tree a ON c.anc_id = a.id GROUP BY 1)"""


def nodes_of(t: Tables) -> DataFrame:
    def part(df, ident, parent, rank, name):
        return df.select(ident.cast("long").alias("id"), parent.cast("long").alias("idpar"), rank.alias("rank"), name.alias("name"))

    root = t.region.limit(1).select(F.lit(1).cast("long").alias("id"), F.lit(0).cast("long").alias("idpar"), F.lit("root").alias("rank"), F.lit("root").alias("name"))
    regions = part(t.region, F.col("r_regionkey") + 10, F.lit(1), F.lit("region"), F.col("r_name"))
    nations = part(t.nation, F.col("n_nationkey") + 100, F.col("n_regionkey") + 10, F.when(F.col("n_nationkey") % 3 != 0, "nation"), F.col("n_name"))
    leaves = part(t.customer, F.col("c_custkey") + 1000, F.col("c_nationkey") + 100, F.lit("customer"), F.col("c_name"))
    return root.union(regions).union(nations).union(leaves)


def both(t: Tables) -> tuple[DataFrame, DataFrame]:
    nodes = nodes_of(t)
    return nodes, op.closure(nodes)


def balances(t: Tables) -> DataFrame:
    return t.customer.select((F.col("c_custkey") + 1000).alias("id"), F.col("c_acctbal").cast("decimal(18,2)").alias("weight"))


@query(f"{CLOSURE} SELECT id, anc_id, dist FROM closure")
def t1_closure(t: Tables) -> DataFrame:
    return both(t)[1]


@query(f"""{CLOSURE}, size AS (SELECT anc_id AS id, count(*) AS size FROM closure GROUP BY 1),
    prior AS (SELECT t.id, coalesce(sum(size) OVER (PARTITION BY idpar ORDER BY t.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM tree t JOIN size USING (id)),
    l AS (SELECT c.id, (2 * sum(b) + max(dist) + 1)::BIGINT AS lnest, max(dist) AS depth FROM closure c JOIN prior p ON c.anc_id = p.id GROUP BY 1)
    SELECT id, lnest, lnest + 2 * size - 1 AS rnest, depth FROM l JOIN size USING (id)""")
def t2_nested_sets(t: Tables) -> DataFrame:
    return op.nested_sets(*both(t))


@query(f"{CLOSURE} SELECT DISTINCT id FROM closure WHERE anc_id IN (10, 103, 107) AND dist > 0")
def t3_under_any(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    return op.under(pairs, nodes.filter("id IN (10, 103, 107)"), strict=True)


@query(f"""{CLOSURE}, couples AS (SELECT 1000 + c_custkey AS a, 1000 + (c_custkey * 7 + 3) % 150 AS b FROM customer),
    met AS (SELECT a, b, x.anc_id AS lcs, x.dist AS dist_a, y.dist AS dist_b FROM couples JOIN closure x ON a = x.id JOIN closure y ON b = y.id AND x.anc_id = y.anc_id)
    SELECT a, b, lcs, dist_a, dist_b FROM met QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY dist_a) = 1""")
def t4_lowest_common(t: Tables) -> DataFrame:
    couples = t.customer.select((F.col("c_custkey") + 1000).alias("a"), (F.expr("(c_custkey * 7 + 3) % 150") + 1000).alias("b"))
    return op.lowest_common(both(t)[1], couples, "a", "b")


@query(f"""{CLOSURE}, {DEPTH}, m AS (SELECT c_mktsegment AS g, 1000 + c_custkey AS id FROM customer), k AS (SELECT g, count(*) AS n FROM m GROUP BY 1)
    SELECT g, anc_id AS lcs FROM (SELECT g, anc_id, count(*) AS held FROM m JOIN closure USING (id) GROUP BY 1, 2) JOIN k USING (g) JOIN depth ON anc_id = depth.id WHERE held = n
    QUALIFY row_number() OVER (PARTITION BY g ORDER BY depth DESC) = 1""")
def t4_lowest_common_of_many(t: Tables) -> DataFrame:
    members = t.customer.select(F.col("c_mktsegment").alias("g"), (F.col("c_custkey") + 1000).alias("id"))
    return op.lowest_common_of_sets(both(t)[1], members, "g")


@query(f"{CLOSURE} SELECT c.id, arg_min(anc_id, dist) AS at_rank FROM closure c JOIN tree a ON anc_id = a.id WHERE a.rank IN ('nation', 'region') GROUP BY 1")
def t5_nearest_of_rank(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    return op.nearest_of_rank(pairs, nodes, ["nation", "region"])


@query(f"{CLOSURE} SELECT c.id, string_agg(coalesce(a.rank, 'no_rank') || '=' || anc_id, ',' ORDER BY dist DESC) AS lineage FROM closure c JOIN tree a ON anc_id = a.id GROUP BY 1")
def t6_lineage_text(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    return op.paths(op.with_info(pairs, nodes, "rank"), F.concat(F.coalesce("anc_rank", F.lit("no_rank")), F.lit("="), F.col("anc_id").cast("string")))


@query(f"{CLOSURE} SELECT anc_id AS id, sum(c_acctbal::DECIMAL(18, 2))::DOUBLE AS total FROM closure JOIN customer ON id = 1000 + c_custkey GROUP BY 1")
def t7_subtree_totals(t: Tables) -> DataFrame:
    return op.subtree_totals(both(t)[1], balances(t), "weight").withColumn("total", F.col("total").cast("double"))


@query(f"""{CLOSURE}, own AS (SELECT id, CASE WHEN rank = 'customer' THEN id % 97 ELSE 0 END AS x, CASE WHEN rank IS NULL THEN 0 ELSE 1 END AS ok FROM tree),
    open AS (SELECT c.id, c.anc_id FROM closure c WHERE NOT EXISTS (SELECT 1 FROM closure m JOIN own o ON m.anc_id = o.id WHERE m.id = c.id AND m.dist < c.dist AND o.ok = 0))
    SELECT anc_id AS id, max(x)::BIGINT AS result FROM open JOIN own USING (id) GROUP BY 1""")
def t8_reduction(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    nodes = nodes.withColumn("x", F.when(F.col("rank") == "customer", F.col("id") % 97).otherwise(0))
    return op.reduce_up(nodes, pairs, "x", F.max("x"), F.col("rank").isNotNull())


@query(f"""{CLOSURE}, s AS (SELECT anc_id AS id, count(*) AS total FROM closure JOIN customer ON id = 1000 + c_custkey GROUP BY 1)
    SELECT t.id, s.total - coalesce((SELECT sum(k.total) FROM s k JOIN tree c ON k.id = c.id WHERE c.idpar = t.id AND c.rank IS NULL), 0)::BIGINT AS classified FROM tree t JOIN s USING (id)""")
def t9_total_of_classified(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    totals = op.subtree_totals(pairs, nodes.filter("rank = 'customer'").withColumn("one", F.lit(1)), "one")
    lost = totals.join(nodes.filter("rank IS NULL"), "id").groupBy(F.col("idpar").alias("id")).agg(F.sum("total").alias("lost"))
    return totals.join(lost, "id", "left").select("id", (F.col("total") - F.coalesce("lost", F.lit(0))).alias("classified"))


@query(f"{CLOSURE} SELECT anc_id AS id, max(CASE d.rank WHEN 'customer' THEN 1 WHEN 'nation' THEN 2 WHEN 'region' THEN 3 WHEN 'root' THEN 4 ELSE 0 END) AS top FROM closure c JOIN tree d ON c.id = d.id WHERE dist > 0 GROUP BY 1")
def t10_highest_rank_below(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    return op.highest_rank_below(pairs, nodes, RANKS)


@query(f"{CLOSURE} SELECT c.id, bool_or(a.name LIKE 'NATION_1%') AS flagged FROM closure c JOIN tree a ON anc_id = a.id GROUP BY 1")
def t11_under_flagged(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    return op.under_flagged(pairs, nodes, F.col("name").startswith("NATION_1"))


@query(f"""{CLOSURE} SELECT t.id, CASE t.rank WHEN 'customer' THEN 20 WHEN 'nation' THEN 30 WHEN 'region' THEN 90 WHEN 'root' THEN 100 ELSE 0 END AS level,
    (SELECT arg_min(a.rank, dist) FROM closure c JOIN tree a ON anc_id = a.id WHERE c.id = t.id AND a.rank IS NOT NULL) AS ranked FROM tree t""")
def t12_levels(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    return op.node_levels(nodes, pairs, {"customer": 20, "nation": 30, "region": 90, "root": 100})


@query(f"{CLOSURE}, {WIDE} SELECT id, customer, nation, region, root FROM wide")
def t13_fixed_lineage(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    return op.fixed_lineage(pairs, nodes, RANKS)


@query(f"{CLOSURE}, {WIDE}, up AS (SELECT id, customer, coalesce(nation, customer) AS nation, coalesce(region, nation, customer) AS region, root FROM wide) SELECT id, coalesce(customer, nation, region, root) AS customer, coalesce(nation, region, root) AS nation, coalesce(region, root) AS region, root FROM up")
def t14_filled_lineage(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    return op.fill_lineage(op.fixed_lineage(pairs, nodes, RANKS), RANKS, "up-down")


@query(f"{CLOSURE} SELECT c.id, a.rank AS level, anc_id AS clade, dist FROM closure c JOIN tree a ON anc_id = a.id WHERE a.rank IN ('nation', 'region')")
def t15_level_rows(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    return op.level_rows(pairs, nodes, ["nation", "region"])


@query(f"WITH {TREE}, asked AS (SELECT o_orderkey, CASE WHEN o_custkey % 10 = 9 THEN 500000 + o_custkey ELSE 1000 + o_custkey END AS id FROM orders) SELECT o_orderkey, coalesce(1000 + m.c_custkey, id) AS id FROM asked LEFT JOIN customer m ON id = 500000 + m.c_custkey")
def t16_merged_ids(t: Tables) -> DataFrame:
    asked = t.orders.select("o_orderkey", F.when(F.col("o_custkey") % 10 == 9, F.col("o_custkey") + 500000).otherwise(F.col("o_custkey") + 1000).alias("id"))
    return op.resolve_merged(asked, t.customer.select((F.col("c_custkey") + 500000).alias("old_id"), (F.col("c_custkey") + 1000).alias("new_id")), "id").select("o_orderkey", "id")


@query(f"{CLOSURE} SELECT t.id, coalesce((SELECT arg_min(anc_id, dist) FROM closure c JOIN tree a ON anc_id = a.id WHERE c.id = t.id AND dist > 0 AND a.rank IS NOT NULL), 0) AS idpar FROM tree t WHERE rank IS NOT NULL")
def t17_reduced_tree(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    return op.reattached(nodes, pairs, F.col("rank").isNotNull()).select("id", "idpar")


@query(f"{CLOSURE}, tops AS (SELECT * FROM (VALUES (11, 1), (101, 2), (106, 3), (10, 4), (105, 5)) AS v(top, k)) SELECT id, arg_max(top, k)::BIGINT AS top FROM closure JOIN tops ON anc_id = top GROUP BY 1")
def t18_painted(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    k = F.when(F.col("id") == 11, 1).when(F.col("id") == 101, 2).when(F.col("id") == 106, 3).when(F.col("id") == 10, 4).when(F.col("id") == 105, 5)
    return op.painted(pairs, nodes.withColumn("k", k).filter("k IS NOT NULL"), "k")


@query(f"{CLOSURE}, chosen AS (SELECT id FROM tree WHERE name LIKE '%2' OR name LIKE 'A%') SELECT id FROM chosen s WHERE NOT EXISTS (SELECT 1 FROM closure c JOIN chosen o ON c.anc_id = o.id WHERE c.id = s.id AND dist > 0)")
def t19_top_nodes(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    return op.top_nodes(pairs, nodes.filter("name LIKE '%2' OR name LIKE 'A%'").select("id"))


@query("""WITH names AS (SELECT n_nationkey AS id, lower(n_name) AS key FROM nation UNION ALL SELECT 100, 'small' UNION ALL SELECT 101, 'red' UNION ALL SELECT 102, 'red widget'),
    asked AS (SELECT DISTINCT p_name AS q, string_split(lower(p_name), ' ') AS w FROM part), tries AS (SELECT q, unnest(range(1, len(w) + 1)) AS words, w FROM asked),
    hits AS (SELECT q, words, id FROM tries JOIN names ON key = array_to_string(w[1:words], ' '))
    SELECT q, words, id FROM hits QUALIFY words = max(words) OVER (PARTITION BY q)""")
def t20_find_names(t: Tables) -> DataFrame:
    extra = t.spark.createDataFrame([(100, "Small"), (101, "Red"), (102, "Red Widget")], "id int, name string")
    names = t.nation.select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("name")).union(extra)
    return op.find_names(names, t.part.select(F.col("p_name").alias("q")).distinct(), "name", "q").select("q", F.col("words").cast("long").alias("words"), "id")


@query(f"{CLOSURE}, {DEPTH} SELECT id, CASE depth WHEN 0 THEN 'domain' WHEN 1 THEN 'order' WHEN 2 THEN 'family' ELSE 'no_rank' END AS rank, depth FROM depth")
def t21_faked_ranks(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    return op.faked_ranks(pairs, nodes, ["domain", "order", "family"])


@query(f"{CLOSURE}, {WIDE} SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM closure c WHERE c.id = 1000 + o_custkey AND anc_id IN (11, 12)) THEN coalesce(nation, region) ELSE 1000 + o_custkey END AS taxid FROM orders JOIN wide ON id = 1000 + o_custkey")
def t22_rounded_up(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    o = t.orders.select("o_orderkey", (F.col("o_custkey") + 1000).cast("long").alias("taxid"))
    return op.rounded_up(o, nodes, pairs, "taxid", nodes.filter("id IN (11, 12)"), ["nation", "region"])


@query(f"WITH {TREE} SELECT o_orderkey, CASE WHEN rank IN ('nation', 'region') THEN id ELSE 0 END AS taxid FROM orders JOIN tree ON id = CASE o_orderkey % 3 WHEN 0 THEN 1000 + o_custkey WHEN 1 THEN 100 + o_custkey % 25 ELSE 10 + o_custkey % 5 END")
def t23_rejected_ranks(t: Tables) -> DataFrame:
    pick = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") + 1000).when(F.col("o_orderkey") % 3 == 1, F.col("o_custkey") % 25 + 100).otherwise(F.col("o_custkey") % 5 + 10)
    return op.rejected_ranks(t.orders.select("o_orderkey", pick.cast("long").alias("taxid")), nodes_of(t), "taxid", ["nation", "region"])


@query(f"{CLOSURE} SELECT anc_id AS id, sum(l_quantity)::DOUBLE AS weight, count(*) AS n, sum(l_quantity * l_linenumber) / sum(l_quantity) AS score FROM closure c JOIN orders ON c.id = 1000 + o_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def t24_weighted_scores(t: Tables) -> DataFrame:
    s = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").alias("weight"), F.col("l_linenumber").alias("score")).join(t.orders.select("o_orderkey", (F.col("o_custkey") + 1000).alias("id")), "o_orderkey")
    return op.weighted_scores(both(t)[1], s)


@query(f"{CLOSURE} SELECT o_orderkey FROM orders JOIN closure ON id = 1000 + o_custkey WHERE anc_id IN (12, 104)")
def t25_sequences_of_subtrees(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    found = op.under(pairs, nodes.filter("id IN (12, 104)"))
    return t.orders.select("o_orderkey", (F.col("o_custkey") + 1000).alias("id")).join(found, "id", "left_semi").select("o_orderkey")


@query(f"""{CLOSURE}, s AS (SELECT id FROM tree WHERE rank = 'customer'), near AS (SELECT a.id AS target, b.id, min(a.dist) AS up FROM closure a JOIN closure b USING (anc_id)
    WHERE a.id IN (SELECT 1000 + c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') AND b.id IN (SELECT id FROM s) AND a.id <> b.id AND a.dist <= 1 GROUP BY 1, 2)
    SELECT target, id, up, row_number() OVER (PARTITION BY target ORDER BY up, id)::INTEGER AS place FROM near""")
def t26_fill_up_order(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    targets = t.customer.filter("c_mktsegment = 'MACHINERY'").select((F.col("c_custkey") + 1000).alias("id"))
    return op.fill_up_order(pairs, targets, nodes.filter("rank = 'customer'"), 1)


@query(f"""WITH {TREE}, leaf AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'TAXID' || (100 + s_nationkey) || '_' || s_name WHEN 1 THEN 'TAXID99999999_' || s_name ELSE s_name END AS name, CASE s_suppkey % 3 WHEN 0 THEN 100 + s_nationkey WHEN 1 THEN 1 ELSE 900000 END AS idpar FROM supplier)
    SELECT id, idpar, rank, name FROM tree UNION ALL SELECT 900000, 1, 'custom', 'custom sequences' UNION ALL SELECT 900000 + row_number() OVER (ORDER BY name), idpar, 'species', name FROM leaf""")
def t27_custom_leaves(t: Tables) -> DataFrame:
    k = F.col("s_suppkey") % 3
    name = F.when(k == 0, F.concat(F.lit("TAXID"), (F.col("s_nationkey") + 100).cast("string"), F.lit("_"), "s_name")).when(k == 1, F.concat(F.lit("TAXID99999999_"), "s_name")).otherwise(F.col("s_name"))
    return op.with_custom_leaves(nodes_of(t), t.supplier.select(name.alias("leaf")), "leaf", 900001, 900000)


@query(f"{CLOSURE} SELECT id FROM tree t WHERE NOT EXISTS (SELECT 1 FROM closure c JOIN tree a ON anc_id = a.id WHERE c.id = t.id AND a.name IN ('ASIA', 'NATION_1', 'NATION_5', 'root') AND a.id <> 1)")
def t28_deleted_subtrees(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    return op.without_subtrees(nodes, pairs, nodes.filter("name IN ('ASIA', 'NATION_1', 'NATION_5', 'root')"), 1).select("id")


@query(f"{CLOSURE} SELECT d.id FROM tree d JOIN closure c USING (id) WHERE anc_id = 12 AND dist > 0")
def j5_subtree_join(t: Tables) -> DataFrame:
    return both(t)[1].filter("anc_id = 12 AND dist > 0").select("id")


@query(f"{CLOSURE} SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM closure WHERE id = 1000 + o_custkey AND anc_id IN (10, 104))")
def f10_deny_subtrees(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    denied = op.under(pairs, nodes.filter("id IN (10, 104)"))
    return t.orders.select("o_orderkey", (F.col("o_custkey") + 1000).alias("id")).join(denied, "id", "left_anti").select("o_orderkey")


@query(f"""{CLOSURE}, ok AS (SELECT DISTINCT id FROM closure WHERE anc_id IN (11, 13)) SELECT l_orderkey, l_suppkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN ok ON ok.id = 100 + s_nationkey
    QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_suppkey) = 1""")
def f11_masked_candidates(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    ok = op.under(pairs, nodes.filter("id IN (11, 13)"))
    s = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_nationkey") + 100).cast("long").alias("id")).join(ok, "id", "left_semi")
    return first_by(t.lineitem.select("l_orderkey", "l_suppkey", "l_extendedprice").join(s, "l_suppkey"), ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_suppkey")]).select("l_orderkey", "l_suppkey")


@query(f"{CLOSURE}, leaf AS (SELECT id FROM tree WHERE id NOT IN (SELECT idpar FROM tree)) SELECT id FROM tree t WHERE id IN (SELECT id FROM leaf) OR rank IN ('region')")
def f12_masked_ranks(t: Tables) -> DataFrame:
    return op.of_ranks_or_leaves(nodes_of(t), ["region"])


@query(f"""{CLOSURE}, {WIDE}, s AS (SELECT o_orderkey, 1000 + min(o_custkey) AS id, count(*) AS n, sum(l_quantity)::BIGINT AS len FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT x.rank, name, count(*) AS cnt_samp, sum(len)::BIGINT AS len_samp, (sum(len) // count(*))::BIGINT AS avg_len, sum(n * len)::DOUBLE / sum(len) AS avg_score
    FROM (SELECT s.*, 'nation' AS rank, nation AS clade FROM s JOIN wide USING (id) UNION ALL SELECT s.*, 'region', region FROM s JOIN wide USING (id)) x LEFT JOIN tree ON clade = tree.id GROUP BY x.rank, name""")
def a8_clade_report(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("len")).join(t.orders.select("o_orderkey", (F.col("o_custkey") + 1000).alias("id")), "o_orderkey")
    per_node = s.groupBy("id").agg(F.count("*").alias("cnt"), F.sum("len").alias("len"), F.sum(F.col("n") * F.col("len")).alias("score"))
    return op.clade_report(per_node, nodes, pairs, ["nation", "region"])


@query(f"{CLOSURE}, {WIDE} SELECT rank, clade, sum(c_acctbal::DECIMAL(18, 2))::DOUBLE AS weight FROM (SELECT id, 'nation' AS rank, nation AS clade FROM wide UNION ALL SELECT id, 'region', region FROM wide) JOIN customer ON id = 1000 + c_custkey GROUP BY 1, 2")
def a9_rank_weights(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    return op.rank_weights(balances(t), nodes, pairs, ["nation", "region"])


@query(f"""{CLOSURE}, cand AS (SELECT l_orderkey, l_suppkey, l_extendedprice, 100 + s_nationkey AS node, 1000 + o_custkey AS truth FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey),
    excl AS (SELECT c.id AS truth, a.rank AS lev, anc_id AS x FROM closure c JOIN tree a ON anc_id = a.id WHERE a.rank IN ('nation', 'region'))
    SELECT l_orderkey, lev, l_suppkey FROM cand JOIN excl USING (truth) WHERE NOT EXISTS (SELECT 1 FROM closure k WHERE k.id = node AND k.anc_id = x)
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, lev ORDER BY l_extendedprice DESC, l_suppkey) = 1""")
def w9_next_outside(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    ranks = ["nation", "region"]
    s = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_nationkey") + 100).cast("long").alias("node"))
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") + 1000).alias("truth"))
    held = pairs.join(s.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
    cand = t.lineitem.select("l_orderkey", "l_suppkey", "l_extendedprice").join(s, "l_suppkey").join(op.with_zones(o, nodes, pairs, "truth", ranks), "l_orderkey")
    cand = op.with_above(cand, nodes, held, "node", ranks)
    best = op.best_outside(cand, nodes, pairs, "l_orderkey", "node", "truth", ranks, [F.desc("l_extendedprice"), F.col("l_suppkey")])
    return best.select("l_orderkey", "lev", "l_suppkey")


@query(f"""{CLOSURE}, {DEPTH}, r3 AS (SELECT id, idpar, ((id * 7) % 1009)::BIGINT AS result FROM tree JOIN depth USING (id) WHERE depth = 3),
    r2 AS (SELECT t.id, t.idpar, ((t.id * 7 + coalesce(sum(k * c.result), 0)) % 1009)::BIGINT AS result FROM tree t JOIN depth USING (id) LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY idpar ORDER BY id) AS k FROM r3) c ON c.idpar = t.id WHERE depth = 2 GROUP BY 1, 2),
    r1 AS (SELECT t.id, t.idpar, ((t.id * 7 + coalesce(sum(k * c.result), 0)) % 1009)::BIGINT AS result FROM tree t JOIN depth USING (id) LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY idpar ORDER BY id) AS k FROM r2) c ON c.idpar = t.id WHERE depth = 1 GROUP BY 1, 2),
    r0 AS (SELECT t.id, t.idpar, ((t.id * 7 + coalesce(sum(k * c.result), 0)) % 1009)::BIGINT AS result FROM tree t JOIN depth USING (id) LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY idpar ORDER BY id) AS k FROM r1) c ON c.idpar = t.id WHERE depth = 0 GROUP BY 1, 2)
    SELECT id, result FROM r3 UNION ALL SELECT id, result FROM r2 UNION ALL SELECT id, result FROM r1 UNION ALL SELECT id, result FROM r0""")
def u3_function_argument(t: Tables) -> DataFrame:
    """A function of the children's results in their order, which no aggregate expression gives."""
    nodes, pairs = both(t)
    return op.reduce_up_by(nodes.withColumn("x", F.col("id") * 7), pairs, "x", lambda own, kids: (own + sum(k * r for k, (_, r) in enumerate(kids, 1))) % 1009, "long")
