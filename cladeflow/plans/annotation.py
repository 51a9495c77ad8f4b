"""Registered queries: annotation records, hosts, and what is built from rows by functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.functions import columns as fn
from cladeflow.operators import annotation as op
from cladeflow.operators import kmers, models, tree
from cladeflow.operators.relational import filter_rows, require_empty
from cladeflow.plans.files import scratch
from cladeflow.plans.registry import Tables, query
from cladeflow.plans.trees import CLOSURE, TREE, both, nodes_of
from cladeflow.sources import writers


@query("SELECT l_orderkey, l_linenumber, l_partkey, 'scf_' || l_suppkey AS contig, l_linenumber::BIGINT * 10 - 1 AS start, (l_linenumber * 10 + l_quantity)::BIGINT AS \"end\", CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS strand FROM lineitem")
def f14_orf_places(t: Tables) -> DataFrame:
    at = F.col("l_linenumber") * 10
    orf = F.concat_ws("_", F.lit("scf"), F.col("l_suppkey").cast("string"), at.cast("string"), (at + F.col("l_quantity").cast("int")).cast("string"), F.when(F.col("l_returnflag") == "R", "-1").otherwise("1"))
    x = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", op.orf_place(orf).alias("o"))
    return fn.flatten_struct(x, "o")


@query("SELECT p_partkey, p_size::VARCHAR AS n FROM part WHERE p_type = 'ECONOMY' AND p_size >= 20")
def f15_ragged_selection(t: Tables) -> DataFrame:
    x = t.part.select("p_partkey", F.col("p_type").alias("type"), F.create_map(F.lit("n"), F.col("p_size").cast("string")).alias("attrib"))
    return op.kept_records(x, "attrib", "ECONOMY", "n", 20).select("p_partkey", F.col("attrib")["n"].alias("n"))


@query("SELECT doc_id, md5(substr(text, doc_id % 20 + 1, 200 - doc_id % 20)) AS part FROM documents WHERE length(substr(text, doc_id % 20 + 1, 200 - doc_id % 20)) >= 150")
def f16_clear_range(t: Tables) -> DataFrame:
    header = F.concat(F.lit("id=x clr_left="), (F.col("doc_id") % 20).cast("string"), F.lit(" clr_right=200"))
    return op.trimmed_reads(t.documents.select("doc_id", "text", header.alias("header")), "header", "text", 150).select("doc_id", F.md5("text").alias("part"))


@query("SELECT p_partkey FROM part WHERE p_size >= 30")
def f21_ragged_length(t: Tables) -> DataFrame:
    x = t.part.select("p_partkey", F.expr("str_to_map(concat('len=', p_size, ';name=', p_name), ';', '=')").alias("attrib"))
    return x.filter(F.col("attrib")["len"].cast("int") >= 30).select("p_partkey")


@query("SELECT o_orderkey, -c_custkey AS ordinal FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'")
def s4_listed_order(t: Tables) -> DataFrame:
    x = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.when(F.col("o_orderstatus") != "P", "tree").alias("tree"))
    order = t.customer.select("c_custkey", (-F.col("c_custkey")).alias("ordinal"))
    return op.in_listed_order(x, order, "c_custkey", "ordinal", "tree").select("o_orderkey", "ordinal")


@query(f"""{CLOSURE}, h AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 2 = 0 THEN l_suppkey END AS gi, l_suppkey + 1 AS gi2 FROM lineitem),
    line AS (SELECT id, string_agg(coalesce(rank, 'no_rank') || '=' || anc_id, ',' ORDER BY dist DESC) AS lineage FROM (SELECT c.id, anc_id, dist, a.rank FROM closure c JOIN tree a ON anc_id = a.id) GROUP BY 1)
    SELECT l_orderkey, l_linenumber, l_partkey, coalesce(a.s_suppkey, b.s_suppkey) AS source, lineage FROM h LEFT JOIN supplier a ON gi = a.s_suppkey LEFT JOIN supplier b ON gi2 = b.s_suppkey LEFT JOIN line ON line.id = 100 + coalesce(a.s_nationkey, b.s_nationkey)""")
def j24_header_metadata(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    line = tree.paths(tree.with_info(pairs, nodes, "rank"), F.concat(F.coalesce("anc_rank", F.lit("no_rank")), F.lit("="), F.col("anc_id").cast("string")))
    s = t.supplier.select("s_suppkey", (F.col("s_nationkey") + 100).cast("long").alias("id"))
    h = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_partkey") % 2 == 0, F.col("l_suppkey")).alias("gi"), (F.col("l_suppkey") + 1).alias("gi2"))
    x = h.join(s.select(F.col("s_suppkey").alias("gi"), F.col("s_suppkey").alias("s1"), F.col("id").alias("id1")), "gi", "left").join(s.select(F.col("s_suppkey").alias("gi2"), F.col("s_suppkey").alias("s2"), F.col("id").alias("id2")), "gi2", "left")
    x = x.select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce("s1", "s2").alias("source"), F.coalesce("id1", "id2").alias("id"))
    return x.join(line, "id", "left").drop("id")


@query(f"""{CLOSURE}, rec AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 1000 + o_custkey ELSE 9999999 END AS taxid, CASE WHEN o_orderkey % 3 = 1 THEN 'nation_' || (o_custkey % 25) ELSE 'common' END AS name FROM orders),
    names AS (SELECT lower(name) AS key, id FROM tree UNION ALL SELECT 'common', id FROM tree WHERE id IN (1003, 1010)),
    a AS (SELECT k, taxid AS node, 'taxid' AS how FROM rec JOIN tree ON taxid = id), hits AS (SELECT DISTINCT k, id FROM rec JOIN names ON name = key WHERE k NOT IN (SELECT k FROM a)), n AS (SELECT k, count(*) AS n FROM hits GROUP BY 1),
    c AS (SELECT anc_id FROM closure WHERE id IN (1003, 1010) GROUP BY 1 HAVING count(*) = 2), l AS (SELECT anc_id AS lcs FROM c JOIN (SELECT id, max(dist) AS depth FROM closure GROUP BY 1) ON id = anc_id ORDER BY depth DESC LIMIT 1)
    SELECT k, node, how FROM a UNION ALL SELECT k, id, 'name' FROM hits JOIN n USING (k) WHERE n = 1 UNION ALL SELECT k, lcs, 'common' FROM n, l WHERE n > 1""")
def p20_resolved_annotations(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    k = F.col("o_orderkey") % 3
    rec = t.orders.select(F.col("o_orderkey").alias("k"), F.when(k == 0, F.col("o_custkey") + 1000).otherwise(9999999).alias("taxid"), F.when(k == 1, F.concat(F.lit("nation_"), (F.col("o_custkey") % 25).cast("string"))).otherwise("common").alias("name")).withColumn("lineage", F.array("name"))
    names = nodes.select("id", "name").union(nodes.filter("id IN (1003, 1010)").select("id", F.lit("common")))
    return op.resolved(rec, names, pairs, nodes, "k")


@query(f"""{CLOSURE}, cand AS (SELECT s_suppkey AS v, lower(n_name) AS host, 1 AS score FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 2000 UNION ALL SELECT s_suppkey, lower(r_name), 1 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal > 6000 UNION ALL SELECT s_suppkey, 'asia', 2 FROM supplier),
    hits AS (SELECT DISTINCT v, id, score FROM cand JOIN tree ON host = lower(name) WHERE id NOT IN (SELECT id FROM closure WHERE anc_id = 10)), best AS (SELECT DISTINCT v, id FROM hits h WHERE score = (SELECT min(score) FROM hits m WHERE m.v = h.v))
    SELECT v, id FROM best b WHERE NOT EXISTS (SELECT 1 FROM best o JOIN closure c ON c.anc_id = o.id WHERE o.v = b.v AND c.id = b.id AND dist > 0)""")
def p24_assigned_hosts(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    one = lambda where, name, score: s.filter(where).select(F.col("s_suppkey").alias("v"), F.lower(name).alias("host"), F.lit(score).alias("score"))
    cand = one("s_acctbal > 2000", F.col("n_name"), 1).union(one("s_acctbal > 6000", F.col("r_name"), 1)).union(one("true", F.lit("asia"), 2))
    return op.assigned_hosts(cand, nodes, pairs, nodes.filter("id = 10"), "v")


@query(f"""{CLOSURE}, asked AS (SELECT s_suppkey AS v, trim(CASE s_suppkey % 5 WHEN 0 THEN n_name WHEN 1 THEN left(n_name, 1) || substr(n_name, 3) WHEN 2 THEN 'x' || n_name || 'q' WHEN 3 THEN n_name || ' strain ' || s_suppkey ELSE r_name || 'ns' END) AS host
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), names AS (SELECT id, lower(name) AS name FROM tree WHERE id BETWEEN 2 AND 999),
    words AS (SELECT v, host, string_split(lower(host), ' ') AS w FROM asked), tries AS (SELECT v, unnest(range(1, len(w) + 1)) AS k, w FROM words), found AS (SELECT v, k, len(w) - k AS dropped, id FROM tries JOIN names ON name = array_to_string(w[1:k], ' ')),
    hits AS (SELECT v, id, levenshtein(name, lower(host)) AS score FROM asked JOIN names ON levenshtein(name, lower(host)) <= 2 UNION ALL SELECT v, id, 3 + dropped FROM found f WHERE dropped > 0 AND k = (SELECT max(k) FROM found m WHERE m.v = f.v)),
    ok AS (SELECT DISTINCT * FROM hits WHERE id NOT IN (SELECT id FROM closure WHERE anc_id = 10)), best AS (SELECT DISTINCT v, id FROM ok h WHERE score = (SELECT min(score) FROM ok m WHERE m.v = h.v))
    SELECT v, id FROM best b WHERE NOT EXISTS (SELECT 1 FROM best o JOIN closure c ON c.anc_id = o.id WHERE o.v = b.v AND c.id = b.id AND dist > 0)""")
def p24_near_hosts(t: Tables) -> DataFrame:
    """Hosts named exactly, misspelt in several ways, or with more words than the name."""
    nodes, pairs = both(t)
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    k, n = F.col("s_suppkey") % 5, F.col("n_name")
    host = F.when(k == 0, n).when(k == 1, F.concat(F.left(n, F.lit(1)), F.substring(n, 3, 99))).when(k == 2, F.concat(F.lit("x"), n, F.lit("q"))).when(k == 3, F.concat(n, F.lit(" strain "), F.col("s_suppkey").cast("string"))).otherwise(F.concat("r_name", F.lit("ns")))
    names = nodes.filter("id BETWEEN 2 AND 999").select("id", "name")
    return op.near_hosts(s.select(F.col("s_suppkey").alias("v"), host.alias("host")), names, pairs, nodes.filter("id = 10"), "v", "host")


@query(f"""{CLOSURE}, h AS (SELECT id FROM tree WHERE rank = 'customer'), s AS (SELECT 1000 + c_custkey AS id FROM customer WHERE c_mktsegment = 'MACHINERY'),
    near AS (SELECT h.id AS host, id AS ref, -1 AS up FROM h JOIN s USING (id) UNION ALL SELECT a.id, b.id, min(a.dist) FROM closure a JOIN closure b USING (anc_id) WHERE a.id IN (SELECT id FROM h) AND b.id IN (SELECT id FROM s) AND a.id <> b.id AND a.dist <= 1 GROUP BY 1, 2)
    SELECT host, ref FROM near QUALIFY row_number() OVER (PARTITION BY host ORDER BY up, ref) = 1""")
def p25_reference_hosts(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    with_sequence = t.customer.filter("c_mktsegment = 'MACHINERY'").select((F.col("c_custkey") + 1000).alias("id"))
    return op.reference_hosts(nodes.filter("rank = 'customer'"), pairs, with_sequence, 1)


@query(f"""{CLOSURE}, h AS (SELECT id FROM tree WHERE rank = 'customer'), s AS (SELECT 1000 + c_custkey AS id FROM customer WHERE c_mktsegment = 'MACHINERY'),
    near AS (SELECT h.id AS host, id AS ref, -1 AS up FROM h JOIN s USING (id) UNION ALL SELECT a.id, b.id, min(a.dist) FROM closure a JOIN closure b USING (anc_id) WHERE a.id IN (SELECT id FROM h) AND b.id IN (SELECT id FROM s) AND a.id <> b.id AND a.dist <= 1 GROUP BY 1, 2),
    refs AS (SELECT host, ref FROM near QUALIFY row_number() OVER (PARTITION BY host ORDER BY up, ref) = 1),
    g AS (SELECT c.id AS ref, arg_min(anc_id, dist) AS "group" FROM closure c JOIN tree a ON anc_id = a.id WHERE a.rank IN ('nation', 'region') GROUP BY 1)
    SELECT DISTINCT "group", ref, o_orderkey FROM orders JOIN refs ON host = 1000 + o_custkey JOIN g USING (ref)""")
def p25_regrouped_viruses(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    with_sequence = t.customer.filter("c_mktsegment = 'MACHINERY'").select((F.col("c_custkey") + 1000).alias("id"))
    refs = op.reference_hosts(nodes.filter("rank = 'customer'"), pairs, with_sequence, 1)
    viruses = t.orders.select("o_orderkey", (F.col("o_custkey") + 1000).alias("host"))
    return op.regrouped(viruses, refs, pairs, nodes, "o_orderkey", ["nation", "region"])


@query("SELECT DISTINCT p_partkey, h AS host, CASE WHEN p_size % 2 = 0 THEN p_size::BIGINT END AS taxid FROM (SELECT p_partkey, p_size, unnest([lower(trim(p_name)), lower(trim(p_type)), NULL]) AS h FROM part) WHERE h IS NOT NULL AND h <> ''")
def p34_feature_hosts(t: Tables) -> DataFrame:
    f = t.part.select("p_partkey", "p_name", "p_type", F.lit(None).cast("string").alias("lab"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("taxon:"), F.col("p_size").cast("string"))).otherwise("none").alias("xref"))
    return op.feature_hosts(f, "p_partkey", ["p_name", "p_type", "lab"], "xref")


@query(f"""{CLOSURE}, s AS (SELECT anc_id AS id, count(*) AS total FROM closure JOIN orders ON id = 1000 + o_custkey GROUP BY 1), ok AS (SELECT id, total FROM s JOIN tree USING (id) WHERE rank = 'nation' AND total >= 80)
    SELECT id, total, least(total, floor(2000 / count(*) OVER ()))::BIGINT AS quota FROM ok""")
def p32_class_quotas(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    totals = tree.subtree_totals(pairs, t.orders.select((F.col("o_custkey") + 1000).alias("id"), F.lit(1).alias("one")), "one")
    return op.class_quotas(totals.join(nodes.filter("rank = 'nation'").select("id"), "id"), 80, 2000).select("id", "total", "quota")


@query("""WITH q AS (SELECT c_nationkey, least(count(*), 40) AS quota, dense_rank() OVER (ORDER BY c_nationkey) AS number FROM customer GROUP BY 1 HAVING count(*) >= 20)
    SELECT c_custkey, number FROM customer JOIN q USING (c_nationkey) QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(c_custkey || ':21'), c_custkey) <= max(quota) OVER (PARTITION BY c_nationkey)""")
def p37_training_rows(t: Tables) -> DataFrame:
    q = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n")).filter("n >= 20").select("c_nationkey", F.least("n", F.lit(40)).alias("quota"))
    return op.training_rows(t.customer.select("c_nationkey", "c_custkey"), q, "c_nationkey", "c_custkey", 21).select("c_custkey", F.col("number").cast("long").alias("number"))


@query("""WITH q AS (SELECT c_nationkey, least(count(*), 40) AS quota, count(*) >= 20 AS fg FROM customer GROUP BY 1), n AS (SELECT c_nationkey, quota, CASE WHEN fg THEN row_number() OVER (PARTITION BY fg ORDER BY c_nationkey) ELSE 0 END AS number FROM q)
    SELECT c_custkey, number FROM customer JOIN n USING (c_nationkey) QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(c_custkey || ':21'), c_custkey) <= max(quota) OVER (PARTITION BY c_nationkey)""")
def p37_with_background(t: Tables) -> DataFrame:
    q = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n")).select("c_nationkey", F.least("n", F.lit(40)).alias("quota"), "n")
    rows = op.training_rows(t.customer.select("c_nationkey", "c_custkey"), q.filter("n >= 20"), "c_nationkey", "c_custkey", 21, q.filter("n < 20"))
    return rows.select("c_custkey", "number")


@query(f"""{CLOSURE}, total AS (SELECT anc_id AS id, count(*) AS total FROM closure JOIN orders ON id = 1000 + o_custkey GROUP BY 1), own AS (SELECT 1000 + o_custkey AS id, count(*) AS own FROM orders GROUP BY 1)
    SELECT (SELECT count(*) FROM total) AS nodes, (SELECT count(*) FROM total c JOIN tree t USING (id) JOIN total p ON t.idpar = p.id WHERE c.total > p.total) AS above_parent,
        (SELECT count(*) FROM (SELECT p.id FROM total p JOIN tree t ON t.idpar = p.id JOIN total c ON c.id = t.id LEFT JOIN own ON own.id = p.id WHERE own.id IS NULL GROUP BY p.id, p.total HAVING sum(c.total) <> p.total)) AS unlike_children""")
def p35_checked_counts(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    o = t.orders.select((F.col("o_custkey") + 1000).alias("id"), F.lit(1).alias("one"))
    return models.checked_counts(nodes, tree.subtree_totals(pairs, o, "one"), o)


@query(f"""{CLOSURE} SELECT sum(least(n, 3))::BIGINT AS picks FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey)""")
def p35_checked_picks(t: Tables) -> DataFrame:
    nodes = nodes_of(t)
    picks = models.picked_per_group(t.customer, "c_nationkey", "c_custkey", 3, 7).select((F.col("c_custkey") + 1000).alias("id"))
    require_empty(picks.join(nodes, "id", "left_anti"), "picks without a node")
    return picks.agg(F.countDistinct("id").alias("picks"))


@query("SELECT n_nationkey, word, place FROM (SELECT n_nationkey, unnest(string_split(n_name, '_')) AS word, generate_subscripts(string_split(n_name, '_'), 1) - 1 AS place FROM nation) WHERE word <> ''")
def src9_row_expanding_hook(t: Tables) -> DataFrame:
    from pyspark.sql.functions import udtf

    @udtf(returnType="word: string, place: long")
    class Words:
        def eval(self, name: str):
            for k, w in enumerate(name.split("_")):
                if w:
                    yield w, k

    t.spark.udtf.register("name_words", Words)
    t.nation.createOrReplaceTempView("_nation_names")
    return t.spark.sql("SELECT n_nationkey, word, place FROM _nation_names, LATERAL name_words(n_name)")


@query("SELECT l_orderkey, l_linenumber * 2 AS twice FROM lineitem WHERE l_quantity = 50 AND l_linestatus = 'F'")
def u1_text_expressions(t: Tables) -> DataFrame:
    return filter_rows(t.lineitem, {"twice": "l_linenumber * 2"}, "l_quantity = 50 AND l_linestatus = 'F'", ["l_orderkey", "twice"])


@query(f"{CLOSURE} SELECT anc_id AS id, max(c.id) AS result FROM closure c GROUP BY 1")
def u3_reduction_argument(t: Tables) -> DataFrame:
    nodes, pairs = both(t)
    return tree.reduce_up(nodes.withColumn("x", F.col("id")), pairs, "x", F.max("x"))


@query("SELECT doc_id AS old_id, count(*) AS n FROM (SELECT doc_id, unnest(range(0, length(text) - 99, 100)) AS s, length(text) AS len FROM documents WHERE length(text) >= 100) WHERE s < 100 * (doc_id % 3 + 1) GROUP BY 1")
def u5_shred_count_argument(t: Tables) -> DataFrame:
    f = kmers.shred(t.documents, "doc_id", "text", 100)
    return f.filter(F.col("start") < 100 * (F.col("old_id") % 3 + 1)).groupBy("old_id").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment AS seg, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def snk11_named_table(t: Tables) -> DataFrame:
    t.customer.filter("c_acctbal > 0").createOrReplaceTempView("_paying_customers")
    return t.spark.sql("SELECT c_mktsegment AS seg, count(*) AS n FROM _paying_customers GROUP BY 1")


@query("SELECT r_regionkey::VARCHAR || '~' || r_name AS line FROM region")
def snk3_custom_terminators(t: Tables) -> DataFrame:
    at = scratch(t)
    t.region.write.option("lineSep", ";").csv(at, sep="~")
    return t.spark.read.option("lineSep", ";").text(at).select(F.col("value").alias("line"))


@query(f"WITH {TREE} SELECT id, idpar, rank, name, CASE rank WHEN 'customer' THEN 20 WHEN 'region' THEN 90 END AS level FROM tree")
def snk9_tree_tables(t: Tables) -> DataFrame:
    at, (n, pairs) = scratch(t), both(t)
    writers.write_tree_tables(n, pairs, at, {"customer": 20, "region": 90}, t.customer.select((F.col("c_custkey") + 1000).alias("id"), "c_acctbal"))
    read = t.spark.read.parquet
    return read(f"{at}/nodes").join(read(f"{at}/names"), "id").join(F.broadcast(read(f"{at}/levels")), "rank", "left").select("id", "idpar", "rank", "name", "level")


@query(f"""{CLOSURE}, size AS (SELECT anc_id AS id, count(*) AS size FROM closure GROUP BY 1), prior AS (SELECT t.id, coalesce(sum(size) OVER (PARTITION BY idpar ORDER BY t.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM tree t JOIN size USING (id)),
    l AS (SELECT c.id, (2 * sum(b) + max(dist) + 1)::BIGINT AS lnest FROM closure c JOIN prior p ON c.anc_id = p.id GROUP BY 1)
    SELECT id, lnest, CASE t.rank WHEN 'customer' THEN 20 WHEN 'region' THEN 90 ELSE 0 END AS level, (SELECT arg_min(a.rank, dist) FROM closure c JOIN tree a ON anc_id = a.id WHERE c.id = t.id AND a.rank IN ('customer', 'region')) AS ranked, c_acctbal FROM tree t JOIN l USING (id) LEFT JOIN customer ON id = c_custkey + 1000""")
def snk9_levels_and_attributes(t: Tables) -> DataFrame:
    at, (n, pairs) = scratch(t), both(t)
    writers.write_tree_tables(n, pairs, at, {"customer": 20, "region": 90}, t.customer.select((F.col("c_custkey") + 1000).alias("id"), "c_acctbal"))
    read = t.spark.read.parquet
    return read(f"{at}/nodes").select("id", "lnest").join(read(f"{at}/node_levels"), "id").join(read(f"{at}/attributes"), "id", "left")


@query("SELECT c_custkey AS gi, (c_nationkey + 100)::INT AS taxid FROM customer")
def src6_gi_taxids(t: Tables) -> DataFrame:
    from cladeflow.sources import readers

    at = scratch(t)
    writers.write_report(t.customer.select("c_custkey", F.col("c_nationkey") + 100), at, header=False)
    return readers.read_gi_taxids(t.spark, at)


@query("SELECT left(r_name, 1) AS cat, (10 + r_regionkey)::BIGINT AS anc_id, (100 + n_nationkey)::BIGINT AS taxid FROM nation JOIN region ON n_regionkey = r_regionkey")
def src7_categories(t: Tables) -> DataFrame:
    from cladeflow.sources import readers

    at = scratch(t)
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    writers.write_report(n.select(F.left("r_name", F.lit(1)), F.col("r_regionkey") + 10, F.col("n_nationkey") + 100), at, header=False)
    return readers.read_categories(t.spark, at)
