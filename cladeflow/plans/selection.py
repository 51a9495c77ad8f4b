"""Records and sources: filters, joins, aggregates, windows and sets over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.functions import columns as fn
from cladeflow.operators import relational as op
from cladeflow.plans.registry import Tables, query


def money(c: str):
    """Amounts have two digits; as decimals their sums don't depend on the order."""
    return F.col(c).cast("decimal(18,2)")


KINDS = {"ring": 1, "widget": 2, "bolt": 4, "gear": 8}


@query("SELECT l_orderkey, l_partkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'R'")
def f1_filter_rows(t: Tables) -> DataFrame:
    return op.filter_rows(t.lineitem, {"net": "l_extendedprice * (1 - l_discount)"}, "l_quantity > 30 AND l_returnflag = 'R'", ["l_orderkey", "l_partkey", "net"])


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(text) >= 500 AND length(text) < 2000")
def f2_length_range(t: Tables) -> DataFrame:
    return op.with_length(t.documents, "text", 500, 2000).select("doc_id", F.length("text").cast("long").alias("n"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0) AND length(text) >= 300")
def f3_listed_and_long(t: Tables) -> DataFrame:
    return op.with_length(op.keep_listed(t.documents, t.labels.filter("toxic = 0"), "doc_id"), "text", 300).select("doc_id", "lang")


@query("""SELECT doc_id FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '[^A-Za-z]', '', 'g'), '[Nn]+', 'N', 'g') AS s FROM documents)
          WHERE length(s) > 0 AND length(regexp_replace(s, '[^ACGTacgt]', '', 'g')) / length(s) >= 0.25""")
def f4_specific_share(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.regexp_replace("text", "[^A-Za-z]", "").alias("s")).filter((F.length("s") > 0) & (fn.nonspecific_share(F.col("s")) >= 0.25)).select("doc_id")


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[aeiou ]', 'N', 'g'), '([Nn]{2})[Nn]+', '\\1', 'g')) AS clipped FROM documents")
def f5_clip_runs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(fn.clip_runs(F.regexp_replace("text", "[aeiou ]", "N"), 2)).alias("clipped"))


@query("""SELECT p_partkey, mask FROM (SELECT p_partkey, (p_name LIKE '%ring%')::INT + 2 * (p_name LIKE '%widget%')::INT + 4 * (p_name LIKE '%bolt%')::INT + 8 * (p_name LIKE '%gear%')::INT AS mask FROM part)
          WHERE mask & 6 <> 0""")
def f6_element_kinds(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", op.element_kind(F.col("p_name"), KINDS).alias("mask")).filter(F.col("mask").bitwiseAND(6) != 0)


@query("SELECT DISTINCT p_partkey FROM part WHERE regexp_matches(lower(p_name), '(red|blue)') AND NOT regexp_matches(lower(p_name), 'bolt|gear')")
def f7_keywords(t: Tables) -> DataFrame:
    name = F.lower("p_name")
    return t.part.filter(name.rlike("(red|blue)") & ~name.rlike("bolt|gear")).select("p_partkey").distinct()


@query("""WITH w AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ') || ' ' AS t FROM documents)
    SELECT 'wanted' AS rule, doc_id AS id FROM w WHERE (t LIKE '% of the %' OR t LIKE '% de la %' OR t LIKE '% und die %') AND t NOT LIKE '% and the %' AND t NOT LIKE '% the of %'
    UNION ALL SELECT 'both', doc_id FROM w WHERE t LIKE '% in %' AND t LIKE '% the in %' AND t LIKE '% of %'""")
def f7_phrases(t: Tables) -> DataFrame:
    rules = {"wanted": {"any": ["of the", "de la", "UND die"], "none": ["and the", "the of"]}, "both": {"all": ["in", "the, in", "of"]}}
    return op.boolean_matches(t.documents, "doc_id", "text", rules)


@query("""SELECT p_partkey, split_part(p_name, ' ', 1) AS db, regexp_extract(p_brand, '#(\\d+)', 1) AS acc, substr(p_type, 1, 2) AS kind FROM part""")
def f8_header_fields(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.split("p_name", " ")[0].alias("db"), F.regexp_extract("p_brand", r"#(\d+)", 1).alias("acc"), F.substring("p_type", 1, 2).alias("kind"))


@query("SELECT count(*) AS hits, count(DISTINCT l_partkey) AS parts FROM lineitem WHERE l_quantity >= 20 AND l_extendedprice >= 30000 AND l_discount <= 0.05 AND l_tax < 0.04")
def f9_hit_thresholds(t: Tables) -> DataFrame:
    ok = fn.all_of([F.col("l_quantity") >= 20, F.col("l_extendedprice") >= 30000, F.col("l_discount") <= 0.05, F.col("l_tax") < 0.04])
    return t.lineitem.filter(ok).agg(F.count("*").alias("hits"), F.countDistinct("l_partkey").alias("parts"))


@query("SELECT o_orderkey, md5(o_orderkey || ':11') AS place FROM orders")
def f13_shuffled(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", fn.seeded("o_orderkey", 11).alias("place")).orderBy("place", "o_orderkey")


@query("SELECT 'GOS_' || s_suppkey AS id FROM supplier WHERE s_acctbal > 1000 AND s_acctbal < 9000 AND s_nationkey IN (1, 2, 3, 5, 8, 13)")
def f17_select_scaffolds(t: Tables) -> DataFrame:
    return t.supplier.filter((F.col("s_acctbal") > 1000) & (F.col("s_acctbal") < 9000) & F.col("s_nationkey").isin(1, 2, 3, 5, 8, 13)).select(F.concat(F.lit("GOS_"), "s_suppkey").alias("id"))


@query("""SELECT p_partkey, CASE WHEN p_name LIKE '%ring%' THEN 'fastener' WHEN p_name LIKE '%gear%' THEN 'drive' ELSE regexp_extract(p_name, '^(\\w+)', 1) END AS class FROM part""")
def f18_name_classes(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.when(F.col("p_name").rlike("ring"), "fastener").when(F.col("p_name").rlike("gear"), "drive").otherwise(F.regexp_extract("p_name", r"^(\w+)", 1)).alias("class"))


@query("SELECT p_partkey, trim(split_part(replace(p_name || '||' || p_type, 'small', ''), '||', 1)) AS clean FROM part")
def f19_clean_names(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.trim(F.substring_index(F.replace(F.concat("p_name", F.lit("||"), "p_type"), F.lit("small"), F.lit("")), "||", 1)).alias("clean"))


@query("SELECT doc_id, quality FROM labels WHERE quality IN (1)")
def f20_labels_in(t: Tables) -> DataFrame:
    return t.labels.filter(F.col("quality").isin(1)).select("doc_id", F.col("quality"))


@query("""SELECT o_custkey, l_returnflag, count(*) AS n, sum(l_quantity)::BIGINT AS len FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND date_trunc('year', l_shipdate) = date_trunc('year', o_orderdate) GROUP BY 1, 2""")
def j1_equi_join(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    on = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.year("l_shipdate") == F.col("y"))
    return t.lineitem.select("l_orderkey", "l_returnflag", "l_quantity", "l_shipdate").join(o, on).groupBy("o_custkey", "l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("len"))


@query("SELECT c_custkey, n_name, r_name, count(o_orderkey) AS orders FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2, 3")
def j2_left_chain(t: Tables) -> DataFrame:
    counted = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    found = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return found.join(counted, "c_custkey", "left").select("c_custkey", "n_name", "r_name", F.coalesce("orders", F.lit(0).cast("long")).alias("orders"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def j3_semi_join(t: Tables) -> DataFrame:
    return op.keep_listed(t.customer, t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def j4_anti_join(t: Tables) -> DataFrame:
    return op.drop_listed(t.customer, t.orders.filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) = 1")
def j6_longest_per_key(t: Tables) -> DataFrame:
    return op.longest_per_key(t.orders, "o_custkey", "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT o_orderkey FROM orders o WHERE o_orderstatus = 'P' AND o_totalprice * 2 > ALL (SELECT i.o_totalprice FROM orders i WHERE i.o_custkey = o.o_custkey AND i.o_orderstatus = 'F')""")
def j7_outweighing(t: Tables) -> DataFrame:
    return op.outweighing(t.orders.filter("o_orderstatus = 'P'"), t.orders.filter("o_orderstatus = 'F'"), "o_custkey", "o_totalprice", 2).select("o_orderkey")


@query("SELECT a.o_orderkey AS big, b.o_orderkey AS tiny FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_totalprice > 5 * b.o_totalprice AND b.o_totalprice < 20000")
def j8_ratio_join(t: Tables) -> DataFrame:
    o = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return op.dwarfing(o, o, "o_custkey", "o_totalprice", 5, 20000).select(F.col("x.o_orderkey").alias("big"), F.col("y.o_orderkey").alias("tiny"))


@query("SELECT l_partkey, l_suppkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY 1, 2")
def j9_unique_by_key(t: Tables) -> DataFrame:
    return op.unique_by(t.lineitem.select("l_partkey", "l_suppkey", "l_orderkey"), ["l_partkey", "l_suppkey"], "l_orderkey")


@query("SELECT s_suppkey, coalesce(b.bal, s_acctbal) AS s_acctbal FROM supplier LEFT JOIN (SELECT c_custkey AS k, c_acctbal AS bal FROM customer WHERE c_mktsegment = 'BUILDING') b ON s_suppkey = k")
def j10_update_join(t: Tables) -> DataFrame:
    new = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_acctbal").alias("s_acctbal"))
    return op.update_from(t.supplier, new, "s_suppkey", "s_acctbal").select("s_suppkey", "s_acctbal")


@query("""SELECT cn.n_name AS customer_nation, sn.n_name AS supplier_nation, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
          JOIN supplier ON l_suppkey = s_suppkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY 1, 2""")
def j11_same_dimension_twice(t: Tables) -> DataFrame:
    pairs = t.lineitem.select("l_orderkey", "l_suppkey").join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    counted = pairs.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey").groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("n"))
    c, s = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("customer_nation")), t.nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("supplier_nation"))
    return counted.join(c, "c_nationkey").join(s, "s_nationkey").select("customer_nation", "supplier_nation", "n")


@query("SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def j12_mandatory_match(t: Tables) -> DataFrame:
    return op.must_match(t.nation.withColumnRenamed("n_regionkey", "r_regionkey"), t.region, "r_regionkey").select("n_nationkey", "r_name")


@query("SELECT d.doc_id, lang, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j13_labels_left(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left")


@query("SELECT c_custkey, CASE WHEN c_nationkey < 10 THEN c_nationkey + 10 ELSE c_nationkey END AS assigned FROM customer")
def j14_transitive_ids(t: Tables) -> DataFrame:
    moved = t.nation.filter("n_nationkey < 10").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_nationkey") + 10).alias("to"))
    return t.customer.join(moved, "c_nationkey", "left").select("c_custkey", F.coalesce("to", "c_nationkey").alias("assigned"))


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN p.p_size IS NULL THEN 'missing' WHEN p.p_size = 0 THEN 'zero' WHEN n.n_nationkey IS NULL THEN 'no node' ELSE 'ok' END AS status
          FROM lineitem LEFT JOIN (SELECT p_partkey, p_size % 30 AS p_size FROM part WHERE p_type <> 'PROMO') p ON l_partkey = p_partkey LEFT JOIN nation n ON p_size = n_nationkey) GROUP BY 1""")
def j15_lookup_status(t: Tables) -> DataFrame:
    lookup = t.part.filter("p_type <> 'PROMO'").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") % 30).alias("p_size"))
    return op.status_of(t.lineitem.select("l_partkey"), lookup, t.nation, "l_partkey", "p_size", "n_nationkey").groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey AS contig, o_orderpriority AS tag, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def j16_reads_by_contig_and_tag(t: Tables) -> DataFrame:
    once = t.lineitem.select("l_orderkey", F.col("l_suppkey").alias("contig")).distinct()
    return once.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("tag")), "l_orderkey").groupBy("contig", "tag").agg(F.count("*").alias("n"))


@query("SELECT l_partkey, count(DISTINCT c_nationkey) AS nations FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def j17_peptide_read_assembly(t: Tables) -> DataFrame:
    chain = t.lineitem.select("l_partkey", F.col("l_orderkey").alias("o_orderkey")).join(t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")), "o_orderkey").join(t.customer.select("c_custkey", "c_nationkey"), "c_custkey")
    return chain.groupBy("l_partkey").agg(F.countDistinct("c_nationkey").alias("nations"))


@query("SELECT a.o_orderkey AS id, a.o_orderpriority AS was, b.o_orderpriority AS now FROM orders a JOIN orders b ON a.o_orderkey + 1 = b.o_orderkey WHERE a.o_orderpriority <> b.o_orderpriority")
def j20_changed_assignments(t: Tables) -> DataFrame:
    a = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("was"))
    b = t.orders.select((F.col("o_orderkey") - 1).alias("id"), F.col("o_orderpriority").alias("now"))
    return a.join(b, "id").filter("was <> now")


@query("""WITH q AS (SELECT vec_id AS id_q, embedding AS v FROM embeddings WHERE label = 3),
          d AS (SELECT id_q, vec_id, label, sqrt(list_sum(list_transform(list_zip(v, embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))) AS dist FROM q, embeddings WHERE id_q <> vec_id),
          n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY id_q ORDER BY dist, vec_id) <= 7),
          v AS (SELECT id_q, label, count(*) AS votes FROM n GROUP BY 1, 2)
          SELECT id_q, label, votes FROM v QUALIFY row_number() OVER (PARTITION BY id_q ORDER BY votes DESC, label) = 1""")
def j21_nearest_neighbours(t: Tables) -> DataFrame:
    e = t.embeddings
    return op.nearest_neighbours(e.filter("label = 3"), e, 7, "vec_id", "embedding", "label")


@query("""WITH s AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 1 ELSE o_orderkey - 1 END AS mate, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS label FROM orders)
          SELECT count(*) AS pairs, sum((a.label = b.label)::INT)::BIGINT AS same, sum((a.label <> 0 AND b.label <> 0)::INT)::BIGINT AS sure, sum((a.label <> 0 AND a.label = b.label)::INT)::BIGINT AS sure_same FROM s a JOIN s b ON a.mate = b.id AND a.id < b.id""")
def j22_mate_concordance(t: Tables) -> DataFrame:
    label = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(0)
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") + 1).otherwise(F.col("o_orderkey") - 1).alias("mate"), label.alias("label"))
    return op.mate_concordance(rows, "id", "mate", "label")


@query("""SELECT l_orderkey, l_partkey, least(l_quantity, 25.0) AS score, least(l_linenumber * 10, l_partkey) AS b, greatest(l_linenumber * 10, l_partkey) AS e, o_orderpriority AS evidence
          FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND l_returnflag = left(o_orderstatus, 1) WHERE l_tax = 0""")
def j23_enrich_hits(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.substring("o_orderstatus", 1, 1).alias("l_returnflag"), F.col("o_orderpriority").alias("evidence"))
    ten = F.col("l_linenumber").cast("long") * 10
    return t.lineitem.filter("l_tax = 0").join(o, ["l_orderkey", "l_returnflag"], "left").select("l_orderkey", "l_partkey", F.least("l_quantity", F.lit(25.0)).alias("score"), F.least(ten, "l_partkey").alias("b"), F.greatest(ten, "l_partkey").alias("e"), "evidence")


@query("SELECT l_returnflag, l_linestatus, l_suppkey, count(*) AS n, sum(l_quantity)::BIGINT AS len FROM lineitem GROUP BY 1, 2, 3")
def a1_source_groups(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus", "l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("len"))


@query("SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1 HAVING count(*) > 1 AND max(o_totalprice) >= 400000")
def a2_having(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top")).filter("n > 1 AND top >= 400000")


@query("SELECT l_partkey, floor(sum(l_quantity) / 100)::BIGINT AS samples FROM lineitem GROUP BY 1 HAVING floor(sum(l_quantity) / 100) > 0")
def a3_sample_counts(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey").agg(F.floor(F.sum("l_quantity") / 100).alias("samples")).filter("samples > 0")


@query("SELECT l_returnflag, sum(q)::DOUBLE / count(*) AS mean FROM (SELECT l_returnflag, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def a4_mean_of_sums(t: Tables) -> DataFrame:
    sums = t.lineitem.groupBy("l_returnflag", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    return sums.groupBy("l_returnflag").agg((F.sum("q") / F.count("*")).alias("mean"))


@query("""SELECT r_name, n_name, grouping_id(r_name, n_name)::BIGINT AS level, count(*) AS n, sum(c_acctbal::DECIMAL(18, 2))::DOUBLE AS weight
          FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def a5_rollup(t: Tables) -> DataFrame:
    by_nation = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"), F.sum(money("c_acctbal")).alias("weight"))
    named = by_nation.join(t.nation, "n_nationkey").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return named.rollup("r_name", "n_name").agg(F.grouping_id().cast("long").alias("level"), F.sum("n").alias("n"), F.sum("weight").cast("double").alias("weight"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def a6_distinct(t: Tables) -> DataFrame:
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct()


@query("SELECT l_suppkey AS model, count(*) AS n, sum(l_quantity)::BIGINT AS weight, sum(l_extendedprice::DECIMAL(18, 2))::DOUBLE AS len, sum((l_tax * 100)::INT)::DOUBLE / count(*) AS score, min(s_name) AS name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def a7_model_summary(t: Tables) -> DataFrame:
    sums = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("weight"), F.sum(money("l_extendedprice")).cast("double").alias("len"), (F.sum(F.round(F.col("l_tax") * 100).cast("int")) / F.count("*")).alias("score"))
    return sums.join(t.supplier.select("s_suppkey", "s_name"), "s_suppkey").select(F.col("s_suppkey").alias("model"), "n", "weight", "len", "score", F.col("s_name").alias("name"))


@query("SELECT o_orderpriority AS name, count(*) AS n FROM orders GROUP BY 1")
def a10_count_by_name(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name")


@query("""SELECT o_orderpriority, count(*) AS n FROM (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity) AS ratio FROM lineitem GROUP BY 1)
          JOIN orders ON l_orderkey = o_orderkey WHERE ratio >= 0.2 GROUP BY 1""")
def a11_thresholded_ratio(t: Tables) -> DataFrame:
    ratio = t.lineitem.groupBy("l_orderkey").agg((F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0)) / F.sum("l_quantity")).alias("ratio")).filter("ratio >= 0.2")
    return ratio.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT contig, floor(count(*) * 0.5 + 0.5)::BIGINT AS reads FROM (SELECT unnest([l_partkey, l_suppkey]) AS contig FROM lineitem) GROUP BY 1")
def a13_contig_reads(t: Tables) -> DataFrame:
    return op.half_counts(t.lineitem, ["l_partkey", "l_suppkey"])


@query("SELECT l_quantity AS value, count(*) AS n FROM lineitem GROUP BY 1")
def a15_bincount(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_quantity").alias("value")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS parts FROM lineitem GROUP BY 1")
def a16_grouped_in_order(t: Tables) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(items, lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


@query("SELECT o_orderkey, o_custkey FROM orders")
def a17_unique_index(t: Tables) -> DataFrame:
    return op.require_unique(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey"])


@query("""SELECT o_custkey, o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
          QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey DESC) = 1""")
def a18_priority_cascade(t: Tables) -> DataFrame:
    return op.priority_cascade(t.orders, "o_custkey", "o_orderpriority", "o_totalprice", "o_orderkey", ["1-URGENT", "2-HIGH", "3-MEDIUM"]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("SELECT source, count(*) AS n, sum(length(text))::BIGINT AS len, sum(length(regexp_replace(text, '[Nn]', '', 'g')))::BIGINT AS len_known FROM documents GROUP BY source UNION ALL SELECT 'total', count(*), sum(length(text))::BIGINT, sum(length(regexp_replace(text, '[Nn]', '', 'g')))::BIGINT FROM documents")
def a19_lengths_by_group(t: Tables) -> DataFrame:
    sums = t.documents.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("len"), F.sum(F.length(F.regexp_replace("text", "[Nn]", ""))).alias("len_known"))
    return sums.unionByName(sums.agg(F.lit("total").alias("source"), F.sum("n").alias("n"), F.sum("len").alias("len"), F.sum("len_known").alias("len_known")))


@query("SELECT l_suppkey, sum(l_quantity) / count(*) AS mean, round(stddev_pop(l_quantity), 6) AS sd FROM lineitem GROUP BY 1")
def a20_background(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg((F.sum("l_quantity") / F.count("*")).alias("mean"), F.round(F.stddev_pop("l_quantity"), 6).alias("sd"))


@query("SELECT (SELECT count(*) FROM lineitem WHERE l_quantity < 0) AS negative, (SELECT count(*) FROM (SELECT * FROM region EXCEPT ALL SELECT * FROM region)) AS differing")
def a21_assertions(t: Tables) -> DataFrame:
    bad = t.lineitem.filter("l_quantity < 0")
    op.require_empty(bad, "negative quantities")
    return bad.agg(F.count("*").alias("negative")).join(t.region.exceptAll(t.region).agg(F.count("*").alias("differing")))


@query("SELECT (length(text) // 100)::BIGINT AS bin, count(*) AS n FROM documents GROUP BY 1")
def a22_length_histogram(t: Tables) -> DataFrame:
    return op.histogram(t.documents, F.length("text"), 100)


@query("""SELECT s AS stage, c AS category, k AS kind, grouping_id(s, c, k)::BIGINT AS level, count(*) AS n FROM (SELECT DISTINCT l_linestatus AS s, l_suppkey % 7 AS c, l_returnflag AS k, l_partkey FROM lineitem)
          GROUP BY GROUPING SETS ((s), (s, c), (k, c))""")
def a23_source_report(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_linestatus").alias("stage"), (F.col("l_suppkey") % 7).alias("category"), F.col("l_returnflag").alias("kind"), "l_partkey")
    return op.source_report(rows, "kind", "stage", "l_partkey", "category")


@query("SELECT l_orderkey, l_suppkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_suppkey) = 1")
def w1_best_model(t: Tables) -> DataFrame:
    best = F.max(F.struct("l_extendedprice", (-F.col("l_suppkey")).alias("minus")))
    return t.lineitem.groupBy("l_orderkey").agg(best.alias("b")).select("l_orderkey", (-F.col("b.minus")).alias("l_suppkey"), F.col("b.l_extendedprice").alias("l_extendedprice"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS place FROM lineitem QUALIFY place <= 3")
def w2_top_scores(t: Tables) -> DataFrame:
    at = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", F.row_number().over(at).cast("long").alias("place")).filter("place <= 3")


@query("SELECT user_id, arg_max(event_type, (value, -event_id)) AS best, max(value) AS score FROM events GROUP BY 1")
def w3_best_so_far(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("value", -F.col("event_id"))).alias("best"), F.max("value").alias("score"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY md5(l_orderkey || ':5'), l_orderkey ROWS UNBOUNDED PRECEDING) AS running FROM (SELECT l_suppkey, l_orderkey, min(l_linenumber) AS l_linenumber, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2) QUALIFY running <= 300")
def w4_fill_to_limit(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy("l_suppkey", "l_orderkey").agg(F.min("l_linenumber").alias("l_linenumber"), F.sum("l_quantity").alias("q"))
    return op.fill_to_limit(rows, "l_suppkey", "l_orderkey", "q", 300, 5).select("l_suppkey", "l_orderkey", "l_linenumber", "running")


@query("""SELECT o_custkey, o_orderkey, o_orderstatus || CASE WHEN count(*) OVER (PARTITION BY o_custkey, o_orderstatus) = 1 THEN '' ELSE row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey)::VARCHAR END AS element FROM orders""")
def w5_number_elements(t: Tables) -> DataFrame:
    return op.number_elements(t.orders, "o_custkey", "o_orderstatus", "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", "element")


@query("SELECT o_orderpriority, n, sum(n) OVER (ORDER BY o_orderpriority)::BIGINT AS cum, round(100.0 * sum(n) OVER (ORDER BY o_orderpriority) / sum(n) OVER (), 4)::DOUBLE AS pct FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)")
def w6_cumulative(t: Tables) -> DataFrame:
    n = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    cum = F.sum("n").over(Window.orderBy("o_orderpriority"))
    return n.select("o_orderpriority", "n", cum.alias("cum"), F.round(100.0 * cum / F.sum("n").over(Window.partitionBy()), 4).alias("pct"))


@query("""WITH s AS (SELECT user_id, event_id, value > 10 AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
          k AS (SELECT *, r - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM s WHERE f)
          SELECT user_id, min(event_id) AS start, max(event_id) AS "end", count(*) AS n FROM k GROUP BY user_id, run""")
def w7_runs(t: Tables) -> DataFrame:
    return op.runs_of_true(t.events.select("user_id", "event_id", "value"), ["user_id"], "event_id", F.col("value") > 10)


@query("SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) = 1")
def w8_first_record(t: Tables) -> DataFrame:
    return op.first_by(t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey"), ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey"])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_extendedprice / l_quantity - mean) / sd * sqrt(l_quantity / 25), 5) AS z FROM lineitem
          JOIN (SELECT l_suppkey, avg(l_extendedprice / l_quantity) AS mean, stddev_pop(l_extendedprice / l_quantity) AS sd FROM lineitem GROUP BY 1 HAVING sd > 0) USING (l_suppkey)""")
def w10_z_scores(t: Tables) -> DataFrame:
    rate = F.col("l_extendedprice") / F.col("l_quantity")
    stats = t.lineitem.groupBy("l_suppkey").agg(F.avg(rate).alias("mean"), F.stddev_pop(rate).alias("sd")).filter("sd > 0")
    return t.lineitem.join(stats, "l_suppkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round((rate - F.col("mean")) / F.col("sd") * F.sqrt(F.col("l_quantity") / 25), 5).alias("z"))


@query("""WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS j, unnest(embedding)::DOUBLE AS x FROM embeddings)
          SELECT vec_id, round(sum(((x - m) / s) ** 2), 6) AS norm2 FROM e JOIN (SELECT j, avg(x) AS m, stddev_pop(x) AS s FROM e GROUP BY 1) USING (j) GROUP BY 1""")
def w11_standardised(t: Tables) -> DataFrame:
    e = t.embeddings.select("vec_id", F.posexplode("embedding").alias("j", "x")).withColumn("x", F.col("x").cast("double"))
    stats = e.groupBy("j").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    z = (F.col("x") - F.col("m")) / F.col("s")
    return e.join(F.broadcast(stats), "j").groupBy("vec_id").agg(F.round(F.sum(z * z), 6).alias("norm2"))


@query("SELECT l_orderkey, l_returnflag, max(l_tax) AS conf FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2 UNION ALL SELECT l_orderkey, l_returnflag, l_tax FROM lineitem WHERE l_returnflag = 'N'")
def w12_best_per_type(t: Tables) -> DataFrame:
    items = t.lineitem.select("l_orderkey", "l_returnflag", F.col("l_tax").alias("conf"), "l_linenumber")
    best = op.first_by(items.filter("l_returnflag = 'A'"), ["l_orderkey", "l_returnflag"], [F.desc("conf"), F.col("l_linenumber")])
    return best.unionByName(items.filter("l_returnflag = 'N'")).drop("l_linenumber")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def s1_multi_key_sort(t: Tables) -> DataFrame:
    order = [F.desc(F.col("o_orderstatus") == "F"), F.col("o_custkey"), F.col("o_orderkey")]
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus").orderBy(*order)


@query("SELECT o_custkey, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS total FROM orders GROUP BY 1 ORDER BY total DESC, o_custkey LIMIT 20")
def s2_top_k(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.sum(money("o_totalprice")).cast("double").alias("total")).orderBy(F.desc("total"), "o_custkey").limit(20)


@query("SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || ':3'), o_orderkey LIMIT 200")
def s3_random_sample(t: Tables) -> DataFrame:
    return t.orders.orderBy(fn.seeded("o_orderkey", 3), "o_orderkey").limit(200).select("o_orderkey")


@query("SELECT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R' UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def so1_union(t: Tables) -> DataFrame:
    return t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")).unionByName(t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))).distinct()


@query("SELECT c_custkey AS id, c_acctbal AS bal, 'customer' AS src FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 'supplier' FROM supplier")
def so2_append_tagged(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"))
    return op.union_tagged({"customer": c, "supplier": t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"))}, "src")


@query("SELECT l_returnflag AS id_samp, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2")
def so3_merge_runs(t: Tables) -> DataFrame:
    return op.union_tagged({f: t.lineitem.filter(F.col("l_returnflag") == f).groupBy("l_suppkey").agg(F.count("*").alias("n")) for f in ("A", "N", "R")}, "id_samp")


@query("""WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R')
          SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS both, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_a""")
def so4_leak_check(t: Tables) -> DataFrame:
    a, b = (t.lineitem.filter(F.col("l_returnflag") == f).select("l_partkey").distinct() for f in "AR")
    return a.intersect(b).agg(F.count("*").alias("both")).join(a.subtract(b).agg(F.count("*").alias("only_a")))


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = (SELECT count(DISTINCT o_orderstatus) FROM orders))")
def so5_in_all_splits(t: Tables) -> DataFrame:
    return op.in_all_splits(t.orders, "o_custkey", "o_orderstatus").select("o_custkey", "o_orderkey")


@query("SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def so6_wanted_models(t: Tables) -> DataFrame:
    return op.keep_listed(t.lineitem.select("l_suppkey").distinct(), t.supplier.filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey")


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def snk2_pivot(t: Tables) -> DataFrame:
    return op.pivot_report(t.orders, "o_orderpriority", "o_orderstatus", F.count(F.lit(1)), ["F", "O", "P"])


@query("SELECT o_orderpriority, coalesce(printf('%.2f', sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P')::DOUBLE), 'X') AS P, coalesce(printf('%.2f', sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F')::DOUBLE), 'X') AS F FROM orders GROUP BY 1")
def snk2_formatted_pivot(t: Tables) -> DataFrame:
    return op.pivot_report(t.orders, "o_orderpriority", "o_orderstatus", F.sum(F.col("o_totalprice").cast("decimal(18,2)")), ["P", "F"], "X", "%.2f")


@query("""SELECT p_partkey, md5(translate(reverse(translate(lower(regexp_replace(p_name, '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')), 'ACGTacgt', 'TGCAtgca')) AS rc,
          regexp_replace(p_name, '[^A-Za-z0-9_.-]', '_', 'g') AS safe, lpad(bin(p_size), 8, '0') AS bits, (floor(p_retailprice) + CASE WHEN p_retailprice - floor(p_retailprice) > ('0x' || substr(md5(p_partkey || ':9'), 1, 8))::BIGINT / 4294967296.0 THEN 1 ELSE 0 END)::BIGINT AS rounded,
          regexp_replace(p_name, '([el])[el]+', '\\1', 'g') AS collapsed, md5(p_partkey || ':u') AS uid FROM part""")
def x_scalar_functions(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey",
        F.md5(fn.reverse_complement(fn.sequence_of(F.col("p_name")))).alias("rc"),
        fn.file_safe(F.col("p_name")).alias("safe"),
        fn.bits(F.col("p_size")).alias("bits"),
        fn.probabilistic_round(F.col("p_retailprice"), "p_partkey", 9).alias("rounded"),
        fn.collapse_runs(F.col("p_name"), "el").alias("collapsed"),
        fn.seeded("p_partkey", "u").alias("uid"),
    )


@query("SELECT o_custkey, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1, 2")
def src10_pairs_as_table(t: Tables) -> DataFrame:
    n = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    maps = n.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "n"))).alias("entries"))
    return op.pairs_table(maps, "entries", "priority", "n", "o_custkey")


@query("SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS quantity FROM lineitem")
def src11_records_as_table(t: Tables) -> DataFrame:
    records = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("double").alias("quantity"))).alias("records"))
    return op.records_table(records, "records", "l_orderkey")
