"""Registered queries: tables written as files and read again, and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.operators.common import shared_folder
from cladeflow.plans.registry import Tables, query
from cladeflow.plans.sequences import seqs, seqs_sql
from cladeflow.plans.trees import TREE, nodes_of
from cladeflow.sources import readers, writers
from cladeflow.streaming import scores


def scratch(t: Tables) -> str:
    """A new folder beside the checkpoints."""
    return f"{shared_folder(t.spark)}/files-{uuid.uuid4().hex}"


@query(f"WITH {seqs_sql()} SELECT doc_id::VARCHAR AS id, md5(seq) AS digest FROM seqs WHERE length(seq) > 0")
def src1_fasta_again(t: Tables) -> DataFrame:
    s, at = seqs(t).filter("length(seq) > 0"), scratch(t)
    writers.write_fasta(s, at, F.concat(F.col("doc_id").cast("string"), F.lit(" "), "source"), "seq")
    return readers.read_fasta(t.spark, at).select("id", F.md5("seq").alias("digest"))


@query(f"WITH {seqs_sql()} SELECT source, count(*) AS n, sum(length(seq))::BIGINT AS len FROM seqs WHERE length(seq) > 0 GROUP BY 1")
def snk5_split_by_group(t: Tables) -> DataFrame:
    s, at = seqs(t).filter("length(seq) > 0"), scratch(t)
    writers.write_fasta(s, at, F.col("doc_id").cast("string"), "seq", by="source")
    back = readers.read_fasta(t.spark, f"{at}/source=*", with_file=True)
    return back.groupBy(F.regexp_extract("file", "source=([^/]+)", 1).alias("source")).agg(F.count("*").alias("n"), F.sum(F.length("seq")).alias("len"))


@query(f"WITH {TREE} SELECT id, idpar, replace(rank, ' ', '_') AS rank, (id % 12)::INT AS divid FROM tree WHERE rank IS NOT NULL")
def src3_nodes_dump(t: Tables) -> DataFrame:
    at = scratch(t)
    n = nodes_of(t).filter("rank IS NOT NULL")
    parent = F.when(F.col("idpar") == 0, F.col("id")).otherwise(F.col("idpar"))
    writers.write_lines(n, F.concat(F.concat_ws("\t|\t", F.col("id").cast("string"), parent.cast("string"), "rank", F.lit(""), (F.col("id") % 12).cast("string")), F.lit("\t|")), at)
    return readers.read_nodes(t.spark, at)


@query(f"WITH {TREE} SELECT id, name FROM tree")
def src4_names_dump(t: Tables) -> DataFrame:
    at, n = scratch(t), nodes_of(t)
    line = lambda name, kind: F.concat(F.concat_ws("\t|\t", F.col("id").cast("string"), name, F.lit(""), F.lit(kind)), F.lit("\t|"))
    writers.write_lines(n, F.concat(line(F.col("name"), "scientific name"), F.lit("\n"), line(F.lower("name"), "synonym")), at)
    return readers.read_names(t.spark, at)


@query("SELECT c_custkey AS old_id, c_custkey + 1000 AS new_id FROM customer")
def src5_merged_dump(t: Tables) -> DataFrame:
    at = scratch(t)
    writers.write_lines(t.customer, F.concat_ws("", F.col("c_custkey").cast("string"), F.lit("\t|\t"), (F.col("c_custkey") + 1000).cast("string"), F.lit("\t|")), at)
    return readers.read_merged(t.spark, at)


@query("SELECT s_suppkey::INT AS id, s_name, s_nationkey::VARCHAR AS s_nationkey FROM supplier WHERE s_nationkey > 4")
def src8_table_with_overrides(t: Tables) -> DataFrame:
    at = scratch(t)
    writers.write_report(t.supplier.select("s_suppkey", "s_name", "s_nationkey"), at)
    return readers.read_table(t.spark, at, overrides={"s_suppkey": ("id", "int")}, where="s_nationkey > 4")


@query("SELECT n_regionkey || '_' || n_nationkey AS id_seq, 'm' || n_regionkey AS id, r_name AS name, (10 + n_regionkey)::BIGINT AS taxid FROM nation JOIN region ON n_regionkey = r_regionkey")
def src12_model_descriptions(t: Tables) -> DataFrame:
    at = scratch(t)
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    m = n.groupBy("n_regionkey", "r_name").agg(F.collect_list(F.concat_ws("_", F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string"))).alias("ids_seq"))
    m = m.select(F.struct("ids_seq", F.concat(F.lit("m"), F.col("n_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"), (F.col("n_regionkey") + 10).alias("taxid")).alias("m"))
    m.agg(F.collect_list("m").alias("models")).coalesce(1).write.json(at)
    return readers.read_models(t.spark, at)


@query(f"WITH {TREE} SELECT id, idpar, rank, name FROM tree")
def snk10_tree_json(t: Tables) -> DataFrame:
    at = scratch(t)
    writers.write_tree(nodes_of(t), at)
    return readers.read_tree(t.spark, at)


@query("SELECT l_orderkey::VARCHAR AS id_q, l_partkey::VARCHAR AS id_s, l_quantity / 100 AS ident, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END AS strand FROM lineitem")
def src14_hits(t: Tables) -> DataFrame:
    at = scratch(t)
    strand = F.when(F.col("l_returnflag") == "A", "Plus").when(F.col("l_returnflag") == "R", "Minus").otherwise("NULL")
    x = F.lit("1")
    fields = [F.col("l_orderkey"), F.lit("d"), x, F.lit("blastp"), F.lit("db"), F.col("l_partkey"), x, x, x, x, F.col("l_quantity"), x, x, x, x, F.lit("t"), x, strand, x, F.lit("0.1")]
    writers.write_lines(t.lineitem, F.concat_ws("\t", *[f.cast("string") for f in fields]), at)
    return readers.read_btab(t.spark, at).select("id_q", "id_s", "ident", "strand")


@query("SELECT p_partkey::VARCHAR AS id, p_brand AS brand, p_size::INT AS size FROM part WHERE p_size >= 25")
def src17_key_values(t: Tables) -> DataFrame:
    at = scratch(t)
    writers.write_lines(t.part, F.concat_ws("\t", F.col("p_partkey").cast("string"), F.lit("brand"), "p_brand", F.lit("size"), F.col("p_size").cast("string")), at)
    kv = readers.read_key_values(t.spark, at, ["id"])
    return kv.select("id", F.col("attrib")["brand"].alias("brand"), F.col("attrib")["size"].cast("int").alias("size")).filter("size >= 25")


@query("SELECT vec_id, label::DOUBLE AS label, 3 AS n FROM embeddings")
def src19_svmlight_again(t: Tables) -> DataFrame:
    at = scratch(t)
    line = F.concat_ws(" ", F.col("label").cast("string"), F.concat(F.lit("1:"), F.col("vec_id").cast("string")), F.lit("5:0.5"), F.lit("9:1.25"))
    writers.write_lines(t.embeddings, line, at)
    return readers.read_svmlight(t.spark, at).select(F.col("features")[0]["val"].cast("long").alias("vec_id"), "label", F.size("features").alias("n"))


@query("SELECT o_orderkey AS gi FROM orders")
def src20_gi_list(t: Tables) -> DataFrame:
    at = scratch(t)
    writers.write_lines(t.orders, F.concat(F.lit(">gi|"), F.col("o_orderkey").cast("string"), F.lit("|ref|x")), at)
    return readers.read_gi_list(t.spark, at, "pipes")


@query("SELECT c_custkey::VARCHAR AS id, c_acctbal AS weight FROM customer")
def src21_sample_weights(t: Tables) -> DataFrame:
    at = scratch(t)
    writers.write_report(t.customer.select("c_custkey", "c_acctbal"), at, header=False)
    return readers.read_weights(t.spark, at)


@query("SELECT n_nationkey::VARCHAR AS id, 'region' AS rank, r_name AS name, (10 + n_regionkey)::BIGINT AS taxid FROM nation JOIN region ON n_regionkey = r_regionkey")
def src22_lineage_lines(t: Tables) -> DataFrame:
    at = scratch(t)
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    line = F.concat(F.col("n_nationkey").cast("string"), F.lit('\trank=region : name="""'), F.col("r_name"), F.lit('""" : taxid='), (F.col("n_regionkey") + 10).cast("string"))
    writers.write_lines(n, line, at)
    return readers.read_lineage_lines(t.spark, at)


@query("SELECT o_orderpriority, count(*)::VARCHAR AS n FROM orders GROUP BY 1 UNION ALL SELECT 'o_orderpriority', 'n' UNION ALL SELECT '#orders', NULL")
def snk1_report_with_comment(t: Tables) -> DataFrame:
    at = scratch(t)
    writers.write_report(t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n")), at, comment="orders")
    p = F.split("value", "\t")
    return t.spark.read.text(at).select(p[0].alias("o_orderpriority"), F.get(p, F.lit(1)).alias("n"))


@query("SELECT 's' || l_suppkey || chr(9) || 'db' || chr(9) || 'CDS' || chr(9) || (l_linenumber * 10 + 1) || chr(9) || (l_linenumber * 10 + l_quantity::INT) || chr(9) || '.' || chr(9) || CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' ELSE '.' END || chr(9) || '.' || chr(9) || 'ID=' || l_partkey || ' x;Flag=' || l_returnflag AS line FROM lineitem")
def snk7_gff_lines(t: Tables) -> DataFrame:
    at = (F.col("l_linenumber") * 10).cast("int")
    strand = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1).otherwise(0)
    attributes = F.create_map(F.lit("ID"), F.concat(F.col("l_partkey").cast("string"), F.lit(";x")), F.lit("Flag"), F.col("l_returnflag"))
    line = writers.gff_line(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.lit("db"), F.lit("CDS"), at, at + F.col("l_quantity").cast("int"), F.lit(None), strand, attributes)
    return t.lineitem.select(line.alias("line"))


@query("SELECT 's' || l_suppkey AS contig, count(*) + 1 AS n, min(l_partkey)::BIGINT AS least FROM lineitem GROUP BY 1")
def snk7_contig_files(t: Tables) -> DataFrame:
    """An output for each contig, read again: its lines, the first of which names the format."""
    where, at = scratch(t), (F.col("l_linenumber") * 10).cast("int")
    contig = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    line = writers.gff_line(F.col("contig"), F.lit("db"), F.lit("CDS"), at, at + F.col("l_quantity").cast("int"), F.lit(None), F.lit(1), F.create_map(F.lit("ID"), F.col("l_partkey").cast("string")))
    writers.write_gff(t.lineitem.withColumn("contig", contig), line, where, "contig")
    back = t.spark.read.text(where)
    return back.groupBy("contig").agg(F.count("*").alias("n"), F.min(F.nullif(F.regexp_extract("value", "ID=(\\d+)", 1), F.lit("")).cast("long")).alias("least"))


@query("SELECT o_orderpriority, count(*)::VARCHAR AS n FROM orders GROUP BY 1 UNION ALL SELECT 'o_orderpriority', 'n' UNION ALL SELECT '#orders', NULL UNION ALL SELECT 'end', NULL UNION ALL SELECT o_orderstatus, count(*)::VARCHAR FROM orders GROUP BY 1")
def snk1_report_with_epilog(t: Tables) -> DataFrame:
    at = scratch(t)
    writers.write_report(t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n")), at, comment="orders", epilog="end")
    writers.write_report(t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")), at, header=False, append=True)
    p = F.split("value", "\t")
    return t.spark.read.text(at).select(p[0].alias("o_orderpriority"), F.get(p, F.lit(1)).alias("n"))


def event_stream(t: Tables) -> DataFrame:
    return t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)


@query("SELECT user_id, arg_max(event_type, (value, -event_id)) AS best, max(value) AS score FROM events GROUP BY 1")
def st1_best_so_far(t: Tables) -> DataFrame:
    at, best = scratch(t), scores.best_so_far(event_stream(t), "user_id", "event_type", "value", "event_id")
    scores.upserted(best, f"{at}/out", f"{at}/state")
    return scores.latest(t.spark, f"{at}/out", ["user_id"], best.schema)


@query("SELECT event_type, count(*) AS n, sum(value::DECIMAL(18, 2))::DOUBLE AS weight, sum(value::DECIMAL(18, 2))::DOUBLE / count(*) AS mean FROM events GROUP BY 1")
def st2_running_counts(t: Tables) -> DataFrame:
    at, counts = scratch(t), scores.running_counts(event_stream(t), "event_type", "value")
    scores.upserted(counts, f"{at}/out", f"{at}/state")
    return scores.latest(t.spark, f"{at}/out", ["event_type"], counts.schema)


@query(f"WITH {seqs_sql()} SELECT doc_id::VARCHAR AS id, source AS name, length(seq)::BIGINT AS len, md5(seq) AS digest FROM seqs WHERE length(seq) > 0")
def src1_fasta_parts(t: Tables) -> DataFrame:
    """Records in parts, wherever the file is cut, put together again."""
    s, at = seqs(t).filter("length(seq) > 0"), scratch(t)
    writers.write_fasta(s, at, F.concat(F.col("doc_id").cast("string"), F.lit(" "), "source"), "seq")
    parts = readers.read_fasta_parts(t.spark, at, 700)
    whole = parts.groupBy("id", "header").agg(F.array_sort(F.collect_list(F.struct("start", "seq"))).alias("p"), F.sum(F.length("seq")).alias("len"))
    text = F.array_join(F.transform("p", lambda x: x["seq"]), "")
    return whole.select("id", F.regexp_extract("header", r"^\S+ (.*)", 1).alias("name"), "len", F.md5(text).alias("digest"))
