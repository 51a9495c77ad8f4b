"""Annotation records, their resolution to nodes, and hosts of viruses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeflow.operators.common import first_by, in_seeded_order, small
from cladeflow.operators.kmers import renumber
from cladeflow.operators.tree import close_names, find_names, lowest_common_of_sets, nearest_of_rank


def orf_place(orf: Column) -> Column:
    """An ORF's id on its contig, contig_start_end_strand with a 1-based start, as a struct."""
    p = F.split(orf, "_")
    at = lambda k: F.element_at(p, k)
    contig = F.array_join(F.slice(p, F.lit(1), F.size(p) - 3), "_")
    return F.struct(contig.alias("contig"), (at(-3).cast("long") - 1).alias("start"), at(-2).cast("long").alias("end"), at(-1).cast("int").alias("strand"))


def kept_records(df: DataFrame, attrib: str, kind: str, count: str, least: int) -> DataFrame:
    """Records of a type with at least so many of a counted attribute."""
    return df.filter((F.col("type") == kind) & (F.col(attrib)[count].cast("long") >= least))


def trimmed_reads(df: DataFrame, header: str, seq: str, least: int) -> DataFrame:
    """Reads cut to the clear range (clr_left, clr_right) that their header's key=value pairs name."""
    kv = F.expr(f"str_to_map({header}, ' ', '=')")
    x = df.withColumn("_kv", kv).withColumn("_l", F.col("_kv")["clr_left"].cast("int")).withColumn("_r", F.col("_kv")["clr_right"].cast("int"))
    x = x.withColumn(seq, F.substring(seq, F.col("_l") + 1, F.col("_r") - F.col("_l"))).filter(F.length(seq) >= least)
    return x.drop("_kv", "_l", "_r")


def in_listed_order(df: DataFrame, order: DataFrame, ident: str, place: str, tree: str) -> DataFrame:
    """Records in the order of a list of ids; those without a tree go, and the tree is dropped."""
    return df.filter(F.col(tree).isNotNull()).join(order.select(ident, place), ident).drop(tree).orderBy(place)


def resolved(records: DataFrame, names: DataFrame, pairs: DataFrame, nodes: DataFrame, ident: str) -> DataFrame:
    """(id, node, how) of annotation records (id, taxid, name, lineage: names from the root down), by the
    first step that gives a node: taxid, if it is a node; name, the only node of the longest prefix of the
    name's words that is a name; lineage, the only node of a lineage name, the lowest such name first;
    common, the lowest common node of the lowest lineage name that several nodes have.

    A record that no step resolves isn't returned, nor is one whose several nodes have no common node.
    """
    step = lambda df, node, n, how: df.select(ident, F.col(node).cast("long").alias("node"), F.lit(n).alias("_step"), F.lit(how).alias("how"))
    by_id = step(records.join(nodes.select(F.col("id").alias("taxid")), "taxid"), "taxid", 1, "taxid")
    rest = records.join(by_id.select(ident).distinct(), ident, "left_anti")
    names = names.select(F.lower("name").alias("name"), "id").distinct()
    asked = rest.select(F.trim("name").alias("_asked")).filter(F.col("_asked") != "").distinct()
    fuzzy = find_names(names, asked, "name", "_asked").groupBy("_asked").agg(F.count("*").alias("_n"), F.min("id").alias("_node")).filter("_n = 1")
    by_name = step(rest.select(ident, F.trim("name").alias("_asked")).join(fuzzy, "_asked"), "_node", 2, "name")
    up = rest.select(ident, F.posexplode(F.reverse("lineage")).alias("_place", "_key")).withColumn("_key", F.lower("_key"))
    of = names.groupBy(F.col("name").alias("_key")).agg(F.count("*").alias("_n"), F.min("id").alias("_node"))
    found = up.join(of, "_key")
    lowest = lambda where: first_by(found.filter(where), [ident], [F.col("_place")])
    by_lineage = step(lowest("_n = 1"), "_node", 3, "lineage")
    several = lowest("_n > 1")
    same = several.select("_key").distinct().join(names.withColumnRenamed("name", "_key"), "_key")
    by_common = step(several.join(lowest_common_of_sets(pairs, same, "_key"), "_key"), "lcs", 4, "common")
    return first_by(by_id.union(by_name).union(by_lineage).union(by_common), [ident], [F.col("_step")]).select(ident, "node", "how")


def assigned_hosts(candidates: DataFrame, nodes: DataFrame, pairs: DataFrame, barred: DataFrame, virus: str) -> DataFrame:
    """(virus, id): of candidates (virus, host, score; a name and how far it was changed) the nodes found at
    the smallest score that finds any, none under ``barred`` (id), and none under another of them."""
    hits = candidates.join(nodes.select(F.lower("name").alias("host"), "id"), "host").select(virus, "id", "score").distinct()
    return _best_hosts(hits, pairs, barred, virus)


def _best_hosts(hits: DataFrame, pairs: DataFrame, barred: DataFrame, virus: str) -> DataFrame:
    bad = pairs.join(barred.select(F.col("id").alias("anc_id")), "anc_id", "left_semi").select("id").distinct()
    hits = hits.join(bad, "id", "left_anti")
    best = hits.join(hits.groupBy(virus).agg(F.min("score").alias("score")), [virus, "score"]).select(virus, "id").distinct()
    inner = best.join(pairs.filter("dist > 0"), "id").join(best.select(virus, F.col("id").alias("anc_id")), [virus, "anc_id"], "left_semi").select(virus, "id").distinct()
    return best.join(inner, [virus, "id"], "left_anti")


def near_hosts(asked: DataFrame, names: DataFrame, pairs: DataFrame, barred: DataFrame, virus: str, host: str, most: int = 2) -> DataFrame:
    """(virus, id): nodes whose names (``names``: id, name) are nearest to what ``asked`` (virus, host) says: the same name, else
    one within the least number of edits up to ``most``, else the longest beginning of its words that is a name. Nodes
    under ``barred`` (id) don't count, and of nodes found together none is under another."""
    asked = asked.select(virus, F.trim(F.col(host)).alias("_host")).distinct()
    close = close_names(names, asked, "name", "_host", most).withColumnRenamed("dist", "score")
    words = find_names(names, asked, "name", "_host")
    dropped = F.size(F.split(F.lower("_host"), r"\s+")) - F.col("words")
    words = words.select("_host", "id", (F.lit(most + 1) + dropped).cast("int").alias("score")).filter(F.col("score") > most + 1)
    hits = asked.join(close.select("_host", "id", "score").union(words), "_host").select(virus, "id", "score").distinct()
    return _best_hosts(hits, pairs, barred, virus)


def reference_hosts(hosts: DataFrame, pairs: DataFrame, with_sequence: DataFrame, bound: int) -> DataFrame:
    """(host, ref): the node with a sequence nearest to each host: in its own subtree first, then by how
    far up the common node is; ids break ties, whatever was chosen for others.

    Each ancestor has its least node with a sequence, so that no host meets all candidates."""
    own = hosts.select(F.col("id").alias("host")).join(with_sequence.select(F.col("id").alias("host")), "host").select("host", F.col("host").alias("ref"), F.lit(-1).alias("up"))
    least = with_sequence.select("id").join(pairs.select("id", "anc_id"), "id").groupBy("anc_id").agg(F.min("id").alias("ref"))
    up = hosts.select("id").join(pairs.filter(F.col("dist") <= bound), "id")
    near = up.join(least, "anc_id").select(F.col("id").alias("host"), "ref", F.col("dist").alias("up"))
    return first_by(own.union(near), ["host"], [F.col("up"), F.col("ref")]).select("host", "ref")


def feature_hosts(features: DataFrame, virus: str, columns: list[str], xref: str) -> DataFrame:
    """(virus, host, taxid): all hosts that source features name, and the taxid of their cross-reference."""
    names = F.array_distinct(F.filter(F.array(*[F.lower(F.trim(c)) for c in columns]), lambda x: x.isNotNull() & (x != "")))
    taxid = F.nullif(F.regexp_extract(xref, r"taxon:(\d+)", 1), F.lit("")).cast("long")
    return features.select(virus, F.explode(names).alias("host"), taxid.alias("taxid")).distinct()


def class_quotas(totals: DataFrame, least: int, most: int) -> DataFrame:
    """Foreground classes with enough samples, each with an equal quota of ``most`` that it can fill."""
    ok = totals.filter(F.col("total") >= least)
    n = F.broadcast(ok.agg(F.count("*").alias("_n")))
    return ok.join(n).withColumn("quota", F.least("total", F.floor(F.lit(most) / F.col("_n")))).drop("_n")


def regrouped(of_host: DataFrame, refs: DataFrame, pairs: DataFrame, nodes: DataFrame, virus: str, ranks: list[str]) -> DataFrame:
    """(group, ref, virus): viruses (virus, host) under the reference sequence of their host, and references
    under their first node of one of ``ranks``; a reference without such a node is left out."""
    group = nearest_of_rank(pairs, nodes, ranks).select(F.col("id").alias("ref"), F.col("at_rank").alias("group"))
    return of_host.join(refs, "host").join(group, "ref").select("group", "ref", virus).distinct()


def training_rows(samples: DataFrame, quotas: DataFrame, label: str, ident: str, seed: int, background: DataFrame | None = None, background_number: int = 0) -> DataFrame:
    """As many samples of each class as its quota, in seeded order, with the classes numbered from 1;
    ``background`` (label, quota) are classes that share one number."""
    q = renumber(quotas.select(label, "quota"), label, "number").select(label, "quota", (F.col("number") + 1).alias("number"))
    if background is not None:
        q = q.union(background.select(label, "quota", F.lit(background_number).cast("long")))
    placed = in_seeded_order(samples.join(small(q), label), label, ident, seed, F.lit(1))
    return placed.filter("_run <= quota").drop("_run", "_total")


