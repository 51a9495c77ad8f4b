"""Registered queries: intervals, taken from line items (start is ten times the line's number)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.operators import intervals as op
from cladeflow.operators.relational import union_tagged
from cladeflow.plans.registry import Tables, query

SPANS = "spans AS (SELECT l_orderkey, l_returnflag, l_partkey, l_suppkey, l_linenumber * 10 AS s, l_linenumber * 10 + l_quantity::INT AS e FROM lineitem)"


def spans(t: Tables) -> DataFrame:
    at = (F.col("l_linenumber") * 10).cast("int")
    return t.lineitem.select("l_orderkey", "l_returnflag", "l_partkey", "l_suppkey", at.alias("start"), (at + F.col("l_quantity").cast("int")).alias("end"))


@query(f"""WITH {SPANS}, pos AS (SELECT DISTINCT l_orderkey, l_returnflag, unnest(range(s, e)) AS p FROM spans), hit AS (SELECT DISTINCT l_orderkey, unnest(range(l_suppkey % 40, l_suppkey % 40 + 15)) AS p FROM spans WHERE l_returnflag <> 'N')
    SELECT l_orderkey, l_returnflag, count(*) AS covered FROM pos JOIN hit USING (l_orderkey, p) GROUP BY 1, 2""")
def a14_interval_coverage(t: Tables) -> DataFrame:
    s = spans(t)
    start = (F.col("l_suppkey") % 40).cast("int")
    hits = s.filter("l_returnflag <> 'N'").select("l_orderkey", start.alias("start"), (start + 15).alias("end"))
    return op.coverage(s.select("l_orderkey", "l_returnflag", "start", "end"), hits, ["l_orderkey"], "l_returnflag").withColumn("covered", F.col("covered").cast("long"))


@query(f"WITH {SPANS}, pos AS (SELECT DISTINCT l_orderkey, unnest(range(s, e)) AS p FROM spans), r AS (SELECT *, p - row_number() OVER (PARTITION BY l_orderkey ORDER BY p) AS g FROM pos) SELECT l_orderkey, min(p)::INT AS start, (max(p) + 1)::INT AS \"end\" FROM r GROUP BY l_orderkey, g")
def a14_merged_intervals(t: Tables) -> DataFrame:
    return op.merged(spans(t), ["l_orderkey"])


@query(f"WITH {SPANS} SELECT l_orderkey, min(abs((a.s + a.e) / 2 - (b.s + b.e) / 2) - (a.e - a.s) / 2 - (b.e - b.s) / 2) AS gap FROM spans a JOIN spans b USING (l_orderkey) WHERE a.l_returnflag = 'A' AND b.l_returnflag = 'R' GROUP BY 1")
def j19_nearest_interval(t: Tables) -> DataFrame:
    s = spans(t)
    return op.nearest(s.filter("l_returnflag = 'A'").select("l_orderkey", "start", "end"), s.filter("l_returnflag = 'R'").select("l_orderkey", "start", "end"), "l_orderkey")


@query(f"WITH {SPANS}, a AS (SELECT l_orderkey, min(s) AS s, max(e) AS e, (count(*) + 1) // 2 AS r FROM spans GROUP BY 1) SELECT o_custkey, count(*) AS arrays, min(r)::BIGINT AS least, max(r)::BIGINT AS most, sum(r)::BIGINT AS total, round(avg(r), 3) AS mean FROM a JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def a12_array_levels(t: Tables) -> DataFrame:
    a = op.array_extents(spans(t), "l_orderkey").join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return a.groupBy("o_custkey").agg(F.count("*").alias("arrays"), F.min("repeats").alias("least"), F.max("repeats").alias("most"), F.sum("repeats").alias("total"), F.round(F.avg("repeats"), 3).alias("mean"))


@query(f"""WITH {SPANS}, x AS (SELECT l_orderkey, lead(s) OVER (PARTITION BY l_orderkey ORDER BY s, e) - e AS gap, avg(e - s) OVER (PARTITION BY l_orderkey) AS m FROM spans) SELECT l_orderkey, bool_and(gap IS NULL OR (gap >= -2 * m AND gap <= 2.5 * m)) AS ok FROM x GROUP BY 1""")
def i1_spacer_ratio(t: Tables) -> DataFrame:
    return op.spacers_in_ratio(spans(t), "l_orderkey", -2.0, 2.5)


@query("""WITH s AS (SELECT p_size, p_partkey, p_name, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS k FROM part), h AS (SELECT DISTINCT a.p_size, a.k FROM s a JOIN s b ON a.p_size = b.p_size AND b.k > a.k AND b.k <= a.k + 3 WHERE 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) >= 0.6)
    SELECT s.p_size, sum(CASE WHEN h.k IS NULL THEN 0 ELSE 1 END) / count(*) AS share FROM s LEFT JOIN h ON s.p_size = h.p_size AND s.k = h.k GROUP BY 1""")
def i2_similar_spacers(t: Tables) -> DataFrame:
    s = t.part.select("p_size", "p_name", F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey")).alias("k"))
    return op.similar_spacers(s, "p_size", "k", "p_name")


@query("SELECT p_size, string_agg(replace(CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE lower(p_name) END, '-', ''), '' ORDER BY p_partkey) AS seq FROM part GROUP BY 1")
def i3_joined_elements(t: Tables) -> DataFrame:
    return op.joined_elements(t.part, "p_size", "p_partkey", "p_name", F.col("p_partkey") % 2 == 0)


@query(f"WITH {SPANS} SELECT l_orderkey, s AS start, e AS \"end\", row_number() OVER (PARTITION BY l_orderkey ORDER BY s, e, l_partkey, l_suppkey) AS place, min(s) OVER (PARTITION BY l_orderkey) AS array_start FROM spans")
def i4_element_listing(t: Tables) -> DataFrame:
    of = Window.partitionBy("l_orderkey")
    s = spans(t)
    return s.select("l_orderkey", "start", "end", F.row_number().over(of.orderBy("start", "end", "l_partkey", "l_suppkey")).cast("long").alias("place"), F.min("start").over(of).alias("array_start"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 2 = 0 THEN b - 1 ELSE e - 1 END AS start, CASE WHEN l_partkey % 2 = 0 THEN e ELSE b END AS stop FROM (SELECT *, CASE WHEN l_partkey % 2 = 0 THEN l_linenumber * 10 ELSE l_linenumber * 10 + 30 END AS b, CASE WHEN l_partkey % 2 = 0 THEN l_linenumber * 10 + 30 ELSE l_linenumber * 10 END AS e FROM lineitem)")
def i5_forward_strand(t: Tables) -> DataFrame:
    fwd, at = F.col("l_partkey") % 2 == 0, F.col("l_linenumber") * 10
    x = t.lineitem.withColumn("b", F.when(fwd, at).otherwise(at + 30)).withColumn("e", F.when(fwd, at + 30).otherwise(at))
    return op.forward(x, "b", "e", fwd).select("l_orderkey", "l_linenumber", "l_partkey", "start", "stop")


@query(f"WITH {SPANS} SELECT l_returnflag AS track, count(*) AS n, min(s) AS first FROM spans WHERE l_returnflag IN ('A', 'R') GROUP BY 1")
def i6_tracks(t: Tables) -> DataFrame:
    s = spans(t)
    return union_tagged({f: s.filter(F.col("l_returnflag") == f) for f in "AR"}, "track").groupBy("track").agg(F.count("*").alias("n"), F.min("start").alias("first"))


@query("""WITH b AS (SELECT p_partkey, generate_subscripts(string_split(upper(p_name), ''), 1) - 1 AS pos, unnest(string_split(upper(p_name), '')) AS own FROM part), h AS (SELECT p_partkey, k, p_partkey % 4 + k AS s, string_split(upper(p_type), '') AS c FROM part, (VALUES (0), (2)) v(k)),
    x AS (SELECT p_partkey, k, s + generate_subscripts(c, 1) - 1 AS pos, unnest(c) AS sym FROM h), l AS (SELECT p_partkey, pos, arg_max(sym, k) AS sym FROM x GROUP BY 1, 2)
    SELECT b.p_partkey, string_agg(CASE WHEN sym IS NULL OR sym = own THEN own ELSE lower(sym) END, '' ORDER BY b.pos) AS shown FROM b LEFT JOIN l ON b.p_partkey = l.p_partkey AND b.pos = l.pos GROUP BY 1""")
def i7_overlay(t: Tables) -> DataFrame:
    k = F.explode(F.array(F.lit(0), F.lit(2)))
    h = t.part.select("p_partkey", "p_type", k.alias("k")).select("p_partkey", "k", (F.col("p_partkey") % 4 + F.col("k")).alias("start"), F.col("p_type").alias("hit"))
    return op.overlay(t.part, h, "p_partkey", "p_name", "k")


@query(f"WITH {SPANS}, h AS (SELECT a.l_orderkey, a.l_partkey, sum(greatest(0, least(a.e, b.e) - greatest(a.s, b.s)))::BIGINT AS overlap FROM spans a JOIN spans b USING (l_orderkey) WHERE a.l_returnflag = 'A' AND b.l_returnflag = 'N' AND a.s < b.e AND b.s < a.e GROUP BY 1, 2) SELECT l_orderkey, l_partkey, overlap FROM h")
def j18_interval_overlap(t: Tables) -> DataFrame:
    s = spans(t)
    return op.overlap_totals(s.filter("l_returnflag = 'A'"), s.filter("l_returnflag = 'N'"), ["l_orderkey"], ["l_partkey"])


@query(f"WITH {SPANS} SELECT a.l_orderkey, a.l_partkey, a.s AS start, a.e AS \"end\", b.l_partkey AS b_l_partkey, b.s AS b_start, b.e AS b_end FROM spans a JOIN spans b USING (l_orderkey) WHERE a.l_returnflag = 'A' AND b.l_returnflag = 'N' AND a.s < b.e AND b.s < a.e AND a.s < a.e AND b.s < b.e")
def j18_overlapping_pairs(t: Tables) -> DataFrame:
    s = spans(t).select("l_orderkey", "l_partkey", "l_returnflag", "start", "end")
    return op.overlapping(s.filter("l_returnflag = 'A'").drop("l_returnflag"), s.filter("l_returnflag = 'N'").drop("l_returnflag"), ["l_orderkey"], 16)
