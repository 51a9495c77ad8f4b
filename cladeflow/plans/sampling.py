"""Registered queries: samples, test splits and benchmark pairs along the tree of regions, nations and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.operators import metrics, sampling, tree
from cladeflow.plans.registry import Tables, query
from cladeflow.plans.trees import CLOSURE, DEPTH, both

ITEMS = """own AS (SELECT i.id, item, depth, idpar FROM (SELECT 1000 + o_custkey AS id, o_orderkey AS item FROM orders WHERE o_custkey % 4 <> 0
    UNION ALL SELECT 100 + s_nationkey, 1000000000 + s_suppkey FROM supplier UNION ALL SELECT 10 + p_partkey % 5, 2000000000 + p_partkey FROM part) i JOIN depth USING (id) JOIN tree USING (id))"""


def _picks(d: int, cap: int, seed: int) -> str:
    """One level's lists, their median and what is picked, in SQL; level 3 has leaves only, others may have some."""
    below = f"SELECT idpar AS id, id AS source, item FROM picks{d + 1} JOIN tree USING (id) UNION ALL" if d < 3 else ""
    return f"""lists{d} AS ({below} SELECT id, id AS source, item FROM own WHERE depth = {d}),
    met{d} AS (SELECT id, least(floor(quantile_cont(n, 0.5)), {cap}) AS many, CASE WHEN bool_or(id = source) THEN 'direct' WHEN count(*) >= 2 THEN 'indirect' END AS status FROM (SELECT id, source, count(*) AS n FROM lists{d} GROUP BY 1, 2) GROUP BY 1),
    picks{d} AS (SELECT id, source, item, CASE WHEN id IN (SELECT idpar FROM tree) THEN status ELSE 'direct' END AS status FROM lists{d} JOIN met{d} USING (id)
        QUALIFY id NOT IN (SELECT idpar FROM tree) OR row_number() OVER (PARTITION BY id, source ORDER BY md5(item || '-' || id || ':{seed}'), item) <= many)"""


@query(f"{CLOSURE}, {DEPTH}, {ITEMS}, {', '.join(_picks(d, 40, 5) for d in (3, 2, 1, 0))} SELECT id, source, item, status FROM picks3 UNION ALL FROM picks2 UNION ALL FROM picks1 UNION ALL FROM picks0")
def p28_representatives(t: Tables) -> DataFrame:
    """Orders of most customers, suppliers at their nations and parts at regions, cut to the median up the tree."""
    nodes, pairs = both(t)
    items = t.orders.filter("o_custkey % 4 <> 0").select((F.col("o_custkey") + 1000).cast("long").alias("id"), F.col("o_orderkey").cast("long").alias("item"))
    items = items.union(t.supplier.select((F.col("s_nationkey") + 100).cast("long"), (F.col("s_suppkey") + 1000000000).cast("long")))
    items = items.union(t.part.select((F.col("p_partkey") % 5 + 10).cast("long"), (F.col("p_partkey") + 2000000000).cast("long")))
    return sampling.representatives_up(nodes, tree.depths(pairs), items, 5, 40)


MIN_TRAIN, MIN_TEST, RATIO = 60, 25, 0.2


def _split(d: int, seed: int) -> str:
    """One level of the test split in SQL: children in seeded order folded into what is left of the target."""
    state = "{{h: '', id: 0::BIGINT, total: 0::BIGINT, l: {}, t: {}, r: {}, p: {}}}"
    child = "{h: md5(id || ':" + str(seed) + "'), id: id::BIGINT, total: total::BIGINT, l: 0::BIGINT, t: 0::BIGINT, r: 0::BIGINT, p: []::BIGINT[]}"
    taken = state.format("s.l - c.total", "s.t + c.total", "s.r - c.total", "list_append(s.p, c.id)")
    below = f"UNION ALL SELECT id, idpar, total, is_term, n_test, n_train FROM got{d + 1}" if d < 2 else ""
    return f"""kids{d} AS (SELECT id, idpar, total, true AS is_term, 0::BIGINT AS n_test, total AS n_train FROM facts WHERE depth = {d + 1} AND term AND NOT lost AND total > 0 {below}),
    sums{d} AS (SELECT f.id, f.idpar, f.total, target, coalesce(sum(n_test), 0)::BIGINT AS test, coalesce(sum(n_train), 0)::BIGINT AS train, coalesce(list(k ORDER BY k.h, k.id) FILTER (WHERE is_term), []) AS kids
        FROM facts f LEFT JOIN (SELECT idpar, n_test, n_train, is_term, {child} AS k FROM kids{d}) c ON c.idpar = f.id WHERE f.depth = {d} AND f.opened GROUP BY 1, 2, 3, 4),
    fold{d} AS (SELECT *, list_reduce(list_prepend({state.format('(target - test)::BIGINT', 'test', 'train', '[]::BIGINT[]')}, kids), lambda s, c: CASE WHEN c.total <= s.l AND s.r - c.total >= {MIN_TRAIN} THEN {taken} ELSE s END) AS s FROM sums{d}),
    next{d} AS (SELECT *, list_sort(list_transform(list_filter(kids, lambda k: NOT list_contains(s.p, k.id)), lambda k: {{total: k.total, h: k.h, id: k.id}}))[1] AS x FROM fold{d}),
    got{d} AS (SELECT id, idpar, total, n_test, CASE WHEN n_test = 0 THEN total ELSE n_train END AS n_train, picked, n_test = 0 AND total < {MIN_TRAIN} AS is_term FROM (
        SELECT id, idpar, total, CASE WHEN target - test <= 0 THEN test WHEN fill THEN s.t + x.total ELSE s.t END AS n_test, CASE WHEN target - test <= 0 THEN train WHEN fill THEN s.r - x.total ELSE s.r END AS n_train,
               CASE WHEN target - test <= 0 THEN [] WHEN fill THEN list_append(s.p, x.id) ELSE s.p END AS picked
        FROM (SELECT *, coalesce(s.t < {MIN_TEST} AND s.t + x.total >= {MIN_TEST} AND s.r - x.total >= {MIN_TRAIN}, false) AS fill FROM next{d})))"""


@query(f"""{CLOSURE}, {DEPTH}, counts AS (SELECT 1000 + o_custkey AS id, count(*) AS n FROM orders GROUP BY 1),
    flags AS (SELECT t.id, idpar, depth, coalesce(rank = 'customer', false) AS term, id = 103 OR coalesce(rank = 'customer', false) AND id % 17 = 0 AS unclass FROM tree t JOIN depth USING (id)),
    totals AS (SELECT anc_id AS id, sum(n)::BIGINT AS total FROM closure JOIN counts USING (id) GROUP BY 1),
    full_flags AS (SELECT f.*, coalesce(total, 0)::BIGINT AS total FROM flags f LEFT JOIN totals USING (id)),
    lost AS (SELECT DISTINCT c.id FROM closure c JOIN flags f ON c.anc_id = f.id WHERE unclass),
    closed AS (SELECT DISTINCT c.id FROM closure c JOIN flags f ON c.anc_id = f.id WHERE term AND f.depth > 0),
    facts AS (SELECT f.*, f.id IN (FROM lost) AS lost, NOT f.id IN (FROM lost) AND NOT f.id IN (FROM closed) AND f.total > 0 AS opened, greatest(least(round((f.total - coalesce(loose, 0)) * {RATIO}), f.total - coalesce(loose, 0) - {MIN_TRAIN}), {MIN_TEST})::BIGINT AS target
        FROM full_flags f LEFT JOIN (SELECT idpar AS id, sum(total)::BIGINT AS loose FROM full_flags WHERE unclass GROUP BY 1) USING (id)),
    {', '.join(_split(d, 13) for d in (2, 1, 0))},
    seen AS (SELECT id, n_test, n_train, is_term, picked FROM got2 UNION ALL SELECT id, n_test, n_train, is_term, picked FROM got1 UNION ALL SELECT id, n_test, n_train, is_term, picked FROM got0),
    tests AS (SELECT DISTINCT c.id FROM closure c JOIN (SELECT unnest(picked) AS id FROM seen) p ON c.anc_id = p.id),
    barred AS (SELECT DISTINCT c.id FROM closure c JOIN facts f ON c.anc_id = f.id JOIN seen s ON s.id = f.idpar WHERE f.unclass AND s.n_test > 0),
    terms AS (SELECT DISTINCT c.id FROM closure c JOIN (SELECT f.id FROM facts f JOIN facts p ON p.id = f.idpar AND p.opened WHERE f.term AND NOT f.lost AND f.total > 0 UNION SELECT id FROM seen WHERE is_term) x ON c.anc_id = x.id WHERE x.id <> 1)
    SELECT f.id, f.total, CASE WHEN te THEN f.total ELSE coalesce(s.n_test, 0) END AS n_test, CASE WHEN te OR f.id IN (FROM barred) THEN 0 ELSE coalesce(s.n_train, f.total) END AS n_train, te AS is_test,
           coalesce(s.n_test >= {MIN_TEST}, false) AND NOT te AS has_test, f.id IN (FROM terms) AS is_terminal FROM (SELECT *, id IN (FROM tests) AS te FROM facts) f LEFT JOIN seen s USING (id)""")
def p30_tree_split(t: Tables) -> DataFrame:
    """Customers, with all their orders, go to one side; one nation and some customers are unclassified."""
    nodes, pairs = both(t)
    counts = t.orders.groupBy((F.col("o_custkey") + 1000).cast("long").alias("id")).agg(F.count("*").alias("n"))
    is_leaf = F.coalesce(F.col("rank") == "customer", F.lit(False))
    loose = (F.col("id") == 103) | (is_leaf & (F.col("id") % 17 == 0))
    return sampling.test_split(nodes, pairs, counts, is_leaf, loose, F.lit(MIN_TRAIN), F.lit(MIN_TEST), F.lit(RATIO), 13)


@query(f"""{CLOSURE}, m AS (SELECT s_suppkey AS model, CASE WHEN s_suppkey % 5 = 0 THEN 10 + s_nationkey % 5 ELSE 100 + s_nationkey END AS best, s_suppkey % 7 <> 0 AS leaf FROM supplier),
    scores AS (SELECT l_orderkey AS sample, l_suppkey AS model, max(l_extendedprice)::DOUBLE AS score FROM lineitem GROUP BY 1, 2), truth AS (SELECT o_orderkey AS sample, 100 + c_nationkey AS truth FROM orders JOIN customer ON o_custkey = c_custkey),
    placed AS (SELECT DISTINCT best AS id FROM m WHERE leaf), held AS (SELECT anc_id AS id, count(*) AS held FROM closure JOIN placed USING (id) GROUP BY 1),
    fixed AS (SELECT c.id, CASE a.rank WHEN 'nation' THEN 30 WHEN 'region' THEN 40 WHEN 'root' THEN 100 END AS level, c.anc_id AS spot, dist FROM closure c JOIN tree a ON a.id = c.anc_id WHERE a.rank IN ('nation', 'region', 'root')),
    zones AS (SELECT f.id AS truth, level, spot, lead(held) OVER (PARTITION BY f.id ORDER BY level) - held AS n_models FROM fixed f JOIN held h ON h.id = f.spot UNION ALL SELECT id, 0, NULL, held FROM held),
    cand AS (SELECT s.sample, truth, s.model, best, score FROM scores s JOIN m ON s.model = m.model AND leaf JOIN truth USING (sample) WHERE truth IN (SELECT id FROM placed)),
    won AS (SELECT c.*, level AS lev_exc, n_models FROM cand c JOIN zones z USING (truth) WHERE level < 100 AND n_models >= 1
        AND (level = 0 OR best NOT IN (SELECT anc_id FROM closure k WHERE k.id = c.truth) AND spot NOT IN (SELECT anc_id FROM closure k WHERE k.id = c.best))
        QUALIFY row_number() OVER (PARTITION BY sample, level ORDER BY score DESC, model) = 1)
    SELECT sample, lev_exc, f.level AS lev_pred, f.spot AS test, coalesce(p.spot, -1) AS pred, truth, best, model, score, n_models FROM won JOIN fixed f ON f.id = truth AND f.level > lev_exc LEFT JOIN fixed p ON p.id = best AND p.level = f.level
    UNION ALL SELECT sample, 0, 0, truth, best, truth, best, model, score, n_models FROM won WHERE lev_exc = 0""")
def m1_lineage_pairs(t: Tables) -> DataFrame:
    """Suppliers are models of nations or, some, of regions; an order's lines score them, its customer's nation is the truth."""
    nodes, pairs = both(t)
    node = F.when(F.col("s_suppkey") % 5 == 0, F.col("s_nationkey") % 5 + 10).otherwise(F.col("s_nationkey") + 100)
    m = t.supplier.select(F.col("s_suppkey").alias("model"), node.cast("long").alias("node"), (F.col("s_suppkey") % 7 != 0).alias("leaf"))
    scores = t.lineitem.groupBy(F.col("l_orderkey").alias("sample"), F.col("l_suppkey").alias("model")).agg(F.max("l_extendedprice").cast("double").alias("score"))
    truth = t.orders.withColumnRenamed("o_custkey", "c_custkey").join(t.customer, "c_custkey").select(F.col("o_orderkey").alias("sample"), (F.col("c_nationkey") + 100).cast("long").alias("node"))
    return metrics.benchmark_pairs(scores, truth, m, nodes, pairs, {"nation": 30, "region": 40, "root": 100})
