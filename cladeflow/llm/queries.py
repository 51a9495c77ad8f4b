"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.llm import ann, topk
from cladeflow.llm.common import table
from cladeflow.llm.conversations import damaged, repair
from cladeflow.llm.divergence import audit
from cladeflow.llm.language_id import UNDETERMINED, held_out, identify, train
from cladeflow.llm.licenses import BETWEEN, COPYRIGHT_LINE, KNOWN, SPELLINGS, scan
from cladeflow.llm.minhash import near_duplicates
from cladeflow.llm.mixing import mix
from cladeflow.llm.packing import pack
from cladeflow.llm.sharding import BITS, shard
from cladeflow.llm.simhash import near_duplicates as close_fingerprints
from cladeflow.llm.token_counts import count_tokens
from cladeflow.llm.url_filter import CANONICAL_TAG, HREF, REFRESH_TAG, REFRESH_URL, filter_urls


def tokenizer(name: str) -> str:
    """A public vocabulary file; only the queries name the package that has it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(docs: DataFrame) -> DataFrame:
    """Ids as the tokenizer file makes them; its ranks and pattern are also on their own."""
    import public_tokenizers

    with open(tokenizer("byte_bpe_50k.json"), encoding="utf-8") as file:
        added = {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}
    return pack(docs, tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=added)


# The rules of the URL filter (host, path, verdict).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


#: Both vector searches ask for the neighbours of every row whose id this divides.
EVERY = 20


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between different sets are confirmed on the full sets; copies, whose sets are equal, are told by size and
    two 64-bit sums over the set, and their sets aren't compared again."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(packed(table(spark, sf_dir, "documents")))


def packed_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def languages(docs: DataFrame) -> DataFrame:
    """``docs`` with held_out, lang_pred and score, learned from those that aren't held out."""
    return identify(docs.withColumn("held_out", held_out()), train(docs.filter(~held_out())))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), F.array(F.col("source")))
    return mixed.docs.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_tokens")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return close_fingerprints(table(spark, sf_dir, "documents"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repair(damaged(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text"))
    return found.withColumnRenamed("conv", "conv_id")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


def op4_sharding_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and rows at each point of the curve that op4_sharding follows."""
    return op4_sharding(spark, sf_dir).groupBy("curve").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def op7_mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source: its words, its target, and whether op7_mixing takes as many words, to the size of its
    largest document."""
    docs = table(spark, sf_dir, "documents")
    rows = mix(docs, F.array("source")).docs
    sums = rows.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("size").alias("most"))
    near = F.abs(F.col("taken") - F.col("target")) <= F.col("most")
    return sums.select("source", "source_size", F.round("target", 3).alias("target"), near.alias("near"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_license_scan": op2_license_scan,
    "op3_minhash": op3_minhash,
    "op4_sharding": op4_sharding,
    "op5_packing": op5_packing,
    "op6_language_id": op6_language_id,
    "op7_mixing": op7_mixing,
    "op8_url_filter": op8_url_filter,
    "op9_token_counts": op9_token_counts,
    "op10_topk": op10_topk,
    "op11_simhash": op11_simhash,
    "op12_conversations": op12_conversations,
    "op13_divergence": op13_divergence,
    "op4_sharding_curve": op4_sharding_curve,
    "op7_mixing_targets": op7_mixing_targets,
}




def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Words of a text, in SQL.
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _licenses_sql() -> str:
    spellings = "MAP {" + ", ".join(f"{_sql(a)}: {_sql(b)}" for a, b in SPELLINGS.items()) + "}"
    plain = f"trim(regexp_replace(lower(CASE WHEN regexp_matches(line, {_sql(COPYRIGHT_LINE)}) THEN '' ELSE line END), {_sql(BETWEEN)}, ' ', 'g'))"
    words = f"array_to_string(list_transform(string_split({plain}, ' '), lambda w: coalesce(spelt[w], w)), ' ')"
    lines = f"list_filter(list_transform(string_split_regex(coalesce(text, ''), '[\r\n]+'), lambda line: {words}), lambda x: x <> '')"
    rows = ", ".join(f"({_sql(n)}, {_sql(t)})" for n, t in KNOWN)
    return f"""
    WITH spelling AS (SELECT {spellings} AS spelt),
    known AS (SELECT sha256(array_to_string({lines}, ' ')) AS digest, min(license) AS license
              FROM (VALUES {rows}) AS t(license, text), spelling GROUP BY 1),
    docs AS (SELECT row_number() OVER () AS k, doc_id, {lines} AS lines FROM documents, spelling),
    whole AS (SELECT k, doc_id, array_to_string(lines, ' ') AS body, lines FROM docs),
    named AS (SELECT k, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
              FROM (SELECT k, sha256(unnest(lines)) AS digest FROM docs) JOIN known USING (digest) GROUP BY k)
    SELECT doc_id, CASE WHEN body = '' THEN 0 ELSE length(body) - length(replace(body, ' ', '')) + 1 END AS n_words,
           sha256(body) AS digest, license, coalesce(notices, '') AS notices
    FROM whole LEFT JOIN known ON sha256(body) = known.digest LEFT JOIN named USING (k)"""


def _near_copies_sql() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH RECURSIVE worded AS (SELECT doc_id, {_WORDS.format(lower)} AS w FROM documents),
    shingles AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM worded),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
    links AS (
        SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b USING (s)
        JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id WHERE a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
    FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) USING (doc_id)"""


def _mixing_sql() -> str:
    """Targets by their closed form: sources capped in the order of cap by weight. The seeded selection of
    documents is a hash of Spark's, so that only sums are compared (op7_mixing_targets)."""
    return f"""
    WITH docs AS (SELECT source, len({_WORDS.format("coalesce(text, '')")}) AS size FROM documents),
    sources AS (SELECT source, sum(size) AS source_size FROM docs GROUP BY 1),
    weighed AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM sources),
    ordered AS (SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / weight, source) AS k FROM weighed),
    before AS (SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
                      sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM ordered),
    level AS (SELECT arg_min((total - capped) / free, k) FILTER (WHERE (total - capped) / free * weight <= 3 * source_size) AS level
              FROM before, (SELECT sum(size)::DOUBLE AS total FROM docs))
    SELECT source, source_size::BIGINT AS source_size, round(least(3.0 * source_size, weight * level), 3) AS target, true AS near
    FROM weighed, level"""


def _topk_sql() -> str:
    return f"""
    WITH ok AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
                WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
               FROM ok q JOIN ok c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
    FROM scored QUALIFY rank <= 20"""


def _shards_sql() -> str:
    top = 2**BITS
    untangle = f"""list_reduce(list_prepend(x, list_transform(range({BITS - 1}, 0, -1), lambda q: [q])), lambda p, b:
        list_reduce(list_prepend(p, [[0], [1], [2]]), lambda y, i:
            CASE WHEN (y[i[1] + 1] & (1 << b[1])) <> 0 THEN [xor(y[1], (1 << b[1]) - 1), y[2], y[3]]
                 WHEN i[1] = 0 THEN y
                 WHEN i[1] = 1 THEN [xor(y[1], xor(y[1], y[2]) & ((1 << b[1]) - 1)), xor(y[2], xor(y[1], y[2]) & ((1 << b[1]) - 1)), y[3]]
                 ELSE [xor(y[1], xor(y[1], y[3]) & ((1 << b[1]) - 1)), y[2], xor(y[3], xor(y[1], y[3]) & ((1 << b[1]) - 1))] END))"""
    bits = " + ".join(f"(((xor(g[{i + 1}], t) >> {b}) & 1) << {3 * b + 2 - i})" for b in range(BITS) for i in range(3))
    flips = ", ".join(f"CASE WHEN (g[3] & {1 << q}) <> 0 THEN {(1 << q) - 1} ELSE 0 END" for q in range(BITS - 1, 0, -1))
    t = flips.split(", CASE")
    parts = [t[0], *["CASE" + x for x in t[1:]]]
    joined = parts[0]
    for x in parts[1:]:
        joined = f"xor({joined}, {x})"
    return f"""
    WITH docs AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, source, lang, count(*) OVER () AS total FROM documents),
    ranks AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS LAST) - 1 AS s, dense_rank() OVER (ORDER BY lang NULLS LAST) - 1 AS l,
                     length(bin(size)) - 1 AS whole FROM docs),
    levels AS (SELECT *, least(2 * whole + CASE WHEN 2 * size >= 3 * (1::BIGINT << whole) THEN 1 ELSE 0 END, {top - 1})::BIGINT AS z,
                      (s * {top} // (max(s) OVER () + 1))::BIGINT AS x0, (l * {top} // (max(l) OVER () + 1))::BIGINT AS y0 FROM ranks),
    cells AS (SELECT DISTINCT [x0, y0, z] AS x FROM levels),
    loose AS (SELECT x, {untangle} AS u FROM cells),
    gray AS (SELECT x, [u[1], xor(u[1], u[2]), xor(u[1], xor(u[2], u[3]))] AS g FROM loose),
    turned AS (SELECT x, g, {joined} AS t FROM gray),
    curves AS (SELECT x, {bits} AS curve FROM turned)
    SELECT curve, sum(size)::BIGINT AS bytes, count(*) AS n FROM levels JOIN curves ON curves.x = [x0, y0, z] GROUP BY 1"""


def _urls_sql() -> str:
    rules = ", ".join(f"({_sql(h)}, {_sql(p)}, {_sql(v)})" for h, p, v in URL_RULES)
    capitals, small = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

    def parts(url: str) -> tuple[str, str, str]:
        rest = f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) END"
        host = f"coalesce(translate(regexp_extract({rest}, '^[^/?#]*'), {capitals}, {small}), '')"
        path = f"coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '')"
        query = f"coalesce(regexp_extract({rest}, '^[^?#]*(\\?[^#]*)', 1), '')"
        return host, path, f"CASE WHEN {host} <> '' THEN {host} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || {query} END"

    h, p, n = parts("url")
    th, tp, tn = parts("target")
    return f"""
    WITH RECURSIVE rules AS (SELECT * FROM (VALUES {rules}) AS t(rule_host, rule_path, rule_verdict)),
    parsed AS (SELECT row_number() OVER () AS k, page_id, url, {h} AS host, {p} AS path, {n} AS node, html FROM pages),
    tags AS (SELECT url, node, host, path, regexp_extract(regexp_extract(html, {_sql(CANONICAL_TAG)}), {_sql(HREF)}, 1) AS link FROM parsed
             UNION ALL SELECT url, node, host, path, regexp_extract(regexp_extract(html, {_sql(REFRESH_TAG)}), {_sql(REFRESH_URL)}, 1) FROM parsed),
    aimed AS (SELECT node, CASE WHEN link = '' OR link IS NULL THEN NULL
                    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
                    WHEN link LIKE '//%' THEN split_part(url, '://', 1) || ':' || link
                    WHEN link LIKE '/%' THEN split_part(url, '://', 1) || '://' || host || link
                    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') OR link LIKE '#%' OR link LIKE '?%' THEN NULL
                    ELSE split_part(url, '://', 1) || '://' || host || CASE WHEN regexp_extract(path, '^(.*/)', 1) = '' THEN '/' ELSE regexp_extract(path, '^(.*/)', 1) END || link END AS target FROM tags),
    ends AS (SELECT node AS a, {tn} AS b, {th} AS host, {tp} AS path FROM aimed WHERE target IS NOT NULL),
    links AS (SELECT a, b FROM ends WHERE a <> b UNION SELECT b, a FROM ends WHERE a <> b),
    nodes AS (SELECT node, host, path FROM parsed UNION SELECT b, host, path FROM ends),
    reach AS (SELECT a, a AS b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    fits AS (SELECT node, host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(rule_verdict, length(rule_host || rule_path)) AS said
             FROM nodes JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY ALL),
    bad AS (SELECT DISTINCT r.a AS node FROM reach r JOIN fits f ON r.b = f.node WHERE said = 'block'),
    components AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY 1)
    SELECT page_id, host, path, rule, coalesce(said, CASE WHEN bad.node IS NOT NULL THEN 'block' END, 'allow') AS verdict, component
    FROM parsed LEFT JOIN (SELECT DISTINCT host, path, rule, said FROM fits) USING (host, path) LEFT JOIN bad ON bad.node = parsed.node LEFT JOIN components ON components.node = parsed.node"""


def _conversations_sql() -> str:
    """The cheapest scripts by states of the grammar, row by row; a script is its cost in nine digits and its audit,
    so that least() gives the cheapest, and the first in ASCII among those."""

    def more(x: str, cost: str, edit: str) -> str:
        return f"(lpad((left({x}, 9)::INTEGER + {cost})::VARCHAR, 9, '0') || substr({x}, 10) || '{edit}')"

    def put_in(inner: str) -> str:
        a = f"least(s2, {more('s0', '3', 'I')}, {more('s1', '3', 'I')}, {more('s3', '3', 'I')})"
        return f"(SELECT * REPLACE ({a} AS s2, least(s3, {more('s2', '3', 'I')}) AS s3) FROM {inner})"

    def step(to: int, symbol: str, *froms: int) -> str:
        kept = [f"CASE WHEN NOT must AND initial = '{symbol}' THEN {more(f's{x}', 'extra', 'K')} END" for x in froms]
        given = [f"CASE WHEN NOT must AND initial <> '{symbol}' THEN {more(f's{x}', 'extra + 3', 'R')} END" for x in froms if symbol != "s"]
        return f"least({', '.join([more(f's{to}', '4', 'D'), *kept, *given])})"

    bits = "list_reduce(list_prepend(c, range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ord(c)::BIGINT)), lambda x, b: xor(x >> 8, crc_table[(xor(x, b) & 255) + 1])), 4294967295)"
    blank = r"'[^\x20\x09-\x0D]'"
    role = "CASE WHEN i2 IN ('s', 'u', 'a') THEN i2 ELSE 'x' END"
    return rf"""
    WITH RECURSIVE coded AS (SELECT list_transform(range(256), lambda c: {bits}) AS crc_table),
    given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
    faults AS (SELECT *, {crc} % 20 AS fault FROM given, coded),
    hurt AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                    unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM faults),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM hurt),
    known AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, left(role, 1) AS i2, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS i1,
                     NOT regexp_matches(text, {blank}) AS blank FROM placed),
    judged AS (SELECT *, NOT blank AND seen AS again, NOT blank AND NOT seen AND NOT regexp_matches(text, '[.!?][ 	-
]*$') AS cut_off FROM known),
    sums AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again) AS duplicate,
                    count(*) FILTER (WHERE cut_off) AS truncated, count(*) FILTER (WHERE i > 1 AND i1 || i2 NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY 1),
    walk(conv_id, i, s0, s1, s2, s3) AS (SELECT conv_id, 0, '000000000', NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM sums
        UNION ALL SELECT conv_id, i, {more('s0', '4', 'D')}, {step(1, 's', 0)}, {step(2, 'u', 0, 1, 3)}, {step(3, 'a', 2)}
        FROM (SELECT w.conv_id, w.i + 1 AS i, s0, s1, s2, s3, {role} AS initial, blank OR again AS must, CASE WHEN cut_off THEN 3 ELSE 0 END AS extra
              FROM {put_in(put_in('walk'))} w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1)),
    ends AS (SELECT w.conv_id, least(s0, s3) AS script FROM {put_in(put_in('walk'))} w JOIN sums s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = s.n),
    edits AS (SELECT conv_id, unnest(string_split(substr(script, 10), '')) AS edit, generate_subscripts(string_split(substr(script, 10), ''), 1) AS spot FROM ends WHERE length(script) > 9),
    aimed AS (SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER o AS i, count(*) FILTER (WHERE edit <> 'D') OVER o AS place FROM edits WINDOW o AS (PARTITION BY conv_id ORDER BY spot)),
    met AS (SELECT a.conv_id, spot, edit, place, j.role, j.text, i2 FROM aimed a LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM a.conv_id AND j.i = a.i AND edit <> 'I' WHERE edit <> 'D'),
    led AS (SELECT *, coalesce(first_value(i2 = 's' AND edit = 'K') OVER (PARTITION BY conv_id ORDER BY spot), false) AS led FROM met),
    texts AS (SELECT conv_id, string_agg(CASE edit WHEN 'K' THEN role ELSE CASE WHEN (place - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE edit WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY spot) AS body
              FROM led GROUP BY 1)
    SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
           coalesce(left(script, 9)::BIGINT, 0) AS cost, coalesce(substr(script, 10), '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM c.conv_id"""


def _divergence_sql() -> str:
    return r"""
    WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    words AS (SELECT d, lang, source, unnest(w) AS term FROM docs),
    kept AS (SELECT lang, term, count(*) AS n_lang FROM words GROUP BY 1, 2 HAVING count(DISTINCT d) >= 3),
    langs AS (SELECT lang, count(*) AS v, sum(n_lang) AS total_lang FROM kept GROUP BY 1),
    counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
    totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY 1, 2),
    grps AS (SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN totals USING (lang, source) LEFT JOIN langs USING (lang)),
    dense AS (SELECT g.lang, g.source, k.term, n_lang, coalesce(n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (total + v))::HUGEINT AS p
              FROM grps g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
    q AS (SELECT *, (1 + 1000000000::HUGEINT * (n_lang + 1) // (total_lang + v))::HUGEINT AS q FROM dense JOIN langs USING (lang)),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM q WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
    FROM (FROM pairs UNION ALL FROM terms) QUALIFY part = 'pair' OR rank <= 200"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that have it. Vector search by quantised codes, packing, token counts, the
    classifier, fingerprints by XXH64, the choice by hash within a source and a hash's place in a shard have none: tests
    hold those against brute force. Sums that follow from the shards' and the mix's rules are
    queries of their own."""
    return {
        "op2_license_scan": _licenses_sql(),
        "op3_minhash": _near_copies_sql(),
        "op4_sharding_curve": _shards_sql(),
        "op7_mixing_targets": _mixing_sql(),
        "op8_url_filter": _urls_sql(),
        "op10_topk": _topk_sql(),
        "op12_conversations": _conversations_sql(),
        "op13_divergence": _divergence_sql(),
    }
