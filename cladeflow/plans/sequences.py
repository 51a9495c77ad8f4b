"""Registered queries over documents as sequences, and embeddings as features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.functions import columns as fn
from cladeflow.operators import kmers as op
from cladeflow.operators.common import first_by, range_bucket, running
from cladeflow.plans.registry import Tables, query

SEQ = "translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"
RC = "translate(reverse({0}), 'ACGTacgt', 'TGCAtgca')"


def seqs_sql() -> str:
    return f"seqs AS (SELECT doc_id, source, lang, {SEQ} AS seq FROM documents)"


def kmers_sql(k: int, name: str = "km", seq: str = "seq") -> str:
    return f"{name} AS (SELECT doc_id, kmer, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(range(1, length({seq}) - {k - 2}), lambda i: substr({seq}, i::INT, {k}))) AS kmer FROM seqs) WHERE regexp_full_match(kmer, '[ACGT]+') GROUP BY 1, 2)"


def seqs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source", "lang", fn.sequence_of(F.col("text")).alias("seq"))


@query(f"WITH {seqs_sql()}, {kmers_sql(4)} SELECT doc_id, kmer, n FROM km")
def k1_kmer_counts(t: Tables) -> DataFrame:
    return op.kmer_counts(seqs(t), "doc_id", "seq", 4)


@query(f"WITH {seqs_sql()}, {kmers_sql(3)} SELECT doc_id, least(kmer, {RC.format('kmer')}) AS kmer, sum(n)::BIGINT AS n FROM km GROUP BY 1, 2")
def k2_merged_strands(t: Tables) -> DataFrame:
    return op.kmer_counts(seqs(t), "doc_id", "seq", 3, merge=True)


@query(f"WITH {seqs_sql()}, {kmers_sql(3)} SELECT doc_id, kmer, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 8) AS freq FROM km")
def k3_frequencies(t: Tables) -> DataFrame:
    return op.frequencies(op.kmer_counts(seqs(t), "doc_id", "seq", 3), "doc_id", unit=True).select("doc_id", "kmer", F.round("freq", 8).alias("freq"))


@query(f"WITH {seqs_sql()}, {kmers_sql(5)} SELECT doc_id, count(*) AS kinds FROM km GROUP BY 1")
def k4_presence(t: Tables) -> DataFrame:
    return op.code_counts(seqs(t), "doc_id", "seq", [5]).groupBy("doc_id").agg(F.count("*").alias("kinds"))


@query(f"""WITH {seqs_sql()}, {kmers_sql(1, 'k1')}, {kmers_sql(2, 'k2')}, {kmers_sql(3, 'k3')}, tot AS (SELECT doc_id, sum(n) AS total, count(*) AS kinds FROM k1 GROUP BY 1),
    x AS (SELECT doc_id, 1 AS k, kmer, n, total / kinds AS expected FROM k1 JOIN tot USING (doc_id)
      UNION ALL SELECT a.doc_id, 2, a.kmer, a.n, p.n * l.n / total FROM k2 a JOIN k1 p ON a.doc_id = p.doc_id AND left(a.kmer, 1) = p.kmer JOIN k1 l ON a.doc_id = l.doc_id AND right(a.kmer, 1) = l.kmer JOIN tot ON a.doc_id = tot.doc_id
      UNION ALL SELECT a.doc_id, 3, a.kmer, a.n, p.n * l.n / total FROM k3 a JOIN k2 p ON a.doc_id = p.doc_id AND left(a.kmer, 2) = p.kmer JOIN k1 l ON a.doc_id = l.doc_id AND right(a.kmer, 1) = l.kmer JOIN tot ON a.doc_id = tot.doc_id)
    SELECT doc_id, k, kmer, n, round(expected, 6) AS expected, round((n - expected) / expected, 4) AS feature FROM x""")
def k5_ladder(t: Tables) -> DataFrame:
    out = op.ladder(seqs(t), "doc_id", "seq", 3)
    return out.withColumn("expected", F.round("expected", 6)).withColumn("feature", F.round("feature", 4))


@query(f"""WITH {seqs_sql()}, {kmers_sql(2, 'k2')}, {kmers_sql(3, 'k3')}, x AS (SELECT doc_id, 2 AS k, kmer, n FROM k2 UNION ALL SELECT doc_id, 3, kmer, n FROM k3)
    SELECT doc_id, k, kmer, n / sum(n) OVER (PARTITION BY doc_id, k) AS freq FROM x""")
def k6_frequency_by_level(t: Tables) -> DataFrame:
    s = seqs(t)
    parts = [op.frequencies(op.kmer_counts(s, "doc_id", "seq", k), "doc_id").select("doc_id", F.lit(k).alias("k"), "kmer", "freq") for k in (2, 3)]
    return parts[0].union(parts[1])


@query(f"""WITH {seqs_sql()}, {kmers_sql(3)}, {kmers_sql(3, 'rv', 'reverse(seq)')} SELECT a.doc_id, a.kmer, a.n / coalesce(r.n, 1.0) AS ratio FROM km a LEFT JOIN rv r ON a.doc_id = r.doc_id AND a.kmer = r.kmer""")
def k7_reversed_ratio(t: Tables) -> DataFrame:
    s = seqs(t)
    rev = op.kmer_counts(s.withColumn("seq", F.reverse("seq")), "doc_id", "seq", 3)
    return op.against_reversed(op.kmer_counts(s, "doc_id", "seq", 3), rev, "doc_id", F.lit(1.0)).select("doc_id", "kmer", "ratio")


@query(f"WITH {seqs_sql()} SELECT doc_id, 1 AS strand, md5(seq) AS digest FROM seqs UNION ALL SELECT doc_id, -1, md5({RC.format('seq')}) FROM seqs")
def k8_both_strands(t: Tables) -> DataFrame:
    s = seqs(t)
    return s.select("doc_id", F.lit(1).alias("strand"), F.md5("seq").alias("digest")).union(s.select("doc_id", F.lit(-1), F.md5(fn.reverse_complement(F.col("seq")))))


@query("SELECT doc_id, length(text)::BIGINT AS n, 0::BIGINT AS odd FROM documents")
def k9_replaced_degenerates(t: Tables) -> DataFrame:
    s = op.replace_degenerate(t.documents.select("doc_id", "text"), "doc_id", "text", 4)
    return s.select("doc_id", F.length("text").cast("long").alias("n"), F.length(F.regexp_replace("text", "[ACGTacgt]", "")).cast("long").alias("odd"))


@query("""WITH p AS (SELECT doc_id, regexp_extract_all(text, '[ACGTacgt]+|[^ACGTacgt]') AS w FROM (SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents))
    SELECT doc_id, array_to_string(list_transform(w, lambda x, i: CASE WHEN regexp_matches(x, '^[ACGTacgt]') THEN x ELSE substr('ACGT', (('0x' || substr(md5(doc_id || '-' || (i - 1) || ':4'), 1, 4))::INTEGER % 4 + 1)::INT, 1) END), '') AS bases FROM p""")
def k9_drawn_bases(t: Tables) -> DataFrame:
    """The bases that stand for other symbols, in whole texts."""
    texts = t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("bases"))
    return op.replace_degenerate(texts, "doc_id", "bases", 4)


@query(f"WITH {seqs_sql()} SELECT doc_id AS old_id, s::INT AS start, (s + 400)::INT AS \"end\", md5(substr(seq, (s + 1)::INT, 400)) AS digest FROM (SELECT doc_id, seq, unnest(range(0, length(seq) - 399, 200)) AS s FROM seqs WHERE length(seq) >= 400)")
def k10_shredded(t: Tables) -> DataFrame:
    return op.shred(seqs(t), "doc_id", "seq", 400, -200).select("old_id", "start", "end", F.md5("frag").alias("digest"))


@query(f"""WITH {seqs_sql()}, f AS (SELECT doc_id, unnest(range(0, length(seq) - 99, 100)) AS s FROM seqs WHERE length(seq) >= 100)
    SELECT doc_id AS old_id, s::INT AS start FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY md5(doc_id || '-' || s || ':6'), s) <= 5""")
def k11_capped_fragments(t: Tables) -> DataFrame:
    return op.shred(seqs(t), "doc_id", "seq", 100, n=5, seed=6).select("old_id", "start")


@query(f"""WITH {seqs_sql()}, r AS (SELECT source, 2000 * 100 / sum(length(seq))::DOUBLE AS ratio FROM seqs GROUP BY 1), x AS (SELECT doc_id, source, seq, ratio, length(seq) * ratio / 100 AS share FROM seqs JOIN r USING (source)),
    q AS (SELECT doc_id, source, seq, CASE WHEN ratio < 1 THEN floor(share) + CASE WHEN share - floor(share) > ('0x' || substr(md5(doc_id || ':quota:6'), 1, 8))::BIGINT / 4294967296.0 THEN 1 ELSE 0 END ELSE -1 END AS quota FROM x),
    f AS (SELECT source, doc_id, quota, unnest(range(0, length(seq) - 99, 100)) AS s FROM q WHERE length(seq) >= 100)
    SELECT source, doc_id AS old_id, s::INT AS start FROM f QUALIFY quota < 0 OR row_number() OVER (PARTITION BY doc_id ORDER BY md5(doc_id || '-' || s || ':6'), s) <= quota""")
def k11_reference_fragments(t: Tables) -> DataFrame:
    return op.capped_fragments(seqs(t), "source", "doc_id", "seq", 100, 2000, 6).select("source", "old_id", "start")


@query(f"WITH {seqs_sql()}, h AS (SELECT *, floor(('0x' || substr(md5(doc_id || ':8'), 1, 8))::BIGINT / 4294967296.0 * (greatest(length(seq) - 300, 0) + 1))::INT AS s FROM seqs) SELECT doc_id, s AS start, md5(substr(seq, s + 1, 300)) AS digest FROM h")
def k12_random_part(t: Tables) -> DataFrame:
    return op.random_part(seqs(t), "doc_id", "seq", 300, 8).select("doc_id", "start", F.md5("part").alias("digest"))


@query(f"""WITH {seqs_sql()}, p AS (SELECT source, doc_id, sum(length(seq)) OVER (PARTITION BY source ORDER BY doc_id) AS e, length(seq) AS n FROM seqs),
    c AS (SELECT source, doc_id, e - n AS s, unnest(range(ceil((e - n) / 1000)::BIGINT, ceil(e / 1000)::BIGINT)) AS chunk FROM p) SELECT source, chunk, doc_id, (chunk * 1000 - s)::BIGINT AS "offset" FROM c""")
def k13_chunk_index(t: Tables) -> DataFrame:
    return op.chunk_index(seqs(t).withColumn("n", F.length("seq").cast("long")), "source", "doc_id", "n", 1000)


@query("WITH l AS (SELECT doc_id, quality * 2 + toxic AS label FROM labels), n AS (SELECT floor(quantile_cont(n, 0.5))::BIGINT AS m FROM (SELECT count(*) AS n FROM l GROUP BY label)) SELECT doc_id, label FROM l, n QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5(doc_id || ':1'), doc_id) <= m")
def k14_balanced(t: Tables) -> DataFrame:
    return op.balance(t.labels.select("doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("label")), "label", "doc_id", "median", 1)


@query("SELECT vec_id, count(*) AS n, round(sum(i * v), 5) AS checked FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) WHERE v <> 0 GROUP BY 1")
def k15_sparse_and_dense(t: Tables) -> DataFrame:
    s = op.to_dense(op.to_sparse(t.embeddings.withColumn("v", F.col("embedding").cast("array<double>")), "v"), "sparse", 64)
    total = F.aggregate(F.transform("dense", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return s.select("vec_id", F.size("sparse").cast("long").alias("n"), F.round(total, 5).alias("checked"))


@query("SELECT doc_id, dense_rank() OVER (ORDER BY source) - 1 AS number, CASE WHEN source = 'src3' THEN 1 ELSE -1 END AS one FROM documents")
def k16_renumbered(t: Tables) -> DataFrame:
    return op.renumber(t.documents.select("doc_id", "source"), "source").select("doc_id", "number", F.when(F.col("source") == "src3", 1).otherwise(-1).alias("one"))


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':2'), doc_id) <= round(0.3 * count(*) OVER (PARTITION BY lang))")
def k17_sample_by_ratio(t: Tables) -> DataFrame:
    h = fn.seeded("doc_id", 2)
    d = running(t.documents.select("doc_id", "lang"), "lang", F.coalesce(F.substring(h, 1, 2), F.lit("")), [h, F.col("doc_id")], F.lit(1))
    return d.filter(F.col("_run") <= F.round(0.3 * F.col("_total"))).select("doc_id", "lang")


@query("""WITH u AS (SELECT vec_id AS unit, embedding AS w FROM embeddings WHERE vec_id < 9), d AS (SELECT vec_id, label, unit, sqrt(list_sum(list_transform(list_zip(embedding, w), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))) AS dist FROM embeddings, u),
    b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, unit) = 1) SELECT label, unit, count(*) AS n FROM b WHERE dist <= 1.3 GROUP BY 1, 2""")
def k19_grid_units(t: Tables) -> DataFrame:
    e = t.embeddings
    units = e.filter("vec_id < 9").select(F.col("vec_id").alias("unit"), F.col("embedding").alias("weights"))
    near = op.nearest_units(e, "vec_id", "embedding", units, 1.3)
    return near.join(e.select("vec_id", "label"), "vec_id").groupBy("label", "unit").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT vec_id, embedding AS v FROM embeddings ORDER BY md5(vec_id || ':20'), vec_id LIMIT 200), d AS (SELECT sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))) AS dist FROM s a JOIN s b ON a.vec_id < b.vec_id)
    SELECT round(quantile_cont(dist, 0.18), 8) AS radius FROM d""")
def k20_radius(t: Tables) -> DataFrame:
    return op.pair_radius(t.embeddings, "vec_id", "embedding", rows=200).select(F.round("radius", 8).alias("radius"))


@query(f"WITH {seqs_sql()}, f AS (SELECT doc_id, unnest(range(0, length(seq) - 399, 400)) AS s FROM seqs WHERE length(seq) >= 400) SELECT doc_id || '_' || s AS id, quality, toxic FROM f JOIN labels USING (doc_id)")
def k21_labels_of_fragments(t: Tables) -> DataFrame:
    f = op.shred(seqs(t), "doc_id", "seq", 400).select(F.col("old_id").alias("doc_id"), "start")
    return f.join(t.labels, "doc_id").select(F.concat(F.col("doc_id").cast("string"), F.lit("_"), F.col("start").cast("string")).alias("id"), "quality", "toxic")


@query("""WITH f AS (SELECT l_orderkey, l_linenumber * 100 AS s, l_linenumber * 100 + l_quantity::INT AS e, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS strand FROM lineitem),
    g AS (SELECT *, coalesce(max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM f)
    SELECT l_orderkey, s AS start, e AS "end", strand FROM f UNION ALL SELECT l_orderkey, reach, s, 0 FROM g WHERE s > reach UNION ALL SELECT l_orderkey, max(e), 1000, 0 FROM f GROUP BY 1""")
def k22_coding_split(t: Tables) -> DataFrame:
    at = F.col("l_linenumber") * 100
    f = t.lineitem.select("l_orderkey", at.cast("int").alias("start"), (at + F.col("l_quantity")).cast("int").alias("end"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("strand"))
    return op.split_by_features(f.select("l_orderkey", F.lit(1000).alias("n")).distinct(), f, "l_orderkey", "n")


@query(f"""WITH {seqs_sql()}, f AS (SELECT source, source || '_' || doc_id || '_' || s AS id FROM (SELECT source, doc_id, unnest(range(0, length(seq) - 199, 200)) AS s FROM seqs WHERE length(seq) >= 200))
    SELECT source, id FROM f QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5(id || ':3'), id) <= 50""")
def k23_capped_union(t: Tables) -> DataFrame:
    s = seqs(t)
    f = op.shred(s, "doc_id", "seq", 200).join(s.select(F.col("doc_id").alias("old_id"), "source"), "old_id")
    named = f.select("source", F.concat_ws("_", "source", F.col("old_id").cast("string"), F.col("start").cast("string")).alias("id"))
    return op.balance(named, "source", "id", 50, 3)


@query(f"""WITH {seqs_sql()}, r AS (SELECT 200000 / (2.0 * sum(length(seq))) AS ratio FROM seqs), b AS (SELECT doc_id, 1 AS strand, seq FROM seqs UNION ALL SELECT doc_id, -1, {RC.format('seq')} FROM seqs),
    c AS (SELECT doc_id, strand, seq, floor(length(seq) * ratio::DOUBLE)::INT AS n FROM b, r), p AS (SELECT *, floor(('0x' || substr(md5(doc_id || ':5'), 1, 8))::BIGINT / 4294967296.0 * (length(seq) - n + 1))::INT AS s FROM c)
    SELECT doc_id, strand, md5(substr(seq, s + 1, n)) AS digest FROM p""")
def k24_training_text(t: Tables) -> DataFrame:
    return op.training_text(seqs(t).select("doc_id", "seq"), "doc_id", "seq", 200_000, 5).select("doc_id", "strand", F.md5("seq").alias("digest"))


@query(f"WITH {seqs_sql()} SELECT source, md5(string_agg(seq, 'NNNNNNN' ORDER BY doc_id)) AS digest FROM seqs GROUP BY 1")
def k25_concatenated(t: Tables) -> DataFrame:
    return op.concatenated(seqs(t), "source", "doc_id", "seq").select("source", F.md5("seq").alias("digest"))


@query(f"""WITH {seqs_sql()}, w AS (SELECT source, string_agg(seq, 'NNNNNNN' ORDER BY doc_id) AS s FROM seqs GROUP BY 1), p AS (SELECT source, s, unnest(range(0, (length(s) + 4999) // 5000)) AS part FROM w)
    SELECT source, part, md5(substr(s, part * 5000 + 1, 5000)) AS digest FROM p""")
def k25_concatenated_parts(t: Tables) -> DataFrame:
    return op.concatenated_parts(seqs(t), "source", "doc_id", "seq", 5000).select("source", "part", F.md5("seq").alias("digest"))


@query("SELECT vec_id, label || ' 1:' || printf('%.4f', embedding[1]::DOUBLE) || ' 2:' || printf('%.4f', embedding[2]::DOUBLE) || ' 3:' || printf('%.4f', embedding[3]::DOUBLE) AS line FROM embeddings")
def snk8_svmlight_lines(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", op.svmlight(F.col("label"), F.slice("embedding", 1, 3)).alias("line"))


@query(f"WITH {seqs_sql()} SELECT doc_id, '>' || doc_id || ' ' || source || chr(10) || rtrim(regexp_replace(seq, '(.{{80}})', '\\1' || chr(10), 'g'), chr(10)) AS record FROM seqs")
def snk4_fasta_records(t: Tables) -> DataFrame:
    return seqs(t).select("doc_id", F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit(" "), "source", F.lit("\n"), fn.wrap_lines(F.col("seq"))).alias("record"))


@query(f"WITH {seqs_sql()} SELECT source, ((sum(length(seq)) OVER (PARTITION BY source ORDER BY doc_id) - length(seq)) // 20000)::BIGINT AS chunk_id, doc_id, length(seq)::BIGINT AS n FROM seqs")
def snk6_size_chunks(t: Tables) -> DataFrame:
    s = seqs(t).select("source", "doc_id", F.length("seq").cast("long").alias("n"))
    x = running(s, "source", range_bucket(s, "doc_id"), ["doc_id"], F.col("n"))
    return x.select("source", F.floor((F.col("_run") - F.col("n")) / 20000).alias("chunk_id"), "doc_id", "n")


@query(f"WITH {seqs_sql()}, c AS (SELECT doc_id, unnest(string_split(seq, '')) AS symbol FROM seqs) SELECT symbol, count(*) AS n FROM c WHERE symbol <> '' GROUP BY 1")
def x11_alphabet(t: Tables) -> DataFrame:
    per = seqs(t).select(*[(F.length("seq") - F.length(F.replace("seq", F.lit(b), F.lit("")))).alias(b) for b in "ACGT"])
    return per.agg(*[F.sum(b).alias(b) for b in "ACGT"]).unpivot([], list("ACGT"), "symbol", "n").filter("n > 0")


@query(f"WITH {seqs_sql()} SELECT source, doc_id FROM seqs QUALIFY row_number() OVER (PARTITION BY source ORDER BY length(seq) DESC, doc_id) <= 2")
def k_longest_sequences(t: Tables) -> DataFrame:
    return first_by(seqs(t).withColumn("n", F.length("seq")), ["source"], [F.desc("n"), F.col("doc_id")], 2).select("source", "doc_id")


@query(f"WITH {seqs_sql()} SELECT source || ' ' || length(seq) AS header, md5(reverse(seq)) AS digest FROM seqs WHERE length(seq) >= 500")
def u4_record_callback(t: Tables) -> DataFrame:
    s = seqs(t).select(F.col("source").alias("header"), "seq")
    kept = op.filter_records(s, "header", "seq", lambda h, x: (f"{h} {len(x)}", x[::-1]) if len(x) >= 500 else None)
    return kept.select("header", F.md5("seq").alias("digest"))
