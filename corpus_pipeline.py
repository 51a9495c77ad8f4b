"""From raw documents to packed training sequences.

Stages: language identification (documents in no language go), near-duplicate removal (one document
of each group stays), mixing of the sources to their target weights (documents repeat or go), packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.llm import queries as q
from cladeflow.llm.common import Tables
from cladeflow.llm.minhash import near_duplicates
from cladeflow.llm.mixing import mix


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; null texts, those without a letter and those like no landmark of any
    language go. The rule doesn't depend on the number of languages or on a text's length."""
    told = q.languages(docs)
    return told.filter((F.col("lang_pred") != q.UNDETERMINED) & F.col("lang_claimed")).select(docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest doc_id with all its rows; documents
    without words are no copies of each other, and a row without an id stays."""
    found = near_duplicates(docs).filter("kept").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_semi").union(docs.filter("doc_id IS NULL"))


def sources_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, which may be never. A null source is a source."""
    taken = mix(docs, F.array(F.col("source"))).docs
    return taken.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all windows. An empty table has none."""
    return q.packed_digest(q.packed(docs))


STAGES = [
    ("language", in_a_language),
    ("near copies", without_near_copies),
    ("mixing", sources_mixed),
    ("packing", packed),
]

#: A learned classifier, hashed signatures and tokenizer ids have no SQL form; tests hold the stages
#: against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, over the documents of ``sf_dir``.

    What a stage keeps is written once, so that the next ones, which read their input several times,
    don't repeat it, and is deleted when the next stage's is written. Null texts and texts without
    letters go in the first stage; null ids, null sources and repeated rows pass (see the stages); an
    empty table gives no pieces.
    """
    docs, tables, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Tables(spark), None
    for _, stage in STAGES[:-1]:
        docs = tables.put(stage(spark, docs, sf_dir))
        tables.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
