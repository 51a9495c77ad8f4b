"""DataFrames as files of sequences, features and reports."""

from __future__ import annotations

import os
import re
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeflow.functions.columns import wrap_lines
from cladeflow.operators.tree import nested_sets, node_levels

#: Characters that Spark writes as % and their code in the name of a partition's folder.
ESCAPED = re.compile(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""")


def write_fasta(df: DataFrame, path: str, header: Column, seq: str, width: int = 80, by: str | None = None) -> None:
    """Records with wrapped lines; ``by``: a folder for each value of a column."""
    record = F.concat(F.lit(">"), header, F.lit("\n"), wrap_lines(F.col(seq), width))
    out = df.select(record.alias("value"), *([by] if by else []))
    (out.write.partitionBy(by) if by else out.write).mode("overwrite").text(path)


def write_report(df: DataFrame, path: str, sep: str = "\t", header: bool = True, comment: str | None = None, epilog: str | None = None, append: bool = False) -> None:
    """A delimited report; ``append``: behind what is there.

    With a comment, the first file holds the comment and the header, and the rows follow in files after it, as
    many as there are tasks; an epilog is the last file. Files are numbered in that order.
    """
    mode = "append" if append else "overwrite"
    if comment is None and epilog is None:
        df.write.mode(mode).csv(path, sep=sep, header=header)
        return
    spark = df.sparkSession
    one = lambda text: spark.createDataFrame([(text,)], "value string").coalesce(1)
    lines = df.select(F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value"))
    top = [f"#{comment}"] if comment is not None else []
    top += [sep.join(df.columns)] if header or comment is not None else []
    out = one("\n".join(top)).union(lines) if top else lines
    (out.union(one(epilog)) if epilog is not None else out).write.mode(mode).text(path)


def gff_line(contig: Column, source: Column, kind: Column, start: Column, end: Column, score: Column, strand: Column, attributes: Column) -> Column:
    """A GFF3 line from a half-open interval from 0; unsafe characters of attributes become blanks."""
    safe = F.transform(F.map_entries(attributes), lambda e: F.concat(e["key"], F.lit("="), F.regexp_replace(e["value"], r"[^A-Za-z0-9_.:^*$@!+?|\[\] -]", " ")))
    sign = F.when(strand > 0, "+").when(strand < 0, "-").otherwise(".")
    return F.concat_ws("\t", contig, source, kind, (start + 1).cast("string"), end.cast("string"), F.coalesce(score.cast("string"), F.lit(".")), sign, F.lit("."), F.array_join(safe, ";"))


def write_lines(df: DataFrame, line: Column, path: str, by: str | None = None) -> None:
    out = df.select(line.alias("value"), *([by] if by else []))
    (out.write.partitionBy(by) if by else out.write).mode("overwrite").text(path)


def write_gff(df: DataFrame, line: Column, path: str, contig: str | None = None) -> None:
    """GFF3 lines; ``contig``: a folder for each of its values, whose files begin as the format wants."""
    lines, first = df.select(line.alias("value"), *([contig] if contig else [])), "##gff-version 3"
    if contig is None:
        lines.write.mode("overwrite").text(path)
        return
    if re.match("file:(//)?/[^/]", path):
        write_folders(lines, path, contig, first)
        return
    heads = df.select(F.lit(first).alias("value"), contig).distinct()
    both = heads.withColumn("_k", F.lit(0)).union(lines.withColumn("_k", F.lit(1)))
    # a contig's header is the first line of its one file
    both.repartition(contig).sortWithinPartitions(contig, "_k").drop("_k").write.partitionBy(contig).mode("overwrite").text(path)


def write_folders(lines: DataFrame, path: str, by: str, first: str) -> None:
    """Lines (value, ``by``) as one file for each value of ``by``, with ``first`` as its first line, in folders named as by
    partitionBy(), at a file: path that all machines share.

    Without Hadoop's native library Spark starts a process (chmod) for each folder, file and checksum that it
    makes on such a path, and the driver renames each folder; with very many values that takes most of the time. Here
    tasks write the files, a line after another, under another name until they are whole, so that a task may be run again.
    """
    root = "/" + path.removeprefix("file:").lstrip("/")
    none = lines.limit(0).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    none.partitionBy(by).mode("overwrite").text(path)  # an empty folder

    def run(batches):
        key = folder = out = None
        files = 0

        def shut() -> None:
            nonlocal out
            if out is not None:
                out.close()
                os.replace(out.name, f"{folder}/part-00000.txt")
                out = None

        try:
            for b in batches:
                value, runs = pc.fill_null(b.column(0), ""), pc.run_end_encode(b.column(1))
                at = 0
                for k, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                    if out is None or k != key:
                        shut()
                        name = "__HIVE_DEFAULT_PARTITION__" if k is None else ESCAPED.sub(lambda x: f"%{ord(x[0]):02X}", k)
                        key, folder, files = k, f"{root}/{by}={name}", files + 1
                        os.makedirs(folder, exist_ok=True)
                        out = open(f"{folder}/.{uuid.uuid4().hex}", "w", encoding="utf-8", newline="\n")
                        out.write(f"{first}\n")
                    out.write("\n".join(value.slice(at, end - at).to_pylist()) + "\n")
                    at = end
            shut()
        finally:
            if out is not None:  # the task failed
                out.close()
                os.remove(out.name)
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    keyed = lines.select("value", F.nullif(F.col(by).cast("string"), F.lit("")).alias(by))
    keyed.repartition(by).sortWithinPartitions(by).mapInArrow(run, "files long").collect()
    open(f"{root}/_SUCCESS", "w").close()


def write_tree(nodes: DataFrame, path: str) -> None:
    nodes.select("id", "idpar", "rank", "name").write.mode("overwrite").json(path)


def write_tree_tables(nodes: DataFrame, pairs: DataFrame, path: str, levels: dict[str, int], attributes: DataFrame | None = None) -> None:
    """A tree as tables under ``path``: nodes (id, idpar, rank, lnest, rnest, depth), names (id, name), levels (rank, level), node_levels
    (id, level of its rank, nearest level above or its own) and attributes (id and what is given of it)."""
    put = lambda df, name: df.write.mode("overwrite").parquet(f"{path}/{name}")
    put(nodes.select("id", "idpar", "rank").join(nested_sets(nodes, pairs), "id"), "nodes")
    put(nodes.select("id", "name"), "names")
    put(nodes.sparkSession.createDataFrame(list(levels.items()), "rank string, level int"), "levels")
    put(node_levels(nodes, pairs, levels), "node_levels")
    if attributes is not None:
        put(attributes.join(nodes.select("id"), "id", "left_semi"), "attributes")
