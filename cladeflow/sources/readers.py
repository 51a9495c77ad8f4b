"""Files of sequences, taxonomies and annotations as DataFrames. All take globs and lists of paths."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DUMP = "\t|\t"


def read_fasta(spark: SparkSession, path, with_file: bool = False) -> DataFrame:
    """(id, header, seq): a record runs to the next line that begins with >; the id ends at the first blank."""
    df = spark.read.option("lineSep", "\n>").text(path)
    df = df.withColumn("file", F.input_file_name()) if with_file else df
    whole = F.regexp_replace("value", "^>", "")
    header = F.regexp_extract(whole, r"^([^\r\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace(whole, r"^[^\r\n]*", ""), r"\s", "")
    out = df.filter(F.trim("value") != "").select(header.alias("header"), seq.alias("seq"), *(["file"] if with_file else []))
    return out.select(F.regexp_extract("header", r"^(\S*)", 1).alias("id"), *out.columns)


def read_fasta_parts(spark: SparkSession, path, size: int = 1 << 16) -> DataFrame:
    """(file, record, id, header, start, seq): records in parts of up to ``size`` symbols and a line, ``start`` being where in the
    record a part begins. ``record`` numbers a file's records by the place of the block that they begin in.

    Spark cuts files into blocks at any line, so that a record of many lines is read by as many tasks as it has
    blocks. Each block is read once, in order; what it holds before its first header belongs to
    the last header of the blocks before it, which follows from a row for each block. (A sequence on one line is one row
    of one task; compressed files are one block.) Text before a file's first header is no record.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    kinds = "file string, block long, k long, header string, start long, seq string, len long"

    def parts(batches):
        place = header = None
        k = start = 0
        held: list = []
        n = 0
        rows: list = []

        def put() -> None:
            nonlocal held, n, start
            if held:
                text = "".join(held)
                rows.append((*place, k, header, start, text, len(text)))
                start, held, n = start + len(text), [], 0

        for b in batches:
            for value, file, block in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if place != (file, block):
                    put()
                    place, header, k, start = (file, block), None, 0, 0
                if value.startswith(">"):
                    put()
                    header, k, start = value[1:].rstrip("\r"), k + 1, 0
                    rows.append((*place, k, header, 0, None, 0))  # so that an empty record ends the one before it
                else:
                    text = "".join(value.split())
                    if text:
                        held.append(text)
                        n += len(text)
                        if n >= size:
                            put()
                if len(rows) >= 64:
                    yield pa.RecordBatch.from_pylist(rows_of(rows), schema=schema)
                    rows.clear()
        put()
        if rows:
            yield pa.RecordBatch.from_pylist(rows_of(rows), schema=schema)

    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("k", pa.int64()), ("header", pa.string()), ("start", pa.int64()), ("seq", pa.string()), ("len", pa.int64())])
    rows_of = lambda rows: [dict(zip(schema.names, r, strict=True)) for r in rows]
    found = lines.mapInArrow(parts, kinds)
    # a row for each block: its last header, and the symbols behind it (or all, without a header)
    last = F.max("k")
    blocks = found.groupBy("file", "block", "k").agg(F.max("header").alias("header"), F.sum("len").alias("len"))
    blocks = blocks.groupBy("file", "block").agg(last.alias("k"), F.max_by("header", "k").alias("header"), F.max_by("len", "k").alias("behind"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_of", F.when(F.col("k") > 0, F.col("block")))
    blocks = blocks.withColumn("_owner", F.last("_of", ignorenulls=True).over(before)).withColumn("_header", F.last(F.when(F.col("k") > 0, F.col("header")), ignorenulls=True).over(before)).withColumn("_k", F.last(F.when(F.col("k") > 0, F.col("k")), ignorenulls=True).over(before))
    # symbols of the record before this block: of its owner and the blocks without a header since
    owner = F.coalesce("_of", "_owner")
    since = Window.partitionBy("file", "_since").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    sums = blocks.withColumn("_since", owner).withColumn("_end", F.sum("behind").over(since))
    lead = sums.select("file", F.col("block").alias("_at"), F.col("_end"))
    sums = blocks.withColumn("_before", F.lag("block").over(Window.partitionBy("file").orderBy("block"))).join(lead.withColumnRenamed("_at", "_before"), ["file", "_before"], "left")
    sums = sums.select("file", "block", "_owner", "_header", "_k", F.col("_end").alias("_ahead"))
    out = found.filter("seq IS NOT NULL").join(sums, ["file", "block"])
    led = F.col("k") == 0
    header = F.when(led, F.col("_header")).otherwise(F.col("header"))
    record = F.concat_ws("-", F.when(led, F.col("_owner")).otherwise(F.col("block")).cast("string"), F.when(led, F.col("_k")).otherwise(F.col("k")).cast("string"))
    out = out.withColumn("_h", header).filter("_h IS NOT NULL")
    return out.select("file", record.alias("record"), F.regexp_extract("_h", r"^(\S*)", 1).alias("id"), F.col("_h").alias("header"), (F.col("start") + F.when(led, F.coalesce("_ahead", F.lit(0))).otherwise(0)).alias("start"), "seq")


def _dump(spark: SparkSession, path, names: list[str]) -> DataFrame:
    """A dump whose fields are parted by tab, bar, tab and whose rows end in tab, bar."""
    parts = F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t")
    return spark.read.text(path).select(*[F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(names)])


def read_nodes(spark: SparkSession, path) -> DataFrame:
    """(id, idpar, rank, divid); the root, its own parent in the file, gets 0; blanks in ranks become _."""
    d = _dump(spark, path, ["id", "idpar", "rank", "embl", "divid"])
    parent = F.when(F.col("id") == F.col("idpar"), 0).otherwise(F.col("idpar").cast("long"))
    return d.select(F.col("id").cast("long").alias("id"), parent.cast("long").alias("idpar"), F.replace("rank", F.lit(" "), F.lit("_")).alias("rank"), F.col("divid").cast("int").alias("divid"))


def read_names(spark: SparkSession, path, all_names: bool = False) -> DataFrame:
    """(id, name) of scientific names, or (id, names: by class a list)."""
    d = _dump(spark, path, ["id", "name", "unique_name", "class"]).withColumn("id", F.col("id").cast("long"))
    if not all_names:
        return d.filter(F.col("class").startswith("scientific name")).select("id", "name")
    per = d.groupBy("id", "class").agg(F.array_sort(F.collect_list("name")).alias("names"))
    return per.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("class", "names")))).alias("names"))


def read_merged(spark: SparkSession, path) -> DataFrame:
    return _dump(spark, path, ["old_id", "new_id"]).select(F.col("old_id").cast("long"), F.col("new_id").cast("long"))


def read_gi_taxids(spark: SparkSession, path) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="gi long, taxid int")


def read_categories(spark: SparkSession, path) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="cat string, anc_id long, taxid long")


def read_table(spark: SparkSession, path, columns: list[str] | None = None, header: bool = True, prefix: str = "fld_", overrides: dict[str, tuple[str, str]] | None = None, sep: str = "\t", where: str | None = None) -> DataFrame:
    """A delimited file: text columns, named by the header or ``prefix`` and their place; ``overrides`` maps
    a column to its (new name, type), and one that isn't there is an error; ``where`` filters on load."""
    df = spark.read.csv(path, sep=sep, header=header, inferSchema=False)
    if not header:
        df = df.toDF(*(columns or [f"{prefix}{k}" for k in range(len(df.columns))]))
    overrides = overrides or {}
    if missing := set(overrides) - set(df.columns):
        raise ValueError(f"no columns {sorted(missing)}")
    df = df.select(*[F.col(f"`{c}`").cast(overrides[c][1]).alias(overrides[c][0]) if c in overrides else F.col(f"`{c}`") for c in df.columns])
    return df.filter(where) if where else df


def read_models(spark: SparkSession, path, key: str = "models") -> DataFrame:
    """Model descriptions, a list under ``key``, to (id_seq, id, name, taxid), a row for each sequence of a model."""
    schema = f"`{key}` array<struct<ids_seq: array<string>, id: string, name: string, taxid: long>>"
    return spark.read.json(path, multiLine=True, schema=schema).select(F.explode(F.col(f"`{key}`")).alias("m")).select(F.explode("m.ids_seq").alias("id_seq"), "m.id", "m.name", "m.taxid")


def read_tree(spark: SparkSession, path) -> DataFrame:
    return spark.read.json(path, schema="id long, idpar long, rank string, name string")


BTAB = "id_q string, date string, len_q int, method string, name_db string, id_s string, start_q int, end_q int, start_s int, end_s int, ident double, simil double, score double, start_f_aln string, end_f_aln string, descr string, frame int, strand string, len_s int, e_val double"


def read_btab(spark: SparkSession, path) -> DataFrame:
    """Hits; percents as shares, strands as 1, -1 or 0."""
    strand = F.when(F.col("strand") == "Plus", 1).when(F.col("strand") == "Minus", -1).otherwise(0)
    return spark.read.csv(path, sep="\t", schema=BTAB).withColumns({"ident": F.col("ident") / 100, "simil": F.col("simil") / 100, "strand": strand})


def read_key_values(spark: SparkSession, path, fixed: list[str] | None = None) -> DataFrame:
    """Lines of ``fixed`` fields and then keys and values by turns, to those fields and a map."""
    fixed = fixed or []
    parts = spark.read.text(path).select(F.split("value", "\t").alias("p"))
    rest = F.slice("p", F.lit(len(fixed) + 1), F.greatest(F.size("p") - len(fixed), F.lit(0)))
    odd = lambda want: lambda x, i: i % 2 == want
    x = parts.select(*[F.get("p", F.lit(k)).alias(n) for k, n in enumerate(fixed)], rest.alias("r"))
    keys, values = F.filter("r", odd(0)), F.filter("r", odd(1))
    return x.select(*fixed, F.map_from_arrays(F.slice(keys, F.lit(1), F.size(values)), values).alias("attrib"))


def read_annotations(spark: SparkSession, path, ranks: list[str]) -> DataFrame:
    """Annotation records with a strict and a relaxed consensus by rank; numbers come as text."""
    one = ", ".join(f"{r}: string, {r}_outgroup: string" for r in ranks)
    schema = f"name string, tree string, strict_consensus struct<{one}>, relaxed_consensus struct<{one}>, strict_taxon_id string, strict_taxon string, relaxed_taxon_id string, relaxed_taxon string, bootstrap string"
    d = spark.read.json(path, schema=schema)
    wide = [F.col(f"{k}_consensus.{r}").alias(f"{k}_{r}") for k in ("strict", "relaxed") for r in ranks]
    return d.select("name", F.when(F.col("tree") != "NO_TREE", F.col("tree")).alias("tree"), *wide, F.col("strict_taxon_id").cast("long"), "strict_taxon", F.col("relaxed_taxon_id").cast("long"), "relaxed_taxon", F.col("bootstrap").cast("double"))


def read_status(spark: SparkSession, path) -> DataFrame:
    """Assembled reads: (id_read, cont1, cont2) of lines with three words or more, without the header."""
    w = F.split(F.trim("value"), r"\s+")
    d = spark.read.text(path).select(w.alias("w")).filter((F.size("w") >= 3) & (F.lower(F.col("w")[0]) != "accno"))
    return d.select(F.col("w")[0].alias("id_read"), F.col("w")[2].alias("cont1"), F.get("w", F.lit(5)).alias("cont2"))


def read_svmlight(spark: SparkSession, path) -> DataFrame:
    """(label, features: (ind, val))."""
    w = F.split(F.trim(F.regexp_replace("value", "#.*$", "")), r"\s+")
    pairs = F.transform(F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda x: F.struct(F.split(x, ":")[0].cast("int").alias("ind"), F.split(x, ":")[1].cast("double").alias("val")))
    return spark.read.text(path).select(w.alias("w")).filter(F.col("w")[0] != "").select(F.col("w")[0].cast("double").alias("label"), pairs.alias("features"))


def read_gi_list(spark: SparkSession, path, form: str = "plain") -> DataFrame:
    """GIs from plain lists, headers with bars, or tabular hits (the second column)."""
    rule = {"plain": r"^\s*(\d+)\s*$", "pipes": r"gi\|(\d+)", "m8": r"^[^\t]*\t(?:gi\|)?(\d+)"}[form]
    return spark.read.text(path).select(F.regexp_extract("value", rule, 1).alias("g")).filter("g <> ''").select(F.col("g").cast("long").alias("gi"))


def read_weights(spark: SparkSession, path) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="id string, weight double")


def read_lineage_lines(spark: SparkSession, path) -> DataFrame:
    """(id, rank, name, taxid) from lines of an id and rank=r : name=\"\"\"n\"\"\" : taxid=t items."""
    d = spark.read.text(path).select(F.split("value", "\t").alias("p")).select(F.col("p")[0].alias("id"), F.explode(F.split(F.get("p", F.lit(1)), r"\s*;\s*")).alias("item"))
    one = lambda rule: F.regexp_extract("item", rule, 1)
    return d.select("id", one(r"rank=(\S+)").alias("rank"), one('name="""(.*?)"""').alias("name"), one(r"taxid=(\d+)").cast("long").alias("taxid")).filter("rank <> ''")
