"""Near-duplicate removal by min-max hashing.

A permutation of the shingles gives two values of a document, its smallest and its largest, so that a
signature takes half the hash evaluations; both agree for two documents with the probability of their
Jaccard similarity, and as they never fail together more often than two independent values would,
the estimate varies less. Bands of the signature propose links; full sets confirm them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.llm.common import Tables, release, within
from cladeflow.llm.graph import components
from cladeflow.llm.shingles import mix, shingle_sets

#: Values in a band and bands: a pair at a similarity of 0.75 is missed by all with probability 2e-6.
ROWS, BANDS = 5, 48
PERMUTATIONS = ROWS * BANDS // 2
#: One bit of each value; two sets at 0.75 agree in 210 of 240 on average, with a deviation of 5.1.
SKETCH_WORDS = 4
LEAST_AGREEMENT = 184
#: Bands whose buckets propose first; the others then only propose across what these have joined.
FIRST_BANDS = 6
#: Ids that are broadcast at most to pick the texts to be read again.
BROADCAST_IDS = 2_000_000
#: Sets with copies that are broadcast at most, and parts in which more are joined.
BROADCAST_SETS = 100_000
SALTS = 32

_rng = np.random.default_rng(7)
_A = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_FACTOR = _rng.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 2**63, BANDS, dtype=np.uint64)


def signature(x: np.ndarray) -> np.ndarray:
    """The smallest values under all permutations, then the largest, of a set that isn't empty."""
    lo = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    hi = np.zeros(PERMUTATIONS, dtype=np.uint64)
    for at in range(0, len(x), 1024):
        y = x[at : at + 1024, None] * _A
        y += _B
        np.minimum(lo, y.min(axis=0), out=lo)
        np.maximum(hi, y.max(axis=0), out=hi)
    return np.concatenate([lo, hi])


def _bands(signatures: np.ndarray) -> np.ndarray:
    """A key for each band of each signature (a row)."""
    parts = mix(signatures).reshape(len(signatures), BANDS, ROWS) * _FACTOR
    return mix(parts.sum(axis=2, dtype=np.uint64) + _BAND)


def _sketch(signatures: np.ndarray) -> np.ndarray:
    """A bit of each value, packed."""
    bits = np.zeros((len(signatures), SKETCH_WORDS * 64), dtype=np.uint8)
    bits[:, : signatures.shape[1]] = (mix(signatures) >> np.uint64(40)) & np.uint64(1)
    return np.packbits(bits, axis=1).view(np.int64)


def _slices(batch: pa.RecordBatch, most: int = 1_000_000) -> Iterator[tuple[pa.Array, list]]:
    """Ids and texts, about ``most`` characters at a time."""
    ids, texts = batch.column(0), batch.column(1)
    start = held = 0
    out: list = []
    for k, x in enumerate(texts):
        out.append(x.as_py())
        held += len(out[-1] or "")
        if held >= most or k + 1 == len(texts):
            yield ids.slice(start, k + 1 - start), out
            start, held, out = k + 1, 0, []


def _signed(docs: DataFrame, k: int) -> DataFrame:
    """(id, text) to id, n, f1, f2 (a fingerprint of the set), s0..s3 (the sketch), bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _slices(batch):
                sets = shingle_sets(texts, k)
                n = np.array([len(x) for x in sets], dtype=np.int64)
                f1 = np.array([mix(x).sum(dtype=np.uint64) for x in sets], dtype=np.uint64)
                f2 = np.array([mix(x ^ _A[0]).sum(dtype=np.uint64) for x in sets], dtype=np.uint64)
                full = np.flatnonzero(n)
                signatures = np.array([signature(sets[i]) for i in full], dtype=np.uint64).reshape(len(full), 2 * PERMUTATIONS)
                sketch = np.zeros((len(n), SKETCH_WORDS), dtype=np.int64)
                sketch[full] = _sketch(signatures)
                offsets = np.zeros(len(n) + 1, dtype=np.int32)
                np.cumsum((n > 0) * BANDS, out=offsets[1:])
                bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(_bands(signatures).reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), *[pa.array(np.ascontiguousarray(sketch[:, j])) for j in range(SKETCH_WORDS)], bands],
                    ["id", "n", "f1", "f2", *[f"s{j}" for j in range(SKETCH_WORDS)], "bands"],
                )
        release()

    return docs.mapInArrow(sign, "id long, n long, f1 long, f2 long, " + ", ".join(f"s{j} long" for j in range(SKETCH_WORDS)) + ", bands array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, shingles) for the ids in ``nodes`` (node, each once), from their whole texts."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _slices(batch):
                sets = shingle_sets(texts, k)
                offsets = np.zeros(len(sets) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in sets], out=offsets[1:])
                flat = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["node", "shingles"])
        release()

    wanted = docs.join(within(nodes.withColumnRenamed("node", "id"), BROADCAST_IDS), "id", "left_semi")
    return wanted.mapInArrow(collect, "node long, shingles array<long>")


class _Texts:
    """Whole texts (id, text) from which sets are made anew wherever full sets decide."""

    def __init__(self, rows: DataFrame, k: int, percent: int, tables: Tables):
        self.rows, self.k, self.percent, self.tables = rows, k, percent, tables
        #: Whether an id has several rows, which then count once for each of its texts.
        self.repeated = False

    def sets(self, nodes: DataFrame) -> DataFrame:
        found = _sets(self.rows, nodes, self.k)
        return self.tables.put(found.dropDuplicates() if self.repeated else found)

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b), each once, whose full sets are similar enough, as a table.

        The node of fewer pairs is joined first, so that a star's centre is sent once to each task that compares
        its members with it, and not with every member; a node of very many pairs is a key that Spark splits.
        """
        nodes = self.tables.put(pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("pairs")))
        sets = self.sets(nodes.select("node"))
        one = pairs.join(nodes.select(F.col("node").alias("a"), F.col("pairs").alias("in_a")), "a").join(nodes.select(F.col("node").alias("b"), F.col("pairs").alias("in_b")), "b")
        first = F.when(F.col("in_a") <= F.col("in_b"), F.col("a")).otherwise(F.col("b"))
        one = one.select("a", "b", first.alias("first"), F.when(F.col("in_a") <= F.col("in_b"), F.col("b")).otherwise(F.col("a")).alias("last"))
        joined = one.join(sets.select(F.col("node").alias("first"), F.col("shingles").alias("x")), "first").join(sets.select(F.col("node").alias("last"), F.col("shingles").alias("y")), "last")
        common = F.size(F.array_intersect("x", "y"))
        out = self.tables.put(joined.filter(100 * common >= self.percent * (F.size("x") + F.size("y") - common)).select("a", "b"))
        self.tables.drop(nodes, sets)
        return out


def _alike(x: str, y: str, percent: int) -> Column:
    """Two rows with n and sketch that may be similar enough: their sizes allow it and their sketches
    agree in as many bits as all but 4e-7 of such pairs do."""
    differ = sum((F.bit_count(F.col(f"{x}.s{j}").bitwiseXOR(F.col(f"{y}.s{j}"))) for j in range(1, SKETCH_WORDS)), F.bit_count(F.col(f"{x}.s0").bitwiseXOR(F.col(f"{y}.s0"))))
    small, large = F.least(f"{x}.n", f"{y}.n"), F.greatest(f"{x}.n", f"{y}.n")
    return (100 * small >= percent * large) & (differ <= 2 * PERMUTATIONS - LEAST_AGREEMENT)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, n_shingles, component_id (the smallest id that links lead to), kept.

    Links: 100 * intersection >= ``percent`` * union of the sets of ``k``-word shingles; ``percent`` is 75
    or more, as the bands are cut for that. The steps, none of which needs a bucket or a component in
    one place:

    1. Sets with equal sizes and equal fingerprints (two sums of 64-bit hashes) are one node, named by
       its smallest id; two different sets of one size are taken for one with probability 2^-128.
    2. Each bucket of the first few bands proposes one of its nodes, drawn by a hash, to all others; full sets confirm;
       components. Then each bucket of any band that still holds several components proposes another
       node to the nodes of other components.
    3. Nodes of buckets that hold several components even so propose all pairs across components that
       share one of their rarest shingles and that sketch, sizes and places of shingles allow to be
       similar enough. Full sets confirm; components of all links.

    Every step's result is a table in the shared folder, deleted when the steps that read it are done.

    Defined results: null, empty and wordless texts have no shingles, link with nothing and are kept;
    rows of one id are one document for links; a null id has a null component and is kept; an empty
    table stays empty; other columns are not read.
    """
    tables = Tables(docs.sparkSession)
    texts = _Texts(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), k, percent, tables)
    sketch = [f"s{j}" for j in range(SKETCH_WORDS)]
    signed = tables.put(_signed(texts.rows, k))
    key = ["n", "f1", "f2"]
    multi = tables.put(signed.filter("n > 0 AND id IS NOT NULL").groupBy(*key).agg(F.min("id").alias("node"), F.count("*").alias("held")).filter("held > 1").drop("held"))
    whole = _named(signed, multi, key)
    ids = tables.put(whole.select("id", "n", "node"))
    own = whole.filter("id = node")
    about = tables.put(own.select("node", "n", *sketch).distinct())
    heads = own.select("node", "bands")
    texts.repeated = ids.filter("id = node").count() > about.count()
    heads = tables.put(heads.dropDuplicates() if texts.repeated else heads)
    tables.drop(signed, multi)

    # the first bands: every node is its own component
    first = heads.select("node", F.explode(F.slice("bands", 1, FIRST_BANDS)).alias("band"))
    # min() of an exclusive or with the band's hash draws a node without sorting
    drawn = first.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.min(F.col("node").bitwiseXOR(F.xxhash64("band"))).alias("drawn"))
    pivots = tables.put(drawn.filter("low < high").select("band", F.col("drawn").bitwiseXOR(F.xxhash64("band")).alias("pivot")))
    stars = first.join(pivots, "band").filter("node <> pivot").select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct()
    tested = tables.put(_may_be(stars, about, percent))
    tables.drop(pivots)
    links = texts.confirmed(tested)
    of = tables.put(components(links, tables))

    # all bands: buckets that hold several components, each with a node drawn by a hash
    placed = _placed(heads, of).select("node", "component", F.explode("bands").alias("band"))
    members = _open(placed, tables)
    drawn = F.min_by(F.struct("node", "component"), F.xxhash64("node", "band"))
    pivots = tables.put(members.groupBy("band").agg(drawn.alias("pivot")))
    stars = members.join(pivots, "band").filter("component <> pivot.component")
    stars = stars.select(F.greatest("node", "pivot.node").alias("a"), F.least("node", "pivot.node").alias("b")).distinct()
    stars = tables.put(_may_be(stars.join(tested, ["a", "b"], "left_anti"), about, percent))
    tables.drop(heads, pivots)
    found = texts.confirmed(stars)
    links = tables.put(links.union(found))
    after = tables.put(components(links, tables))

    # what the stars left apart
    still = _open(_placed(members.drop("component"), after), tables)
    apart = tables.put(still.select("node", "component").distinct().join(about, "node"))
    tables.drop(of, members, still)
    if not apart.isEmpty():
        pairs = _by_rare_shingles(apart, texts).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        pairs = tables.put(pairs.join(tested.union(stars), ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            after = tables.put(components(links.union(texts.confirmed(pairs)), tables))
        tables.drop(pairs)
    tables.drop(about, tested, stars, links, apart)

    where = _placed(ids, after).filter("id IS NOT NULL").groupBy("id").agg(F.min("component").alias("component_id"))
    out = ids.select("id", "n").join(where, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _named(signed: DataFrame, multi: DataFrame, key: list[str]) -> DataFrame:
    """``signed`` with the node of each row: the smallest id of its exact copies, null without shingles or id.

    ``multi`` has the sets of several rows. Few are broadcast; many are joined in salted parts, so that
    the copies of one text don't meet in one task.
    """
    if multi.count() <= BROADCAST_SETS:
        rows, by = F.broadcast(multi), key
    else:
        rows, by = multi.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*key, "salt"]
        signed = signed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    out = signed.join(rows, by, "left")
    return out.withColumn("node", F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.coalesce("node", "id"))))


def _open(placed: DataFrame, tables: Tables) -> DataFrame:
    """The rows (node, component, band) of buckets that hold several components, as a table."""
    sums = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    bands = tables.put(sums.filter("low < high").select("band"))
    out = tables.put(placed.select("node", "component", "band").join(bands, "band", "left_semi"))
    tables.drop(bands)
    return out


def _placed(rows: DataFrame, of: DataFrame) -> DataFrame:
    """Rows of nodes with their components so far; a node that no link has reached is its own."""
    return rows.join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _may_be(pairs: DataFrame, about: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow the similarity."""
    x = pairs.join(about.select(F.col("node").alias("a"), F.struct(*about.columns[1:]).alias("x")), "a")
    return x.join(about.select(F.col("node").alias("b"), F.struct(*about.columns[1:]).alias("y")), "b").filter(_alike("x", "y", percent)).select("a", "b")


def _by_rare_shingles(apart: DataFrame, texts: _Texts) -> DataFrame:
    """Pairs (a, b) across components in ``apart`` that may be similar enough and share a rare shingle.

    All sets are put in one order, the rarest shingles first. Two sets of the wanted similarity share a
    shingle among their first n - ceil(0.75 n) + 1; and where the first that they share stands at the
    places p and q, they share at most 1 + min(n - p, m - q) in all. Both hold for any order.
    """
    sets, percent = texts.sets(apart.select("node").distinct()), texts.percent
    rows = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    often = rows.groupBy("shingle").agg(F.count("*").alias("often")).filter("often > 1")
    shared = rows.join(often, "shingle")
    order = Window.partitionBy("node").orderBy("often", "shingle")
    # a node's shingles that no other has come first and propose nothing
    alone = F.col("n") - F.count("*").over(Window.partitionBy("node"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    head = shared.withColumn("at", alone + F.row_number().over(order)).filter(F.col("at") <= prefix).select("node", "shingle", "at").join(apart, "node")
    # sizes of the wanted similarity lie in one band or in neighbouring ones (bands are a little wider than the
    # ratio), so that a shingle is a key for each
    band = F.floor(F.log("n") / (1.01 * math.log(100 / percent) if percent < 100 else 1e-9))
    x, y = head.withColumn("band", F.explode(F.array(band - 1, band, band + 1))).alias("x"), head.withColumn("band", band).alias("y")
    common = 1 + F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    may = (100 + percent) * common >= percent * (F.col("x.n") + F.col("y.n"))
    on = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.component") < F.col("y.component")) & may & _alike("x", "y", percent)
    return x.join(y, on).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
