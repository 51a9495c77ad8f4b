"""Near-duplicates by fingerprints (SimHash) that differ in a few bits.

A bit of a text's fingerprint is what more than half of its shingles' hashes have there. Fingerprints
that differ in ``bits`` bits or fewer agree in all but ``bits`` of the blocks that they are split into, so
that joins on the other blocks find all of them, and only they are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.llm.common import Tables, release, within
from cladeflow.llm.graph import components

#: Seed of the shingles' hashes.
SEED = 42
#: Shingles that are hashed at once.
STEP = 1 << 16
#: Fingerprints of one bucket that are compared with each other; larger buckets are split by more blocks, down to
#: four free places, which hold 16 fingerprints: the number must not be less.
LIMIT = 64
#: Fingerprints of several rows that are broadcast at most, and parts in which more are joined.
BROADCAST_ROWS = 100_000
SALTS = 32

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, k: int = 3) -> int:
    """64 bits, each one if more than half of the hashes of the text's shingles have it; zero without words."""
    words = text.translate(_LOWER).split()
    if len(words) <= k:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
    n, ones = len(words) - k + 1, np.zeros(64, dtype=np.int64)
    for at in range(0, n, STEP):
        part = words[at : at + STEP + k - 1]
        runs = zip(*[part[j:] for j in range(k)], strict=False)
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in runs], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int) -> DataFrame:
    """(id, text) to (id, print); null texts are empty."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint((x.as_py() or "").encode("utf-8", "surrogatepass"), k) for x in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "print"])
        release()

    return docs.mapInArrow(signed, "id long, print long")


def block_masks(free: list[int], bits: int) -> list[tuple[int, list[int]]]:
    """The ways to leave out ``bits`` of the bits + 2 blocks of the ``free`` bit places: what the other two blocks
    mask, and the places that stay free. Two numbers that differ in at most ``bits`` places agree under
    one of the masks at least."""
    blocks = np.array_split(np.array(free), bits + 2)
    out = []
    for pair in combinations(range(bits + 2), 2):
        kept = {int(x) for b in pair for x in blocks[b]}
        out.append((sum(1 << x for x in kept), [x for x in free if x not in kept]))
    return out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def close_pairs(prints: DataFrame, bits: int, tables: Tables) -> DataFrame:
    """(a, b): the nodes of each two fingerprints (print, node; each print once) that differ in 1 to ``bits`` bits, as
    a table; a pair may come several times.

    Buckets are all fingerprints that agree in two blocks. One of more than ``LIMIT`` fingerprints isn't
    compared: its members are split again, by blocks of the places that its blocks leave free, until
    none is larger, as few free places leave room for few fingerprints.
    """
    level = [(0, list(range(64)))]
    rows = prints.select("print", "node", F.lit(0).alias("way"))
    found = None
    while True:
        ways = len(block_masks(level[0][1], bits))
        level = [(mask | m, free) for mask, rest in level for m, free in block_masks(rest, bits)]
        masks = F.array(*[F.lit(_signed(m)) for m, _ in level])
        step = F.explode(F.sequence(F.col("way") * ways, F.col("way") * ways + ways - 1)).alias("way")
        placed = rows.select("print", "node", step).withColumn("bucket", F.col("print").bitwiseAND(F.get(masks, F.col("way"))))
        held = placed.groupBy("way", "bucket").agg(F.count("*").alias("held")).filter("held > 1")
        shared = tables.put(placed.join(tables.put(held), ["way", "bucket"]))
        few = shared.filter(F.col("held") <= LIMIT)
        x, y = few.alias("x"), few.alias("y")
        near = F.bit_count(F.col("x.print").bitwiseXOR(F.col("y.print"))) <= bits
        on = (F.col("x.way") == F.col("y.way")) & (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.print") < F.col("y.print")) & near
        pairs = tables.put(x.join(y, on).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
        found = pairs if found is None else found.union(pairs)
        rows = shared.filter(F.col("held") > LIMIT).select("print", "node", "way")
        if rows.isEmpty():
            return found


def near_duplicates(docs: DataFrame, k: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, fingerprint (16 hexadecimal digits), component_id (the smallest id that links lead to).

    Fingerprints are those of XXH64 hashes of the runs of ``k`` words (of all words, if there are fewer), A-Z in
    small letters, repeats included; they link where they differ in ``bits`` bits or fewer. Each
    different fingerprint is one node, named by its smallest id, so that copies never form pairs; its
    component is then looked up by every row, in salted parts where there are too many to broadcast.

    Defined results: null, empty and wordless texts have the fingerprint zero and link as any other; rows
    of one id are one document for links; a null id links nothing and has a null component; an empty
    table stays empty; other columns are not read.
    """
    tables = Tables(docs.sparkSession)
    rows = tables.put(fingerprints(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), k))
    named = rows.filter("id IS NOT NULL")
    nodes = tables.put(named.groupBy("print").agg(F.min("id").alias("node"), F.count("*").alias("held")))
    links = close_pairs(nodes.select("print", "node"), bits, tables)
    # an id with several fingerprints links them
    several = named.groupBy("id").agg(F.min("print").alias("low"), F.max("print").alias("high")).filter("low <> high").select("id")
    links = links.union(named.join(several, "id").distinct().join(nodes, "print").select(F.col("id").alias("a"), F.col("node").alias("b")))
    of = components(links, tables)
    placed = nodes.join(of, "node", "left").withColumn("component_id", F.coalesce("component", "node"))
    placed = tables.put(placed.filter("held > 1 OR component_id <> node").select("print", "component_id"))
    if placed.count() <= BROADCAST_ROWS:
        out = rows.join(within(placed, BROADCAST_ROWS), "print", "left")
    else:
        parts = placed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(parts, ["print", "salt"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), component.alias("component_id"))
