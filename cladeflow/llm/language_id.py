"""Language identification with a string kernel.

Two texts are as alike as the character n-grams of one to three letters (a blended spectrum) that occur
in both, whatever their counts: k(x, y) = |X & Y| / sqrt(|X| |Y|) over their sets of n-grams. Landmark texts
span the kernel's space (Nyström), and a ridge regression in that space for each language, one versus
the rest, gives its score. As all of this is linear in the kernel's values at the landmarks, scoring a
batch of texts is two matrix products: presences by landmarks, and landmarks by languages.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.llm.common import release

#: N-grams are told apart by 17 bits of a hash.
BITS = 17
SLOTS = 1 << BITS
UNDETERMINED = "und"
#: Characters of a text that are turned into n-grams at once.
STEP = 1 << 20


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def grams(text: str | None, present: np.ndarray) -> bool:
    """Mark the n-grams of a text in ``present``; False if it has no letter.

    Letters are lower-cased; what lies between them, and before and after, is one blank.
    """
    letters, some = _letters(), False
    for at in range(0, len(text or ""), STEP):  # parts share two characters, so that no n-gram is lost
        part = text[max(at - 2, 0) : at + STEP].lower()
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        is_letter = letters[c]
        if not is_letter.any():
            continue
        some = True
        c = np.where(is_letter, c, 32)
        c = np.concatenate([[32] * (at == 0), c, [32] * (at + STEP >= len(text))]).astype(np.uint64)
        c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
        two = (c[:-1] << np.uint64(21)) | c[1:]
        three = (two[:-1] << np.uint64(21)) | c[2:]
        for n, x in enumerate((c, two, three)):
            h = (x + np.uint64(n + 1)) * np.uint64(0x9E3779B97F4A7C15)
            present[((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)] = True
    return some


@dataclass
class Model:
    """languages; columns: n-grams that landmarks have; landmarks: their presences in these columns;
    sizes: of the landmarks' sets; weights: landmarks (and a constant) by languages."""

    languages: list[str]
    columns: np.ndarray
    landmarks: np.ndarray
    sizes: np.ndarray
    weights: np.ndarray

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Decision values, text by language, and whether the text has a letter."""
        rows = np.zeros((len(texts), len(self.columns)), dtype=np.float32)
        size, some, present = np.ones(len(texts)), np.zeros(len(texts), dtype=bool), np.zeros(SLOTS, dtype=bool)
        for k, text in enumerate(texts):
            some[k] = grams(text, present)
            if some[k]:
                rows[k] = present[self.columns]
                size[k] = np.count_nonzero(present)
                present[:] = False
        kernel = (rows @ self.landmarks.T) / np.sqrt(size[:, None] * self.sizes[None, :])
        return np.hstack([kernel, np.ones((len(texts), 1))]) @ self.weights, some

    def predict(self, texts: list[str | None], batch: int = 128) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores (0 to 1), and whether the landmarks raise any language above what a text that
        is like none of them would get."""
        names, scores, claimed = [], [np.empty(0)], [np.empty(0, dtype=bool)]
        for at in range(0, len(texts), batch):
            values, some = self.scores(texts[at : at + batch])
            best = values.argmax(axis=1)
            names += [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, some, strict=True)]
            scores.append(np.where(some, np.clip((values.max(axis=1) + 1) / 2, 0, 1), 0.0))
            claimed.append(some & (values > self.weights[-1]).any(axis=1))
        return names, np.concatenate(scores), np.concatenate(claimed)


def fit(presence: np.ndarray, labels: list[str], landmarks: int = 160, ridge: float = 1e-3) -> Model:
    """Fit on rows of packed presence bits (text by slot), the landmarks being taken from the languages in turn."""
    languages = sorted(set(labels))
    turn: dict[str, int] = {}
    order = []
    for k, label in enumerate(labels):
        order.append((turn.get(label, 0), languages.index(label), k))
        turn[label] = turn.get(label, 0) + 1
    chosen = [k for *_, k in sorted(order)[:landmarks]]
    marks = np.unpackbits(presence[chosen], axis=1)
    columns = np.flatnonzero(marks.any(axis=0))
    marks = marks[:, columns].astype(np.float32)
    size = np.bitwise_count(presence).sum(axis=1, dtype=np.float64)
    # a few rows at a time are unpacked
    products = [np.unpackbits(presence[at : at + 64], axis=1)[:, columns].astype(np.float32) @ marks.T for at in range(0, len(labels), 64)]
    kernel = np.concatenate(products) / np.sqrt(size[:, None] * size[chosen][None, :])
    values, vectors = np.linalg.eigh(kernel[chosen])
    keep = values > values.max() * 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])  # the landmarks' kernel to the power -1/2
    root = np.block([[root, np.zeros((len(chosen), 1))], [np.zeros((1, root.shape[1])), np.ones((1, 1))]])
    x = np.hstack([kernel, np.ones((len(labels), 1))]) @ root
    y = np.array([[1.0 if label == s else -1.0 for s in languages] for label in labels])
    # languages count alike, however many texts they have
    w = np.array([1 / (len(languages) * turn[label]) for label in labels])[:, None]
    solved = np.linalg.solve(x.T @ (x * w) + ridge * np.eye(x.shape[1]), x.T @ (y * w))
    return Model(languages, columns.astype(np.int32), marks, size[chosen], root @ solved)


def train(labelled: DataFrame, sample: int = 1600, landmarks: int = 160, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model | None:
    """Fit on at most ``sample`` rows of ``labelled``, as many of each language, in the order of a hash of
    their ids; None if there are none with a label and a letter.

    The sample's texts stay on the executors; what comes to the driver is their presence bits (16 KB a
    text, however long it is). Rows of one id count once; null ids and labels are not learned from.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label")).filter("id IS NOT NULL AND label IS NOT NULL").filter(F.col("label") != UNDETERMINED)
    counts = rows.groupBy("label").agg(F.count("*").alias("n")).limit(sample + 1).collect()
    if not counts:
        return None
    if len(counts) > sample:
        raise ValueError(f"more than {sample} languages")
    each = max(1, sample // len(counts))
    # four times as many as wanted are below a language's limit, however many rows it has
    limits = [(r["label"], 2**63 - 1 if r["n"] <= 4 * each else round(-(2**63) + 2**64 * 4 * each / r["n"])) for r in counts]
    limits = F.broadcast(labelled.sparkSession.createDataFrame(limits, "label string, most long"))
    near = rows.withColumn("hash", F.xxhash64("id")).join(limits, "label").filter("hash <= most").groupBy("id", "hash").agg(F.min("label").alias("label"))
    chosen = near.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("hash", "id"))).filter(F.col("place") <= each)
    chosen = F.broadcast(chosen.select("id", "label", "place"))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(text: str | None) -> bytes | None:
            present = np.zeros(SLOTS, dtype=bool)
            some = grams(text, present)
            return np.packbits(present).tobytes() if some else None

        for x in batches:
            yield pa.RecordBatch.from_arrays([x.column("id"), x.column("label"), x.column("place"), pa.array([packed(t.as_py()) for t in x.column("text")], pa.binary())], ["id", "label", "place", "bits"])
        release()

    texts = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id").select(F.col("id").cast("long"), "label", "place", "text")
    found = texts.mapInArrow(bits, "id long, label string, place int, bits binary").filter("bits IS NOT NULL").dropDuplicates(["id"]).collect()
    found.sort(key=lambda r: (r.place, r.label, r.id))
    if not found:
        return None
    presence = np.frombuffer(b"".join(r.bits for r in found), dtype=np.uint8).reshape(len(found), -1)
    return fit(presence, [r.label for r in found], landmarks)


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1; half of 1 + the best decision value) and lang_claimed (whether
    the text is like any landmark at all).

    Defined results: a null text and one without a letter are ``und`` with score 0 and unclaimed, as is
    everything without a model; ties go to the language that sorts first; other columns and repeated
    rows stay, but columns of the three names are replaced. Nothing is shuffled.
    """
    names = ["lang_pred", "score", "lang_claimed"]
    keep = [F.col(c) for c in docs.columns if c not in names]
    if model is None:
        return docs.select(*keep, F.lit(UNDETERMINED).alias(names[0]), F.lit(0.0).alias(names[1]), F.lit(False).alias(names[2]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, lang_claimed boolean")
    def said(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [shared.value.predict(texts.slice(at, 512).to_pylist()) for at in range(0, len(texts), 512)]
            found, scores, claimed = [list(itertools.chain(*x)) for x in zip(*parts, strict=True)] if parts else ([], [], [])
            yield pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(claimed, pa.bool_())], names)
        release()

    return docs.select(*keep, said(F.col(text_col).cast("string")).alias("_said")).select(*keep, *[f"_said.{c}" for c in names])


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from learning: the CRC-32 of its id, as text, leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
