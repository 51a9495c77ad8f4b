"""Mixture-controlled packing of documents into fixed windows of tokens.

Every source is a queue of tokens. Deficit round-robin serves the queues in proportion to their
weights; the part of a token that a window owes a source is carried to the next window, and so on
over all windows. Here that schedule is written as a closed form instead of a loop: token ``n`` of a
source of weight ``w`` is due at the virtual time ``(2n + 1) / w``, and tokens are served in the order
of (time, source). The number of tokens that each source has been served before a window follows
from the window's number alone, so that every task cuts its own documents without hearing from
others: deficits are carried over partitions because they are a function of the position in the
queue. A queue that runs dry leaves its share to the others.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.llm.common import cut, release, within

#: More queues than this are refused: the work for each edge of a window grows with their number.
MAX_SOURCES = 4096
#: Numbers (window edges by sources) that are held at once.
CELLS = 500_000


class Schedule:
    """Tokens that each source has been served at the start of every window."""

    def __init__(self, totals: list[int], weights: list[float], window: int):
        self.t = np.array(totals, dtype=np.int64)
        self.w = np.array(weights, dtype=np.float64)
        self.window = window
        self.n = int(self.t.sum())
        ends = self.t / self.w  # when each queue runs dry
        order = np.unique(np.concatenate([[0.0], ends]))
        self.time = order
        by_end = np.argsort(ends, kind="stable")
        dry, left = np.concatenate([[0.0], np.cumsum(self.t[by_end])]), np.concatenate([np.cumsum(self.w[by_end][::-1])[::-1], [0.0]])
        ended = np.searchsorted(ends[by_end], order, side="right")
        self.sum = dry[ended] + order * left[ended]

    def served(self, k: np.ndarray) -> np.ndarray:
        """A row for each window number in ``k``: tokens of each source in the windows before."""
        rank = np.minimum(k.astype(np.int64) * self.window, self.n)
        v = np.interp(rank.astype(np.float64), self.sum, self.time)
        c = np.minimum(self.t[None, :], np.floor(v[:, None] * self.w[None, :] + 0.5).astype(np.int64))
        excess = c.sum(axis=1) - rank
        while (rows := np.flatnonzero(excess)).size:
            x, e = c[rows], excess[rows]
            more = e > 0
            if more.any():  # the token served last goes back
                last = np.where(x[more] > 0, (2 * x[more] - 1) / self.w, -1.0)
                j = last.shape[1] - 1 - np.argmax(last[:, ::-1], axis=1)
                c[rows[more], j] -= 1
                excess[rows[more]] -= 1
            if (~more).any():  # the next token is served too
                following = np.where(x[~more] < self.t, (2 * x[~more] + 1) / self.w, np.inf)
                j = np.argmin(following, axis=1)
                c[rows[~more], j] += 1
                excess[rows[~more]] += 1
        while True:  # rounding may have let a later token pass an earlier one
            last = np.where(c > 0, (2 * c - 1) / self.w, -1.0)
            following = np.where(c < self.t, (2 * c + 1) / self.w, np.inf)
            i = last.shape[1] - 1 - np.argmax(last[:, ::-1], axis=1)
            j = np.argmin(following, axis=1)
            at = np.arange(len(c))
            a, b = last[at, i], following[at, j]
            wrong = np.flatnonzero((a > b) | ((a == b) & (i > j)))
            if not wrong.size:
                return c
            c[wrong, i[wrong]] -= 1
            c[wrong, j[wrong]] += 1

    def near(self, source: np.ndarray, n: np.ndarray) -> np.ndarray:
        """About the window that token ``n`` of ``source`` is in; off by ``slack`` at most."""
        v = (n + 0.5) / self.w[source]
        return (np.interp(v, self.time, self.sum) // self.window).astype(np.int64)

    @property
    def slack(self) -> int:
        return 1 + len(self.t) // self.window

    def pieces(self, source: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cut documents, each ``n`` tokens of the queue of ``source`` from ``start`` on.

        Returns arrays: document's index, first token in the document, length, window, offset there.
        """
        lo = np.maximum(self.near(source, start) - self.slack, 0)
        hi = self.near(source, start + n - 1) + self.slack
        k = hi - lo + 2  # the edges of the windows lo to hi
        doc = np.repeat(np.arange(len(n)), k)
        edge = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k) + lo[doc]
        step = max(CELLS // len(self.t), 16)
        parts = [self._between(source, start, n, doc[i : i + step + 1], edge[i : i + step + 1]) for i in range(0, max(len(doc) - 1, 1), step)]
        out = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        if int(out[2].sum()) != int(n.sum()):
            raise RuntimeError("the windows do not cover the documents")
        return out

    def _between(self, source: np.ndarray, start: np.ndarray, n: np.ndarray, doc: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, ...]:
        """The pieces between edges that follow one another and are of one document."""
        served = self.served(edge)
        here = doc[:-1] == doc[1:]
        doc, win, before, after = doc[:-1][here], edge[:-1][here], served[:-1][here], served[1:][here]
        at, s = np.arange(len(doc)), source[doc]
        ahead = np.cumsum(after - before, axis=1)
        mine, end = before[at, s], after[at, s]
        a, b = np.maximum(mine, start[doc]), np.minimum(end, start[doc] + n[doc])
        ok = b > a
        offset = ahead[at, s] - (end - mine) + (a - mine)
        return doc[ok], (a - start[doc])[ok], (b - a)[ok], win[ok], offset[ok]


@functools.lru_cache(maxsize=2)
def _encoder(ranks: str, pattern: str, added: tuple[tuple[str, int], ...], keep: int):
    """A function from a text to the bytes of its ids (little-endian, 16 bits if they suffice), their type,
    and a function that forgets the words met so far."""
    import base64
    import re

    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
    kind = "<u2" if max([*table.values(), *(i for _, i in added)]) < 65536 else "<u4"
    special = {x: np.array([i], dtype=kind).tobytes() for x, i in added}
    apart = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")").split if added else None

    class Words(dict):
        """Ids of a space and a word; what doesn't fit is worked out again."""

        def __missing__(self, word: str) -> bytes:
            ids = np.array(encode(" " + word), dtype=kind).tobytes()
            if len(self) >= keep:
                self.clear()
            self[word] = ids
            return ids

    words = Words()
    # a single space between other characters always begins a new pre-token
    unlike = re.compile(r" \s| \Z").search

    def ids(text: str) -> bytes:
        """Each added token of a text is its id; what lies between them is encoded for itself."""
        if apart and any(x in text for x in special):
            return b"".join(special[x] if x in special else plain(x) for x in apart(text) if x)
        return plain(text)

    def plain(text: str) -> bytes:
        if unlike(text):
            return np.array(encode(text), dtype=kind).tobytes()
        first, *others = text.split(" ")
        return np.array(encode(first), dtype=kind).tobytes() + b"".join(map(words.__getitem__, others))

    return ids, kind, words.clear


def pack(
    docs: DataFrame,
    ranks: str,
    pattern: str,
    window: int = 1024,
    weights: dict[str | None, float] | None = None,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    word_cache: int = 600_000,
    added: dict[str, int] | None = None,
) -> DataFrame:
    """Pack all tokens of ``docs`` into windows that hold the sources in target proportions.

    ``ranks`` is a public rank file of a byte-level vocabulary, ``pattern`` its pre-token pattern and
    ``added`` the ids of the strings that its tokenizer takes out of a text before anything else;
    ``weights`` gives the sources' target proportions (default: their share of all tokens, so that
    all queues run dry together; a source without a weight has the weight 1). Each text is followed
    by ``end_id``. A queue holds its documents in the order in which Spark reads them, so that another
    split of the input into tasks gives another packing, equally whole.

    Returns a row per piece: id, source, start (its document's tokens before it), length, doc_tokens,
    sequence_id, offset (in the sequence, gapless from 0), ids (32-bit little-endian). All sequences
    hold ``window`` tokens but the last, which is the only one to be padded.

    Defined results: a null or empty text is ``end_id`` alone; a null source is a queue of its own; ids
    may be null or repeat (each row is a document); an empty table has no pieces; other columns are
    not read. More than ``MAX_SOURCES`` sources raise ``ValueError``. The tokens are written once, as a
    checkpoint; the documents are never shuffled.
    """
    special = tuple(sorted((added or {}).items()))
    columns = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, kind, forget = _encoder(ranks, pattern, special, word_cache)
        end, width = np.array([end_id], dtype=kind).tobytes(), np.dtype(kind).itemsize
        chunk, so_far = TaskContext.get().partitionId(), {}
        for batch in batches:
            a, b, c, rows = [], [], [], 0
            doc, source = batch.column("id"), batch.column("source").to_pylist()
            for k, text in enumerate(batch.column("text")):
                x = ids(text.as_py() or "") + end
                at = so_far.get(source[k], 0)
                so_far[source[k]] = at + len(x) // width
                a.append(at)
                b.append(len(x) // width)
                c.append(x)
                rows += len(x)
                if rows >= 1_000_000 or k + 1 == len(source):
                    span = slice(k + 1 - len(a), k + 1)
                    yield pa.RecordBatch.from_arrays(
                        [doc.slice(span.start, len(a)), pa.array(source[span], pa.string()), pa.array([chunk] * len(a), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary())],
                        ["id", "source", "chunk", "at", "n", "ids"],
                    )
                    a, b, c, rows = [], [], [], 0
        forget()  # else the worker would hold the words while it runs other stages
        release()

    tokens = cut(columns.mapInArrow(tokenize, "id long, source string, chunk int, at long, n long, ids binary"))
    sums = cut(tokens.groupBy("chunk", "source").agg(F.sum("n").alias("n")))
    totals = sums.groupBy("source").agg(F.sum("n").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals = sorted(totals, key=lambda r: (r.source is None, (r.source or "").encode()))
    names = {r.source: k for k, r in enumerate(totals)}
    shares = [float(r.n if weights is None else weights.get(r.source, 1)) for r in totals]
    if any(not x > 0 for x in shares):
        raise ValueError("weights must be positive")
    plan = Schedule([r.n for r in totals], shares, window) if totals else None
    kind = "<u2" if _ids_fit(ranks) and all(i < 65536 for _, i in special) else "<u4"

    before = sums.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = within(before.select(F.col("chunk").alias("of_chunk"), F.col("source").alias("of_source"), "base"), 200_000)
    placed = tokens.join(before, (F.col("chunk") == F.col("of_chunk")) & F.col("source").eqNullSafe(F.col("of_source"))).select("id", "source", (F.col("base") + F.col("at")).alias("start"), "n", "ids")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # about 20,000 pieces at a time
            n = batch.column("n").to_numpy()
            expected = np.cumsum(n * min(len(names), window) // window + 4)
            edges = np.searchsorted(expected, np.arange(0, expected[-1] if len(n) else 0, 20_000))
            for lo, hi in zip(edges, [*edges[1:], len(n)], strict=True):
                if hi > lo:
                    yield pieces(batch.slice(lo, hi - lo))
        release()

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        source, n = batch.column("source"), batch.column("n").to_numpy()
        doc, start, length, win, offset = plan.pieces(np.array([names[x] for x in source.to_pylist()]), batch.column("start").to_numpy(), n)
        ids = np.concatenate([np.frombuffer(x.as_buffer(), dtype=kind) for x in batch.column("ids")]).astype("<u4")
        # a document's pieces are in order and leave nothing out, so all pieces lie one after another
        ends = np.zeros(len(doc) + 1, dtype=np.int64)
        np.cumsum(length * 4, out=ends[1:])
        blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(ends), pa.py_buffer(ids)]).cast(pa.binary())
        take = pa.array(doc)
        return pa.RecordBatch.from_arrays(
            [batch.column("id").take(take), source.take(take), pa.array(start), pa.array(length), pa.array(n[doc]), pa.array(win), pa.array(offset), blob],
            ["id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
        )

    out = placed.mapInArrow(cut_up, "id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), *out.columns[2:])


@functools.lru_cache(maxsize=4)
def _ids_fit(ranks: str) -> bool:
    with open(ranks, "rb") as lines:
        return max(int(x.split()[1]) for x in lines if x.strip()) < 65536


def sequences(pieces: DataFrame, window: int = 1024, pad_id: int = 0) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids (32-bit, padded to ``window``).

    A group has ``window`` tokens at most, however many pieces they come from.
    """
    parts: Column = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    # binary parts are joined and padded in hexadecimal, a form that array_join and rpad take
    joined = F.array_join(F.transform(parts, lambda p: F.hex(p["ids"])), "")
    padded = F.unhex(F.rpad(joined, window * 8, pad_id.to_bytes(4, "little").hex().upper()))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), padded.alias("ids"))
