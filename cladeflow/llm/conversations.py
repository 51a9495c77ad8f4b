"""Repair of conversations whose turns are lost, empty, repeated, cut off or given the wrong role.

A repaired conversation's roles spell a word of the grammar (s?(ua)+)?: nothing, or user and assistant by
turns, after a system turn or not. The turns are aligned to the words of each feasible length, as two
strings are, within the band that the cost of a plain repair leaves; of the cheapest edit scripts the
first in the order of ASCII is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeflow.llm.common import Tables, release, within
from cladeflow.operators.common import range_bucket, running

#: Costs of a new role, of a row left out, of a row put in, and of a cut-off row that stays.
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
#: White space, and what a text may end with.
BLANKS, ENDS = b" \t\n\x0b\x0c\r", b".!?"
#: Rows up to which a conversation is aligned as a whole; longer ones in segments of so many.
LONG = 2048
#: Rows up to which one task reads a conversation from end to end.
WHOLE = 200_000
#: Conversations of more rows that are broadcast at most.
BROADCAST_ROWS = 100_000
#: Bytes that results may hold before they are handed on.
HELD = 1 << 22

_ROLE = {"u": b"user", "a": b"assistant"}
_INFINITE = 1 << 60


def _classes(codes: str) -> tuple[list[int], list[int], int]:
    """Of each row: what leaving it out costs above its least cost, and whether it can stay; the sum of least costs."""
    drop, free, base = [], [], 0
    for c in codes:
        if c == "D":
            least, more, stays = DELETE, 0, 0
        elif c.isupper():
            least, more, stays = CUT_OFF, DELETE - CUT_OFF, 1
        else:
            least, more, stays = 0, DELETE, 1
        drop.append(more)
        free.append(stays)
        base += least
    return drop, free, base


def _plain_repairs(codes: str, drop: list[int]) -> int:
    """The least cost of a few repairs made in one pass: leave all out, give all their roles in turn, or put in a
    row wherever two roles don't alternate."""
    costs = [sum(drop)]
    rows = [c.lower() for c in codes if c != "D"]
    for first in {0, int(bool(rows) and rows[0] == "s")}:
        given = put_in = length = 0
        due = "u"
        for k, c in enumerate(rows[first:]):
            given += REROLE * (c != "ua"[k % 2])
            if c not in "ua":
                put_in += REROLE
                length += 1
                due = "a" if due == "u" else "u"
            elif c == due:
                length += 1
                due = "a" if due == "u" else "u"
            else:
                put_in += INSERT
                length += 2
        if len(rows) > first:  # a system turn alone is no conversation
            costs += [given + INSERT * ((len(rows) - first) % 2), put_in + INSERT * (length % 2)]
    return min(costs)


def align(codes: str) -> tuple[int, str]:
    """The least cost of a repair and its audit: K, R, D, I for each row kept, given a role, left out, put in.

    A row is the initial of its role (s, u, a; x for others), in capitals if it is cut off, or D if it must
    go. ``cost[i][m]`` is the least cost above the rows' own least ones of turning the rows from i on
    into the last m symbols of ...uaua; as all target words share these ends, one table serves
    the targets of all lengths. Only cells are filled whose distance from the diagonal can't cost more
    than the incumbent.
    """
    n = len(codes)
    drop, free, base = _classes(codes)
    most = _plain_repairs(codes, drop)
    free_from, cut_from = [0] * (n + 1), [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        free_from[i] = free_from[i + 1] + free[i]
        cut_from[i] = cut_from[i + 1] + codes[i].isupper() * free[i]
    lows, cost = [0] * (n + 1), [[]] * (n + 1)
    for i in range(n, -1, -1):
        cheap = cut_from[i]
        fewer = most if most <= cheap else cheap + (most - cheap) // DELETE
        low, high = max(0, free_from[i] - fewer), free_from[i] + most // INSERT
        lows[i] = low
        row, last = [], _INFINITE
        if i == n:
            row = [INSERT * m for m in range(low, high + 1)]
        else:
            below, at, c, d, stays = cost[i + 1], lows[i + 1], codes[i].lower(), drop[i], free[i]
            width = len(below)
            for m in range(low, high + 1):
                k = m - at
                x = below[k] + d if 0 <= k < width else _INFINITE
                if last + INSERT < x:
                    x = last + INSERT
                if stays and 0 < k <= width:
                    y = below[k - 1] + (0 if c == ("a" if m % 2 else "u") else REROLE)
                    if y < x:
                        x = y
                row.append(x)
                last = x
        cost[i] = row

    def of(i: int, m: int) -> int:
        k = m - lows[i]
        return cost[i][k] if 0 <= k < len(cost[i]) else _INFINITE

    def lengths(i: int, least: int) -> range:
        low = max(least, lows[i] + lows[i] % 2)
        return range(low, lows[i] + len(cost[i]), 2)

    # targets without a system turn, and with one that some row is kept as
    targets = [(of(0, m), 0, "", m) for m in lengths(0, 0)]
    before = 0
    for i, c in enumerate(codes):
        if c in "sS":
            targets += [(before + of(i + 1, m), i + 1, "D" * i + "K", m) for m in lengths(i + 1, 2)]
        before += drop[i]
    best = min(x[0] for x in targets)
    audits = []
    for x, i, head, m in targets:
        if x != best:
            continue
        out = [head]
        while i < n or m:
            c = of(i, m)
            if i < n and of(i + 1, m) + drop[i] == c:
                out.append("D")
                i += 1
            elif m and of(i, m - 1) + INSERT == c:
                out.append("I")
                m -= 1
            else:
                out.append("K" if codes[i].lower() == ("a" if m % 2 else "u") else "R")
                i += 1
                m -= 1
        audits.append("".join(out))
    return base + best, min(audits)


#: What a word may end with so far: nothing, the system turn, a user's turn, an assistant's; and what may follow.
_FOLLOWS = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def _put_in(states: dict[int, tuple[int, str]]) -> dict[int, tuple[int, str]]:
    """The states after up to two rows put in; more never pay."""
    for _ in range(2):
        new = dict(states)
        for x, (c, audit) in states.items():
            for symbol, y in _FOLLOWS[x].items():
                if symbol != "s":
                    new[y] = min(new.get(y, (_INFINITE, "")), (c + INSERT, audit + "I"))
        states = new
    return states


def segment(codes: str, start: int) -> dict[int, tuple[int, str]]:
    """The cheapest (cost, audit) from the state ``start`` to each state over some rows: of two scripts of one cost for the same rows
    none begins the other, so that the lesser one stays the lesser whatever follows."""
    states = {start: (0, "")}
    for code in codes:
        states = _put_in(states)
        new: dict[int, tuple[int, str]] = {}

        def offer(y: int, c: int, audit: str, new: dict = new) -> None:
            new[y] = min(new.get(y, (_INFINITE, "")), (c, audit))

        for x, (c, audit) in states.items():
            offer(x, c + DELETE, audit + "D")
            if code == "D":
                continue
            for symbol, y in _FOLLOWS[x].items():
                extra = CUT_OFF * code.isupper()
                if symbol == code.lower():
                    offer(y, c + extra, audit + "K")
                elif symbol != "s":
                    offer(y, c + extra + REROLE, audit + "R")
        states = new
    return states


def joined(parts: list[dict[int, dict[int, tuple[int, str]]]]) -> tuple[int, str]:
    """align() from the segments of a conversation, each with its outcomes for each starting state."""
    states = {0: (0, "")}
    for part in parts:
        new: dict[int, tuple[int, str]] = {}
        for x, (c, audit) in states.items():
            for y, (more, then) in part[x].items():
                new[y] = min(new.get(y, (_INFINITE, "")), (c + more, audit + then))
        states = new
    states = _put_in(states)
    return min(states[x] for x in (0, 3) if x in states)


def align_long(codes: str) -> tuple[int, str]:
    """align() in time linear in the rows, by segments."""
    return joined([{x: segment(codes[at : at + LONG], x) for x in _FOLLOWS} for at in range(0, len(codes), LONG)])


_align_short = lru_cache(1 << 14)(align)


def repaired(codes: str) -> tuple[int, str]:
    return _align_short(codes) if len(codes) <= 32 else align(codes) if len(codes) <= LONG else align_long(codes)


class _Repaired:
    """The hash of a repaired conversation, fed with its rows in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.due, self.some, self.hash = audit, 0, "u", False, hashlib.sha256()

    def _line(self, role: bytes, text: bytes) -> None:
        self.hash.update((b"\n" if self.some else b"") + role + b":" + text)
        self.some = True
        self.due = "u" if role[:1] in (b"s", b"a") else "a"

    def put_in(self) -> None:
        """The rows that are put in here."""
        while self.audit[self.at : self.at + 1] == "I":
            self._line(_ROLE[self.due], b"")
            self.at += 1

    def row(self, role: bytes, text: bytes) -> None:
        self.put_in()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._line(_ROLE[self.due] if edit == "R" else role, text)

    def digest(self) -> str:
        self.put_in()
        return self.hash.hexdigest()


class _Conversation:
    """What one pass over the rows of a conversation gathers."""

    def __init__(self) -> None:
        self.rows: list[tuple[bytes, bytes]] = []
        self.codes: list[str] = []
        self.seen: set[bytes] = set()
        self.low = self.high = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: bytes, text: bytes) -> None:
        """The next row in the order of turns."""
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
            self.turns += 1
        if self.rows and self.rows[-1][0][:1] + role[:1] not in (b"su", b"ua", b"au"):
            self.illegal += 1
        code = role[:1].decode("ascii", "replace")
        code = code if code in ("s", "u", "a") else "x"
        key = hashlib.blake2b(len(role).to_bytes(8, "little") + role + text, digest_size=16).digest()
        body = text.strip(BLANKS)
        if not body:
            self.blank += 1
            code = "D"
        elif key in self.seen:
            self.duplicate += 1
            code = "D"
        elif body[-1:] not in (b".", b"!", b"?"):
            self.truncated += 1
            code = code.upper()
        self.seen.add(key)
        self.rows.append((role, text))
        self.codes.append(code)

    def result(self) -> tuple:
        cost, audit = repaired("".join(self.codes))
        text = _Repaired(audit)
        for row in self.rows:
            text.row(*row)
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, text.digest()


def damaged(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, there, role, text): rows with faults planted by a checksum of conversation and turn; nulls count as a
    space. Rows that are dropped stay, as not ``there``, for their conversations' sake."""
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    x = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), of(role).alias("role"), of(text).alias("text"), (F.crc32(F.concat(of(conv), F.lit(":"), of(turn))) % 20).alias("fault"))
    bare = F.when(F.col("fault").isin(0, 1), "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies: Column = F.explode(F.array_repeat(F.col("fault") != 0, F.when(F.col("fault") == 3, 2).otherwise(1)))
    return x.select("conv", "turn", copies.alias("there"), F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), bare.alias("text"))


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair(rows: DataFrame, conv: str = "conv", turn: str = "turn", role: str = "role", text: str = "text", there: str | None = "there") -> DataFrame:
    """A row for each conversation: conv, gaps in its turns, rows that are blank, duplicate or truncated (the first that
    holds), neighbours of illegal roles, and the cheapest repair: its cost, its audit and the SHA-256 of what it gives.

    Blank and duplicate rows must go; a new role costs 3, leaving a row out 4, putting an empty one in 3, and a
    truncated row that stays 3. Rows come in the order of turns, nulls first, equal ones by role and text.

    Conversations of up to ``WHOLE`` rows are dealt to tasks and sorted by Spark; a task reads one after
    another and holds one at a time. More than ``LONG`` rows are aligned in segments, in linear time. For
    those of more than ``WHOLE`` rows see repair_huge().

    Defined results: rows not ``there`` only name their conversation; a null conversation is one; null
    roles and texts are empty; no rows give zeros, no audit and the hash of nothing; an empty table stays empty;
    other columns are not read.
    """
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    x = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), of(role).alias("role"), of(text).alias("text"), (F.col(there) if there else F.lit(True)).alias("there"))
    tables = Tables(rows.sparkSession)
    huge = tables.put(x.filter("there").groupBy("conv").agg(F.count("*").alias("n")).filter(F.col("n") > WHOLE).select("conv", F.lit(True).alias("huge")))
    if huge.isEmpty():
        return _streamed(x)
    named = within(huge.withColumnRenamed("conv", "_conv"), BROADCAST_ROWS)
    marked = x.join(named, F.col("conv").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    return _streamed(marked.filter("huge IS NULL").drop("huge")).unionByName(repair_huge(marked.filter("huge AND there").drop("huge", "there"), tables))


def _in_order(x: DataFrame, by: list, names: list[str], kinds: str, start, add, result) -> DataFrame:
    """A row for each conversation from its rows in the order ``by``: a task streams through its conversations, with
    start(), add(state, row) for each row and result(state)."""
    fields = x.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now, done, held, kind = None, None, [], 0, None

        def flush() -> pa.RecordBatch:
            columns = [pa.array([d[0] for d in done], kind), *[pa.array([d[k + 1] for d in done]) for k in range(len(names))]]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, ["conv", *names])

        for batch in batches:
            kind = batch.schema.field(0).type
            columns = [c.cast(pa.binary()).to_pylist() if pa.types.is_string(c.type) and k else c.to_pylist() for k, c in enumerate(batch.columns)]
            for c, *row in zip(*columns, strict=True):
                if state is None or c != now:
                    if state is not None:
                        done.append((now, *result(state)))
                        held += sum(len(v) for v in done[-1][1:] if isinstance(v, str)) + 100
                        if held > HELD:
                            yield flush()
                            held = 0
                    state, now = start(), c
                add(state, row)
        if state is not None:
            done.append((now, *result(state)))
            yield flush()
        release()

    return x.repartition("conv").sortWithinPartitions("conv", *by).mapInArrow(run, f"conv {fields}, {kinds}")


def _streamed(x: DataFrame) -> DataFrame:
    def add(state: _Conversation, row: list) -> None:
        turn, role, text, there = row
        if there:
            state.add(turn, role, text)

    kinds = ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"
    return _in_order(x, [F.asc_nulls_first("turn"), "role", "text"], [*_COUNTS, "audit", "repaired_sha256"], kinds, _Conversation, add, _Conversation.result)


def repair_huge(x: DataFrame, tables: Tables) -> DataFrame:
    """repair() of conversations (conv, turn, role, text) that no task should read as a whole.

    Rows are numbered within ranges of turns and cut into segments of ``LONG`` rows; tasks find each segment's
    cheapest scripts between any two states of the grammar, and one task joins a conversation's few
    outcomes, which are strings of an audit's length. The hash is of one text, which a task therefore
    reads in order, but never holds. Rows of one turn are put in order by one task.
    """
    by = [F.asc_nulls_first("turn"), "role", "text"]
    x = tables.put(x)
    placed = running(x, "conv", range_bucket(x, "turn"), by, F.lit(1)).withColumnRenamed("_run", "pos").drop("_total")
    placed = tables.put(placed.withColumn("digest", F.sha2(F.col("text"), 256)))
    seen = tables.put(placed.groupBy(F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest")).agg(F.min("pos").alias("first")))
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    kind = F.when(blank, "b").when(F.col("pos") > F.col("first"), "d").when(~last.isin(".", "!", "?"), "t").otherwise("")
    initial = F.substring("role", 1, 1)
    coded = placed.join(seen, same).select("conv", "turn", "pos", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"), kind.alias("kind"))
    coded = tables.put(coded.withColumn("segment", F.floor((F.col("pos") - 1) / LONG)))

    def outcomes(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        initials, kinds = t.column("initial").to_pylist(), t.column("kind").to_pylist()
        codes = "".join("D" if k in ("b", "d") else i.upper() if k else i for i, k in zip(initials, kinds, strict=True))
        bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        found = [(a, b, c, audit) for a in _FOLLOWS for b, (c, audit) in segment(codes, a).items()]
        n = len(found)
        fixed = [t.column(c).slice(0, 1).combine_chunks().take(pa.array([0] * n)) for c in ("conv", "segment")]
        cut = [pa.array([v] * n, pa.int64()) for v in (kinds.count("b"), kinds.count("d"), kinds.count("t"), bad)]
        ends = [pa.array([v] * n) for v in (initials[0], initials[-1])]
        return pa.table([*fixed, *cut, *ends, *[pa.array([f[k] for f in found]) for k in range(4)]], [*_SEGMENT])

    key = coded.schema["conv"].dataType.simpleString()
    kinds = "segment long, blank long, duplicate long, truncated long, bad long, head string, tail string, start long, stop long, cost long, audit string"
    segments = tables.put(coded.groupBy("conv", "segment").applyInArrow(outcomes, f"conv {key}, {kinds}"))

    def whole(t: pa.Table) -> pa.Table:
        parts, about = {}, {}
        for r in t.to_batches():
            for v in r.to_pylist():
                parts.setdefault(v["segment"], {}).setdefault(v["start"], {})[v["stop"]] = (v["cost"], v["audit"])
                about[v["segment"]] = (v["blank"], v["duplicate"], v["truncated"], v["bad"], v["head"], v["tail"])
        order = sorted(parts)
        cost, audit = joined([parts[k] for k in order])
        sums = [sum(about[k][j] for k in order) for j in range(4)]
        sums[3] += sum(about[a][5] + about[b][4] not in ("su", "ua", "au") for a, b in zip(order, order[1:], strict=False))
        return pa.table([t.column("conv").slice(0, 1), *[pa.array([v]) for v in (*sums, cost, audit)]], ["conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    found = tables.put(segments.groupBy("conv").applyInArrow(whole, f"conv {key}, blank long, duplicate long, truncated long, illegal long, cost long, audit string"))
    turns = x.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"))

    # the audit comes first, then the rows in order
    lines = placed.select("conv", "pos", "role", "text").union(found.select("conv", F.lit(0).cast("long"), F.lit(""), "audit"))

    def add(state: list, row: list) -> None:
        if row[0] == 0:
            state.append(_Repaired(row[2].decode()))
        else:
            state[0].row(row[1], row[2])

    hashed = _in_order(lines, ["pos"], ["repaired_sha256"], "repaired_sha256 string", list, add, lambda state: (state[0].digest(),))
    out = found.alias("f").join(turns.alias("t"), F.col("f.conv").eqNullSafe(F.col("t.conv"))).join(hashed.alias("h"), F.col("f.conv").eqNullSafe(F.col("h.conv")))
    return out.select("f.conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


_SEGMENT = ["conv", "segment", "blank", "duplicate", "truncated", "bad", "head", "tail", "start", "stop", "cost", "audit"]
