"""Repair of conversations: cheapest edits by shortest paths with a bucket queue.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles.  Its rows
and the states of that pattern (0 start, 1 after s, 2 after u, 3 after a) span a
layered graph: Keep, Rerole and Delete go on to the next row, Insert stays at one.
All costs are small integers, so distances to the end come from Dial's queue: one
bucket for each distance, emptied in order.  The audit is a walk from the start
along tight arcs (cost plus distance left equals distance), the ASCII-least label
first; a state allows one role to insert or give, so labels decide the path.

Rows are dealt by ranges of (conversation, turn, ...) and sorted by Spark; a run of
one conversation in a partition is cut into *segments* of bounded rows and bytes,
and everything after works on segments.  A conversation that lies whole within one
segment is solved at once.  One over several segments, however many rows it has, is
solved by the same queue: a segment gives its 4 x 4 distances, these are combined
from the end of the conversation (a few numbers a segment), then each segment
gives where it ends from each state, and these are chained from the start.  Only the
hash of all repaired text has to read a conversation's segments one after the other,
and it holds one segment at a time.

Edge cases: null conv_id, turn, role or text is one space in the damage key and in
what follows, while a null conv_id is a conversation of its own and a null turn comes
first; rows of one turn come in order of role and a hash of the text, equal ones as
read, and a repeated row stands next to its original; an empty role has no initial
and is reroled or deleted; texts of any length are whole; extra columns are ignored;
a conversation without rows after damage has zeros and empty repairs; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import materialize, short_batches, shuffle_partitions

#: What ``[^\x20\x09-\x0D]`` leaves out.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
INITIALS = "?sua"
#: From a state: the state after the role that a rerole or an insert gives, and that role.
NEXT, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
REROLE, DELETE, INSERT, BROKEN = 1, 2, 5, 5
FAR = 1 << 60
#: Distances left at the end of a conversation, by inserts alone.
LEFT = (0, 2 * INSERT, INSERT, 0)
LEGAL = ("su", "ua", "au")
SEGMENT_ROWS, SEGMENT_BYTES = 20_000, 4 << 20

SEGMENT = "conv_id long, part long, seq long, open boolean, codes binary, turns array<long>, roles array<string>, texts array<string>, far array<long>"


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage, by the checksum of ``conv_id:turn``, with their order in a conversation."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"),
        F.pmod(F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")), F.lit(20)).alias("kind"), F.monotonically_increasing_id().alias("row"),
    ).where("kind <> 0")
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.col("role").alias("by_role"), F.xxhash64("text").alias("by_text"), "row", F.explode(copies).alias("copy"),
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
    )


ORDER = ("conv_id", "turn", "by_role", "by_text", "row", "copy")


def faulty(rows: DataFrame) -> DataFrame:
    """``code`` of each row: four times its first fault, plus its initial."""
    place = F.struct(*[F.col(c) for c in ORDER[1:]])
    keyed = rows.withColumn("key", F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.length("role"), "role", "text"), 256))
    firsts = keyed.groupBy("key").agg(F.min(place).alias("earliest"), F.count("*").alias("times")).where("times > 1").drop("times")
    joined = keyed.join(firsts, "key", "left")
    shown = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = (
        F.when(shown == "", BLANK).when(F.col("earliest").isNotNull() & ~place.eqNullSafe(F.col("earliest")), DUPLICATE)
        .when(F.right(shown, F.lit(1)).isin(".", "!", "?"), NONE).otherwise(TRUNCATED)
    )
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(0)
    return joined.select(*ORDER, "role", "text", (fault * 4 + initial).alias("code"))


def steps(code: int, state: int) -> Iterator[tuple[str, int, int]]:
    """Label, cost and next state of the arcs over a row, in ASCII order of the labels but for Insert."""
    yield "D", DELETE, state
    fault, initial = divmod(code, 4)
    if fault in (NONE, TRUNCATED):
        extra = BROKEN * (fault == TRUNCATED)
        if (initial == 1 and state == 0) or (initial > 1 and initial == NEXT[state]):
            yield "K", extra, initial
        yield "R", REROLE + extra, NEXT[state]


ARCS = [[list(steps(code, state)) for state in range(4)] for code in range(16)]
#: The same with inserts, the least label first.
LABELLED = [[sorted([*ARCS[code][q], ("I", INSERT, NEXT[q])]) for q in range(4)] for code in range(16)]
#: Backwards: by code and state after the row, the states before it and costs; the same for inserts.
BACK = [[[(q, cost) for q in range(4) for _, cost, to in ARCS[code][q] if to == state] for state in range(4)] for code in range(16)]
INTO = [[q for q in range(4) if NEXT[q] == state] for state in range(4)]


def distances(codes: bytes, after: Sequence[int]) -> list[int]:
    """Distance to the end from each node (4 x row + state), given those from the states after the last row."""
    n, least = len(codes), min(after)
    far = [FAR] * (4 * n + 4)
    buckets: dict[int, list[int]] = {}
    for state, d in enumerate(after):
        if d < FAR:
            far[4 * n + state] = d
            buckets.setdefault(d, []).append(4 * n + state)
    d = least
    while buckets:
        for node in buckets.pop(d, ()):
            if far[node] != d:
                continue
            row, state = node >> 2, node & 3
            found = [(4 * row + q, d + INSERT) for q in INTO[state]] if row < n else []
            if row:
                found += [(4 * row - 4 + q, d + cost) for q, cost in BACK[codes[row - 1]][state]]
            for to, total in found:
                if total < far[to]:
                    far[to] = total
                    buckets.setdefault(total, []).append(to)
        # a cost of zero fills the bucket that has just been emptied
        if d not in buckets:
            d += 1
    return far


def walk(codes: bytes, far: list[int], state: int, last: bool) -> tuple[str, int]:
    """The least audit from a state before the first row, and the state after the last one."""
    out, row, n = [], 0, len(codes)
    while row < n:
        left = far[4 * row + state]
        for label, cost, to in LABELLED[codes[row]][state]:
            ahead = 4 * row + to if label == "I" else 4 * row + 4 + to
            if far[ahead] + cost == left:
                out.append(label)
                state, row = to, row + (label != "I")
                break
    while last and LEFT[state]:
        out.append("I")
        state = NEXT[state]
    return "".join(out), state


def edited(audit: str, state: int, roles: Sequence[str], texts: Sequence[str]) -> Iterator[tuple[str, str | None, str | None]]:
    """Each edit with the role and text it leaves (none for a deletion)."""
    row = 0
    for label in audit:
        if label == "D":
            yield label, None, None
        elif label == "K":
            yield label, roles[row], texts[row]
            state = INITIALS.index(roles[row][0])
        else:
            yield label, ROLE[state], "" if label == "I" else texts[row]
            state = NEXT[state]
        row += label != "I"


def _segment_batches(batches: Iterator[pa.RecordBatch], most_rows: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    part, seq, run = TaskContext.get().partitionId(), 0, 0
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), ("open", pa.bool_()), ("codes", pa.binary()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("far", pa.list_(pa.int64()))])
    done: list[tuple] = []
    conv, split, size = None, False, 0
    turns, roles, texts, codes = [], [], [], bytearray()

    def close(is_open: bool) -> None:
        nonlocal seq, size, turns, roles, texts, codes
        far = [v for e in range(4) for v in distances(codes, [FAR] * e + [0] + [FAR] * (3 - e))[:4]] if is_open else None
        done.append((conv, part, seq, is_open, bytes(codes), turns, roles, texts, far))
        seq, size, turns, roles, texts, codes = seq + 1, 0, [], [], [], bytearray()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
        done.clear()
        return out

    held = 0
    for batch in batches:
        for i, turn, role, text, code in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "code")], strict=True):
            if codes and i != conv:
                close(split or run == 0)
                run, split = run + 1, False
            elif codes and (len(codes) >= most_rows or size >= most_bytes):
                split = True
                close(True)
            conv = i
            turns.append(turn)
            roles.append(role)
            texts.append(text)
            codes.append(code)
            size += len(text)
            held += len(text)
            if done and (held >= most_bytes or len(done) >= 1000):
                yield flush()
                held = 0
    if codes:
        close(True)
    if done:
        yield flush()


def segments(conversations: DataFrame, most_rows: int = SEGMENT_ROWS, most_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Segments of the damaged conversations, written once; ``open`` ones may have others of their conversation beside them."""
    spark = conversations.sparkSession
    short_batches(spark)
    rows = faulty(damaged(conversations))
    key = [F.col(c).asc_nulls_first() for c in ORDER]
    rows = rows.repartitionByRange(shuffle_partitions(spark), *key).sortWithinPartitions(*key).select("conv_id", "turn", "role", "text", "code")
    return materialize(rows.mapInArrow(lambda it: _segment_batches(it, most_rows, most_bytes), SEGMENT), "segments")


def _after(own: pd.DataFrame) -> pd.DataFrame:
    """Distances left behind each segment of one conversation, from its last one backwards."""
    own = own.sort_values(["part", "seq"], ignore_index=True)
    after, out = list(LEFT), []
    for far in reversed(own["far"].tolist()):
        out.append(after)
        after = [min(FAR, *(far[4 * e + q] + out[-1][e] for e in range(4))) for q in range(4)]
    return own[["conv_id", "part", "seq"]].assign(after=out[::-1], last=[k == len(own) - 1 for k in range(len(own))])


def _exit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        exits = [[walk(c, far, q, False)[1] if far[q] < FAR else q for q in range(4)] for c, far in ((c, distances(c, a)) for c, a in zip(rows["codes"], rows["after"], strict=True))]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("conv_id", "part", "seq", "after", "last")], pa.array(exits, pa.list_(pa.int64()))], ["conv_id", "part", "seq", "after", "last", "exits"])


def _entries(own: pd.DataFrame) -> pd.DataFrame:
    """The state in which each segment of one conversation begins, from its first one on."""
    own = own.sort_values(["part", "seq"], ignore_index=True)
    state, out = 0, []
    for exits in own["exits"].tolist():
        out.append(state)
        state = int(exits[state])
    return own[["part", "seq", "after", "last"]].assign(entry=out)


def _solve_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, audits, costs = batch.select(["codes", "after", "last", "entry"]).to_pydict(), [], []
        for codes, after, last, entry in zip(*rows.values(), strict=True):
            after, last, entry = (LEFT, True, 0) if after is None else (after, last, entry)
            far = distances(codes, after)
            audit, state = walk(codes, far, entry, last)
            audits.append(audit)
            costs.append(far[entry] - (0 if last else after[state]))
        entries = [0 if e is None else e for e in rows["entry"]]
        kept = ["conv_id", "part", "seq", "open", "codes", "turns", "roles", "texts"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(entries, pa.int64()), pa.array(audits, pa.string()), pa.array(costs, pa.int64())], [*kept, "entry", "audit", "spent"])


def solved(own: DataFrame) -> DataFrame:
    """Each segment with the state it begins in and its part of the audit."""
    narrow = own.where("open").select("conv_id", "part", "seq", "far")
    after = narrow.groupBy("conv_id").applyInPandas(_after, "conv_id long, part long, seq long, after array<long>, last boolean").drop("conv_id")
    coded = own.where("open").select("conv_id", "part", "seq", "codes").join(after, ["part", "seq"])
    exits = coded.mapInArrow(_exit_batches, "conv_id long, part long, seq long, after array<long>, last boolean, exits array<long>")
    entries = exits.groupBy("conv_id").applyInPandas(_entries, "part long, seq long, after array<long>, last boolean, entry long")
    return own.join(entries, ["part", "seq"], "left").select(*own.columns, "after", "last", "entry").mapInArrow(_solve_batches, SEGMENT.rpartition(",")[0] + ", entry long, audit string, spent long")


class _Folded:
    """Counts, audit and hash of one conversation, segment by segment."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.sha, self.audit, self.any = conv_id, hashlib.sha256(), [], False
        self.faults, self.illegal, self.cost, self.last = [0] * 4, 0, 0, ""
        self.first_turn = self.last_turn = None
        self.distinct = 0

    def add(self, codes: bytes, turns: list, roles: list, texts: list, entry: int, audit: str, spent: int) -> None:
        count = np.bincount(np.frombuffer(codes, np.uint8) >> 2, minlength=4)
        self.faults = [a + int(b) for a, b in zip(self.faults, count, strict=True)]
        initials = [r[:1] for r in roles]
        self.illegal += sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)) + (bool(self.audit) and self.last + initials[0] not in LEGAL)
        self.last = initials[-1]
        for turn in turns:
            if turn is not None and turn != self.last_turn:
                self.distinct += 1
                self.last_turn = turn
                self.first_turn = turn if self.first_turn is None else self.first_turn
        for _, role, text in edited(audit, entry, roles, texts):
            if role is not None:
                self.sha.update((("\n" if self.any else "") + f"{role}:{text}").encode())
                self.any = True
        self.audit.append(audit)
        self.cost += spent

    def row(self) -> tuple:
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.distinct
        return self.conv_id, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _folded(rows: Iterable[tuple]) -> Iterator[tuple]:
    own = None
    for conv_id, *rest in rows:
        if own is None or own.conv_id != conv_id:
            if own is not None:
                yield own.row()
            own = _Folded(conv_id)
        own.add(*rest)
    if own is not None:
        yield own.row()


def _fold_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order of their conversations, one at a time."""
    names = ["conv_id", "codes", "turns", "roles", "texts", "entry", "audit", "spent"]
    rows = (tuple(x[0] for x in batch.select(names).slice(i, 1).to_pydict().values()) for batch in batches for i in range(batch.num_rows))
    held: list[tuple] = []
    columns = [c.split() for c in REPORT.split(", ")]

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if t == "long" else pa.string()) for v, (_, t) in zip(zip(*held, strict=True), columns, strict=True)], [c for c, _ in columns])

    for row in _folded(rows):
        held.append(row)
        if len(held) >= 1000:
            yield out()
            held.clear()
    if held:
        yield out()


def report(conversations: DataFrame, most_rows: int = SEGMENT_ROWS, most_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Faults, costs, audit and the hash of the repaired text of each conversation."""
    own = solved(segments(conversations, most_rows, most_bytes))
    whole = own.where("not open").mapInArrow(_fold_batches, REPORT)
    parts = own.where("open").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_fold_batches, REPORT)
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    found = ids.join(whole.unionByName(parts), F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zero: dict[str, Column] = {c: F.lit(0).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    zero |= {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return found.select(F.col("id").alias("conv_id"), *[F.coalesce(F.col(c), v).alias(c) for c, v in zero.items()])


def _edit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            r = {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}
            edits = list(edited(r["audit"], r["entry"], r["roles"], r["texts"]))
            if edits:
                e, roles, texts = zip(*edits, strict=True)
                n = len(edits)
                yield pa.RecordBatch.from_arrays([pa.array([r[c]] * n, pa.int64()) for c in ("conv_id", "part", "seq")] + [pa.array(range(n), pa.int64()), *[pa.array(x, pa.string()) for x in (e, roles, texts)]], ["conv_id", "part", "seq", "step", "edit", "role", "text"])


def edits(conversations: DataFrame, most_rows: int = SEGMENT_ROWS, most_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """One row an edit, in order of (part, seq, step), with the role and text that it leaves; deletions leave none."""
    return solved(segments(conversations, most_rows, most_bytes)).mapInArrow(_edit_batches, "conv_id long, part long, seq long, step long, edit string, role string, text string")
