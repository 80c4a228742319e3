"""Chat formatting: minimum-cost role repair, then rendering.

A legal conversation has at most one system turn, at its start, then user and assistant by turns, the user
first, ending with either. An automaton over the last role written is walked turn by turn: a turn is
written under its role or, at a cost, another; it is merged into the turn before where that has the same
role; missing turns are inserted empty. The walk of least total cost is found by dynamic programming.

Costs of a block of turns form a matrix (role before x role after) under (min, +), which is associative. So a
conversation is cut into blocks of turn numbers (one with many rows is cut further, by turn, role and a hash of the
text), each block is summed up by its matrix in one task, the
matrices of a conversation are chained forth and back to fix the roles at each block's borders, and each
block then repairs its own turns between them. No task holds more than a block of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlake.llm.common import cut
from pitlake.operators.numbering import number

#: States of the automaton: what was written last.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
#: Costs of a merge, an empty turn and another role; to become the system turn costs one more.
MERGE, INSERT, RELABEL = 2, 3, 4
#: What may be written next without an insertion.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
_FAR = 1 << 40


def _steps() -> dict[tuple[int, int], tuple[int, str, tuple[int, ...]]]:
    """Cheapest way to write role y after state s: cost, what is done, roles inserted before. Missing: impossible."""
    out = {}
    for s in NEXT:
        for y in (SYSTEM, USER, ASSISTANT):
            if y in NEXT[s]:
                out[s, y] = (0, "keep", ())
            elif y == s:
                out[s, y] = (MERGE, "merge", ())
            elif y != SYSTEM:  # shortest chain of empty turns; a system turn fits at the start only
                chain = next((c for c in ((USER,), (ASSISTANT,)) if c[0] in NEXT[s] and y in NEXT[c[0]]), None)
                if chain:
                    out[s, y] = (INSERT * len(chain), "insert", chain)
    return out


STEPS = _steps()


def role_number(role: str | None) -> int:
    """Number of a role name, without regard to case and outer spaces; 0 for any other and for null, which must be relabelled."""
    name = role.strip().lower() if isinstance(role, str) else ""
    return ROLES.index(name) if name in ROLES else 0


def _moves(s: int, x: int) -> Iterator[tuple[int, int]]:
    for y in (SYSTEM, USER, ASSISTANT):
        if (s, y) in STEPS:
            yield y, STEPS[s, y][0] + (0 if y == x else RELABEL + (y == SYSTEM))


def matrix(turns: list[int]) -> list[int]:
    """Least cost from each state to each over the turns, as 16 numbers."""
    out = []
    for start in range(4):
        cost = [0 if s == start else _FAR for s in range(4)]
        for x in turns:
            after = [_FAR] * 4
            for s in range(4):
                if cost[s] < _FAR:
                    for y, c in _moves(s, x):
                        after[y] = min(after[y], cost[s] + c)
            cost = after
        out += cost
    return out


def repair(turns: list[int], start: int = START, end: int | None = None) -> list[tuple[int, str, tuple[int, ...]]]:
    """Role written, action and roles inserted before, for each turn, on the cheapest way from start (to end).

    Of equally cheap ways the one whose last differing role is first in the order system, user, assistant."""
    cost, back = [{start: 0}], []
    for x in turns:
        after: dict[int, int] = {}
        came: dict[int, int] = {}
        for s in sorted(cost[-1]):
            for y, c in _moves(s, x):
                if y not in after or cost[-1][s] + c < after[y]:
                    after[y], came[y] = cost[-1][s] + c, s
        cost.append(after)
        back.append(came)
    at = end if end is not None else min(sorted(cost[-1]), key=cost[-1].__getitem__)
    out = []
    for x, came in zip(reversed(turns), reversed(back)):
        _, action, chain = STEPS[came[at], at]
        out.append((at, action if at == x else ("relabel" if action == "keep" else f"relabel+{action}"), chain))
        at = came[at]
    return out[::-1]


def render(role: int, action: str, chain: tuple[int, ...], text: str | None, before: int, last: bool, opening: str, closing: str, joint: str) -> str:
    """A turn's share of the rendered conversation: closes what was open, writes inserted turns, then the text."""
    if action.endswith("merge"):
        out = joint + (text or "")
    else:
        out = closing if before != START else ""
        for r in chain:
            out += opening.format(role=ROLES[r]) + closing
        out += opening.format(role=ROLES[role]) + (text or "")
    return out + (closing if last else "")


def format_chats(turns: DataFrame, block: int = 512, opening: str = "<|{role}|>\n", closing: str = "<|end|>\n", joint: str = "\n\n") -> DataFrame:
    """One row for each turn: conv_id, turn, n (its rank among rows with one turn number), role, action, inserted, rendered.

    rendered of all turns of a conversation, in order of (turn, n), is the formatted conversation. action is
    keep, merge, insert, relabel, or relabel with one of the former; inserted lists the roles of empty turns written
    before. Repeated rows are turns of their own. Rows with one turn number are ordered by role, a hash of the text, the text and a
    number among equals (of rows that repeat, every `block` of them go before the next); null turns come first; null texts are empty; null and unknown roles are
    relabelled. Null conv_ids are one conversation. Other columns are ignored. A block of `block` turn numbers, or about
    as many rows of one turn number, is one task's unit, so memory follows the block, not the conversation."""
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("h"))
    rows = cut(rows, "rows")
    # equal rows are numbered task by task, so that a row repeated many times is many pieces
    rows = number(rows, [F.col("row")], F.shiftright("row", 33), "copy", by=["conv_id", "turn", "role", "h"]).drop("row")
    rows = rows.withColumn("b", F.floor(F.coalesce("turn", F.lit(-1)) / block).cast("long")).withColumn("again", F.floor(F.col("copy") / block))
    rows = cut(rows, "turns")
    # blocks with more rows than turn numbers: so many bits of the hash cut them into about `block` rows each
    full = rows.groupBy(F.col("conv_id").alias("c"), F.col("b").alias("k")).agg(F.count("*").alias("m")).where(F.col("m") > 2 * block)
    full = cut(full.select("c", "k", F.ceil(F.log2(F.col("m") / block)).cast("int").alias("bits")), "full")
    if full.isEmpty():
        rows = rows.withColumn("bits", F.lit(None).cast("int"))
    else:
        rows = rows.join(full, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("b") == F.col("k")), "left").drop("c", "k")
    part = F.when(F.col("bits").isNotNull(), F.struct("turn", "role", "again", F.expr("shiftright(h, 64 - bits)").alias("h")))
    rows = rows.withColumn("b", F.struct("b", part.alias("part"))).drop("bits")
    order = ["conv_id", "b", "turn", "role", "again", "h", "text", "copy"]

    def dealt(df: DataFrame, *names: str) -> DataFrame:
        return df.repartition("conv_id", "b").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in names])

    def stream(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator:
        return groupby((r for b in batches for r in zip(*[b.column(c).to_pylist() for c in columns])), key=lambda r: r[:2])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for key, group in stream(batches, ["conv_id", "b", "role"]):
            found = [role_number(r[2]) for r in group]
            out.append((*key, [*matrix(found), len(found)]))
        yield _batch(out, _MATRIX)

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (r for b in batches for r in zip(*[b.column(c).to_pylist() for c in ("conv_id", "b", "m")]))
        out = []
        for _, group in groupby(every, key=lambda r: r[0]):
            rows, forth = list(group), [{START: 0}]
            for _, _, m in rows:
                after = {y: min(c + m[4 * s + y] for s, c in forth[-1].items()) for y in range(4)}
                forth.append({y: c for y, c in after.items() if c < _FAR})
            before = [0] * len(rows)  # rows of a block's turn number in the blocks before it
            for k, ((_, a, m), (_, b, _)) in enumerate(zip(rows, rows[1:]), 1):
                if a["part"] and b["part"] and (a["b"], a["part"]["turn"]) == (b["b"], b["part"]["turn"]):
                    before[k] = before[k - 1] + m[16]
            at = min(sorted(forth[-1]), key=forth[-1].__getitem__)
            for k in range(len(rows) - 1, -1, -1):
                (conv, b, m), cost = rows[k], forth[k]
                start = min(sorted(cost), key=lambda s: cost[s] + m[4 * s + at])
                out.append((conv, b, start, at, k + 1 == len(rows), before[k]))
                at = start
            if len(out) >= 10_000:
                yield _batch(out, _BORDERS)
                out = []
        yield _batch(out, _BORDERS)

    kind = rows.schema["b"].dataType.simpleString()
    roles = dealt(rows.select("conv_id", "b", "turn", "role"), *order[:4]).mapInArrow(summed, f"conv_id long, b {kind}, m array<long>")
    # one short row a block: a conversation's blocks are chained where they meet
    met = roles.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "b")
    borders = met.mapInArrow(chained, f"conv_id long, b {kind}, s int, e int, last boolean, n0 long")
    borders = borders.select(F.col("conv_id").alias("c"), F.col("b").alias("k"), "s", "e", "last", "n0")
    fixed = rows.join(borders, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("b") == F.col("k"))).drop("c", "k")
    fixed = dealt(fixed, *order)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (conv, _), group in stream(batches, ["conv_id", "b", "turn", "role", "text", "s", "e", "last", "n0"]):
            group = list(group)
            start, end, last, n = group[0][5:]
            n, turn, before = n - 1, group[0][2], start
            for i, (r, (role, action, chain)) in enumerate(zip(group, repair([role_number(r[3]) for r in group], start, end))):
                n, turn = (n + 1 if r[2] == turn else 0), r[2]
                text = render(role, action, chain, r[4], before, last and i + 1 == len(group), opening, closing, joint)
                out.append((conv, turn, n, ROLES[role], action, [ROLES[x] for x in chain], text))
                before = role
            if len(out) >= 2000:
                yield _batch(out, _TURNS)
                out = []
        yield _batch(out, _TURNS)

    return fixed.mapInArrow(written, "conv_id long, turn long, n int, role string, action string, inserted array<string>, rendered string")


_BLOCK = pa.struct([("b", pa.int64()), ("part", pa.struct([("turn", pa.int64()), ("role", pa.string()), ("again", pa.int64()), ("h", pa.int64())]))])
_MATRIX = pa.schema([("conv_id", pa.int64()), ("b", _BLOCK), ("m", pa.list_(pa.int64()))])
_BORDERS = pa.schema([("conv_id", pa.int64()), ("b", _BLOCK), ("s", pa.int32()), ("e", pa.int32()), ("last", pa.bool_()), ("n0", pa.int64())])
_TURNS = pa.schema([
    ("conv_id", pa.int64()), ("turn", pa.int64()), ("n", pa.int32()), ("role", pa.string()), ("action", pa.string()),
    ("inserted", pa.list_(pa.string())), ("rendered", pa.string()),
])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def conversations(formatted: DataFrame) -> DataFrame:
    """conv_id and text: each formatted conversation as one string, for conversations that fit into a row."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "n", "rendered")))
    return formatted.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["rendered"]), "").alias("text"))


def legal(roles: Column) -> Column:
    """Whether an array of role names is a legal conversation."""
    return F.array_join(F.transform(roles, lambda r: F.substring(r, 1, 1)), "").rlike("^s?(ua)*u?$")
