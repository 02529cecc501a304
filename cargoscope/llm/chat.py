"""Chat turns repaired to a legal sequence at least cost, and rendered.

Legal is: at most one system turn, at the start, then user and assistant in turn, user first.  Each
turn keeps its role or is relabelled, and either starts a new turn, joins the turn before it, or
follows an empty turn put in so that it may stand.  Dynamic programming over the states start,
system, user and assistant finds the cheapest choices.

A conversation may hold a third of all rows, so turns are laid out by range and cut into pieces of
bounded length.  A piece is a matrix of costs from state to state; the matrices of a conversation
are chained to fix the states at the ends of each piece, and each piece is then solved by itself.
Turns come back one per row with their rendered part, so no row grows with its conversation.
"""

from __future__ import annotations

from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargoscope import session
from cargoscope.llm import common

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = (None, "system", "user", "assistant")
MERGE, INSERT, RELABEL = 2, 3, 4  # costs
NEVER = 1 << 40
PIECE = 2048  # turns of a piece, at most


def move(state: int, role: int) -> tuple[int, str]:
    """Cost and kind of placing a turn of ``role`` after ``state``."""
    if role == SYSTEM:
        return (0, "new") if state == START else (MERGE, "merge") if state == SYSTEM else (NEVER, "")
    if state == role:
        return (MERGE, "merge") if MERGE <= INSERT else (INSERT, "insert")
    if role == USER or state == USER:
        return 0, "new"
    return INSERT, "insert"  # an assistant turn without a user turn before it


STEPS = [[move(s, r) for r in range(4)] for s in range(4)]


def role_number(role: str | None) -> int:
    """1 to 3 for the known roles, in any case and with outer blanks; 0 for others and null."""
    name = (role or "").strip().lower()
    return ROLES.index(name) if name in ROLES else 0


def forward(roles: list[int], cost: list[int]) -> tuple[list[int], list[list[int]]]:
    """Least costs per end state, and for each turn and state the state it came from."""
    back = []
    for own in roles:
        new, came = [NEVER] * 4, [0] * 4
        for r in (SYSTEM, USER, ASSISTANT):
            label = 0 if r == own else RELABEL
            for s in range(4):
                c = cost[s] + STEPS[s][r][0] + label
                if c < new[r]:
                    new[r], came[r] = c, s
        cost = new
        back.append(came)
    return cost, back


def solve(roles: list[int], begin: int = START, end: int | None = None) -> tuple[int, list[tuple[int, int]]]:
    """Least cost, and the state before and after each turn; of equal ends the first state."""
    cost, back = forward(roles, [0 if s == begin else NEVER for s in range(4)])
    last = min(range(4), key=lambda s: cost[s]) if end is None else end
    path, state = [], last
    for came in reversed(back):
        path.append((came[state], state))
        state = came[state]
    return cost[last], path[::-1]


def part(before: int, after: int, text: str | None, last: bool) -> str:
    """Rendered part of one turn: ends the turn before it unless it joins it."""
    kind = STEPS[before][after][1]
    clean = (text or "").replace("<|", "< |")
    head = "" if before == START else "<|end|>\n"
    if kind == "merge":
        out = f"\n{clean}"
    elif kind == "insert":
        empty = ROLES[USER if after == ASSISTANT else ASSISTANT]
        out = f"{head}<|{empty}|>\n<|end|>\n<|{ROLES[after]}|>\n{clean}"
    else:
        out = f"{head}<|{ROLES[after]}|>\n{clean}"
    return out + ("<|end|>\n" if last else "")


def _cut(batches):
    """Number the turns of each sorted partition by piece and place."""
    conv, piece, place = object(), -1, 0
    for rows in batches:
        pieces, places = [], []
        for c in rows.column(1).to_pylist():
            if c != conv or place == PIECE:
                conv, piece, place = c, piece + 1, 0
            pieces.append(piece)
            places.append(place)
            place += 1
        yield common.batch(part=rows.column(0), piece=pa.array(pieces, pa.int64()), place=pa.array(places, pa.int32()),
                           conv_id=rows.column(1), turn=rows.column(2), role=rows.column(3), text=rows.column(4))


def _runs(batches, names: list[str], key: int):
    """Rows of sorted batches, grouped by their first ``key`` columns."""
    rows = (row for b in batches for row in zip(*(b.column(n).to_pylist() for n in names)))
    return groupby(rows, key=lambda r: r[:key])


def _send(rows: list[tuple], names: list[str], types: list[pa.DataType]):
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)


def _flushed(rows, names: list[str], types: list[pa.DataType], most: int = 4096):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield _send(held, names, types)
            held = []
    if held:
        yield _send(held, names, types)


def _matrices(batches):
    def rows():
        for (conv, part_, piece), turns in _runs(batches, ["conv_id", "part", "piece", "role"], 3):
            roles = [role_number(t[3]) for t in turns]
            yield (conv, part_, piece, [c for s in range(4) for c in forward(roles, [0 if x == s else NEVER for x in range(4)])[0]])

    yield from _flushed(rows(), ["conv_id", "part", "piece", "costs"], [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())])


def _chained(batches):
    def rows():
        for (conv,), pieces in _runs(batches, ["conv_id", "part", "piece", "costs"], 1):
            cost, back, ids = [0, NEVER, NEVER, NEVER], [], []
            for _, part_, piece, m in pieces:
                came = [min(range(4), key=lambda s: cost[s] + m[4 * s + e]) for e in range(4)]
                cost = [min(NEVER, cost[came[e]] + m[4 * came[e] + e]) for e in range(4)]
                back.append(came)
                ids.append((part_, piece))
            state, total, last = min(range(4), key=lambda s: cost[s]), min(cost), True
            for (part_, piece), came in zip(reversed(ids), reversed(back)):
                yield (conv, part_, piece, came[state], state, last, total)
                state, last = came[state], False

    yield from _flushed(rows(), ["conv_id", "part", "piece", "begin", "end", "last", "cost"],
                        [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()])


def _solved(batches):
    names = ["conv_id", "part", "piece", "begin", "end", "last", "cost", "turn", "role", "text"]

    def rows():
        for (conv, _, _, begin, end, last, cost), turns in _runs(batches, names, 7):
            turns = list(turns)
            roles = [role_number(t[8]) for t in turns]
            _, path = solve(roles, begin, end)
            for i, (t, own, (before, after)) in enumerate(zip(turns, roles, path)):
                kind = STEPS[before][after][1]
                yield (conv, t[7], t[8], ROLES[after], ("relabel " if own != after else "") + kind, cost, part(before, after, t[9], last and i == len(turns) - 1))

    yield from _flushed(rows(), ["conv_id", "turn", "role", "new_role", "action", "conv_cost", "rendered"],
                        [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()])


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, new_role, action, conv_cost and rendered, one row per row of ``turns``.

    ``turns`` needs conv_id, turn, role and text.  Turns are ordered by turn, then role, then a
    hash of the text; nulls come first, and rows equal in all are turns of their own.  A null
    conv_id is a conversation like any other; null texts are empty; a null or unknown role is
    relabelled.  The parts of a conversation, joined in that order, are its rendered text.
    """
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    order = ["conv_id", "turn", "role", F.xxhash64("text")]
    laid = own.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "conv_id", "turn", "role", "text")
    pieces = session.stored(common.map_arrow(laid, _cut, "part int, piece long, place int, conv_id long, turn long, role string, text string"), "turns")
    by_piece = pieces.select("conv_id", "part", "piece", "place", "role").repartition("conv_id", "part", "piece").sortWithinPartitions("conv_id", "part", "piece", "place")
    costs = common.map_arrow(by_piece, _matrices, "conv_id long, part int, piece long, costs array<long>")
    chained = costs.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    ends = session.stored(common.map_arrow(chained, _chained, "conv_id long, part int, piece long, begin int, end int, last boolean, cost long"), "piece-ends")
    ends = ends.drop("conv_id")
    joined = pieces.join(ends, ["part", "piece"]).repartition("part", "piece").sortWithinPartitions("part", "piece", "place")
    return common.map_arrow(joined, _solved, "conv_id long, turn long, role string, new_role string, action string, conv_cost long, rendered string")
