"""Chat formatting by minimum-cost role repair over an automaton of legal turns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.scratch import materialise
from tessera.session import ship

ROLES = ("system", "user", "assistant")
#: Names that stand for a role, lower case; anything else is unknown and costs UNKNOWN to relabel.
ALIASES = {"human": "user", "bot": "assistant", "ai": "assistant", "model": "assistant"}
MERGE, INSERT, RELABEL, UNKNOWN = 1, 2, 3, 1
#: Consecutive turns of a conversation that are repaired in one piece.
STRETCH = 256
OPEN, CLOSE = "<|im_start|>{role}\n", "<|im_end|>\n"
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn (the only accepting one).
START, SYSTEM, USER, ASSISTANT = range(4)
_INF = np.iinfo(np.int64).max // 4
#: Costs carry the number of output rows below them, so that of equally cheap repairs the shortest is taken.
_UNIT = 1 << 32


def _moves() -> list[tuple[int, int, int, tuple[int, ...], bool]]:
    """(state, role, next state, roles of empty turns inserted before, merged) of every legal step."""
    found = []
    for state in range(4):
        for role in range(3):
            if role == 0:
                if state == START:
                    found.append((state, role, SYSTEM, (), False))
                elif state == SYSTEM:
                    found.append((state, role, SYSTEM, (), True))
            elif role == 1:
                if state == USER:
                    found.append((state, role, USER, (), True))
                    found.append((state, role, USER, (2,), False))
                else:
                    found.append((state, role, USER, (), False))
            else:
                if state == USER:
                    found.append((state, role, ASSISTANT, (), False))
                else:
                    found.append((state, role, ASSISTANT, (1,), False))
                if state == ASSISTANT:
                    found.append((state, role, ASSISTANT, (), True))
    return found


_MOVES = _moves()


def role_number(role: str | None) -> int:
    """0, 1, 2 for the roles of ROLES, 3 for unknown ones."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES else 3


def _price(role: int, move) -> int:
    _, to_role, _, inserts, merged = move
    relabel = 0 if role == to_role else UNKNOWN if role == 3 else RELABEL
    return (relabel + MERGE * merged + INSERT * len(inserts)) * _UNIT + 1 + len(inserts)


_STEP = np.full((4, 4, 4), _INF)  # [role][state][next]
_CHOICE = np.full((4, 4, 4), -1)
for _r in range(4):
    for _i, _m in enumerate(_MOVES):
        if _price(_r, _m) < _STEP[_r, _m[0], _m[2]]:
            _STEP[_r, _m[0], _m[2]], _CHOICE[_r, _m[0], _m[2]] = _price(_r, _m), _i


def _then(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cheapest costs of going through a, then b."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), _INF)


def closing(state: int) -> tuple[int, int]:
    """Cost, and number of empty turns, of ending in a state: a user turn gets an empty answer, a lone system turn a pair."""
    return {ASSISTANT: (0, 0), USER: (INSERT * _UNIT + 1, 1)}.get(state, (2 * INSERT * _UNIT + 2, 2))


def stretch_costs(roles: list[int]) -> np.ndarray:
    out = np.where(np.eye(4, dtype=bool), 0, _INF)
    for r in roles:
        out = _then(out, _STEP[r])
    return out


def repair(roles: list[int], enter: int, leave: int) -> list[tuple[int, tuple[int, ...], bool]]:
    """The cheapest steps from state `enter` to `leave`: (role, inserted roles before, merged) for each turn."""
    best = np.where(np.arange(4) == enter, 0, _INF)
    back = []
    for r in roles:
        total = best[:, None] + _STEP[r]
        back.append(total.argmin(0))
        best = np.minimum(total.min(0), _INF)
    out, state = [], leave
    for r, came in zip(reversed(roles), reversed(back)):
        move = _MOVES[_CHOICE[r, came[state], state]]
        out.append((move[1], move[3], move[4]))
        state = int(came[state])
    return out[::-1]


_KEYS = ("conv_id", "part", "stretch")


def _runs(batches, keys):
    """(key values, rows) of each run of rows with equal keys in sorted batches; a run may span batches."""
    held, key = [], None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in keys]
        values = list(zip(*columns))
        edges = [0, *(i for i in range(1, len(values)) if values[i] != values[i - 1]), len(values)]
        for lo, hi in zip(edges, edges[1:]):
            if hi == lo:
                continue
            if held and values[lo] != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = values[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield key, pa.Table.from_batches(held)


def _stretches(size):
    """Numbers the rows of a sorted partition through in stretches of `size` rows of a conversation. The last row of a
    stretch carries its costs, the last row of a conversation in this partition those of all its rows here."""

    def run(batches):
        part = TaskContext.get().partitionId()
        conv, any_, stretch, inside, own, whole = None, False, 0, 0, None, None
        start = np.where(np.eye(4, dtype=bool), 0, _INF)

        def costs(matrix):
            return None if matrix is None else matrix.ravel().tolist()

        pending = None  # one row is held back until it is known whether its stretch goes on

        def rows_of(batch):
            nonlocal conv, any_, stretch, inside, own, whole, pending
            ids, roles = batch.column("conv_id").to_pylist(), batch.column("role").to_pylist()
            numbers, ends, totals = [], [], []
            for c, role in zip(ids, roles):
                fresh = not any_ or c != conv
                cut = fresh or inside == size
                if cut and any_:
                    whole = _then(whole, own)
                ends.append(costs(own) if cut and any_ else None)
                totals.append(costs(whole) if fresh and any_ else None)
                if cut:
                    stretch, inside, own = stretch + 1, 0, start
                if fresh:
                    conv, any_, whole = c, True, start
                step = _STEP[role_number(role)]
                own, inside = _then(own, step), inside + 1
                numbers.append(stretch)
            return numbers, ends, totals

        for batch in batches:
            if not batch.num_rows:
                continue
            numbers, ends, totals = rows_of(batch)
            # What was found at a row belongs to the row before it.
            if pending is not None:
                yield _with(pending[0], part, pending[1], [*pending[2], ends[0]], [*pending[3], totals[0]])
            pending = (batch, numbers, ends[1:], totals[1:])
        if pending is not None:
            yield _with(pending[0], part, pending[1], [*pending[2], costs(own)], [*pending[3], costs(_then(whole, own))])

    return run


def _with(batch, part, numbers, ends, totals) -> pa.RecordBatch:
    kind = pa.list_(pa.int64())
    more = [pa.array([part] * batch.num_rows, pa.int64()), pa.array(numbers, pa.int64()), pa.array(ends, kind), pa.array(totals, kind)]
    return pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "part", "stretch", "costs", "total"])


def _solve(parts, enter=None, leave=None, before=0):
    """(name, enter, leave, output rows before, last) of consecutive parts (name, costs), from START to the cheapest end, or
    between given states."""
    best, back = np.where(np.arange(4) == (START if enter is None else enter), 0, _INF), []
    matrices = [np.array(costs, np.int64).reshape(4, 4) for _, costs in parts]
    for matrix in matrices:
        total = best[:, None] + matrix
        back.append(total.argmin(0))
        best = np.minimum(total.min(0), _INF)
    state = int(np.argmin([best[s] + closing(s)[0] for s in range(4)])) if leave is None else leave
    out = []
    for i in range(len(parts) - 1, -1, -1):
        came = int(back[i][state])
        out.append((parts[i][0], came, state, int(matrices[i][came, state]) % _UNIT, i == len(parts) - 1))
        state = came
    for name, came, state, rows, last in reversed(out):
        yield name, came, state, before, last
        before += rows


def _paths(batches):
    """Entry and exit state of the part of each partition in a conversation, and how many output rows come before it."""
    names, types = ["conv_id", "part", "enter", "leave", "before", "last"], (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_())
    for (conv,), rows in _runs(batches, ["conv_id"]):
        found = [(conv, *f) for f in _solve(list(zip(rows.column("part").to_pylist(), rows.column("total").to_pylist())))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)


def _inner(batches):
    """The same for each stretch inside a partition's part."""
    names = ["conv_id", "part", "stretch", "enter", "leave", "before", "last"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_())
    for (conv, part), rows in _runs(batches, ["conv_id", "part"]):
        enter, leave, before, ends = (rows.column(c)[0].as_py() for c in ("enter", "leave", "before", "last"))
        parts = list(zip(rows.column("stretch").to_pylist(), rows.column("costs").to_pylist()))
        found = [(conv, part, s, a, b, n, last and ends) for s, a, b, n, last in _solve(parts, enter, leave, before)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)


def _render(batches):
    names = ["conv_id", "position", "turn", "role", "action", "cost", "rendered"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    for (conv, *_), rows in _runs(batches, _KEYS):
        roles = [role_number(r) for r in rows.column("role").to_pylist()]
        turns, text = rows.column("turn").to_pylist(), rows.column("text").to_pylist()
        enter, leave, position, last = (rows.column(c)[0].as_py() for c in ("enter", "leave", "before", "last"))
        steps, out = repair(roles, enter, leave), []

        def put(turn, role, action, cost, rendered):
            out.append((conv, position + len(out), turn, ROLES[role], action, cost, rendered))

        open_ = position > 0  # a turn is left open until it is known that nothing is merged into it
        for was, turn, body, (role, inserts, merged) in zip(roles, turns, text, steps):
            body = body or ""
            head = "\n" if merged else CLOSE if open_ else ""
            for r in inserts:
                put(None, r, "insert", INSERT, head + OPEN.format(role=ROLES[r]))
                head = CLOSE
            if not merged:
                head += OPEN.format(role=ROLES[role])
            relabel = 0 if was == role else UNKNOWN if was == 3 else RELABEL
            action = "+".join(a for a, on in (("relabel", was != role), ("merge", merged)) if on) or "keep"
            put(turn, role, action, relabel + MERGE * merged, head + body)
            open_ = True
        if last:
            for r in {USER: (2,), ASSISTANT: ()}.get(leave, (1, 2)):
                put(None, r, "insert", INSERT, CLOSE + OPEN.format(role=ROLES[r]))
            out[-1] = (*out[-1][:6], out[-1][6] + CLOSE)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def format_chat(turns: DataFrame) -> DataFrame:
    """One row per output turn: conv_id, position, turn, role, action, cost, rendered.

    A legal conversation has at most one system turn, first, then user and assistant turns in alternation, ending with
    the assistant. Repairs are: merging a turn into the one before (MERGE), relabelling it (RELABEL; UNKNOWN if its role
    is none of ROLES or ALIASES), inserting an empty turn (INSERT). The repair of least total cost is taken; among these
    one with the fewest output rows, then of the smallest states. `rendered` pieces, joined in order of position (from 0,
    gapless in a conversation), are the whole transcript in a ChatML-like template; a merged turn is joined by a newline.
    `turn` is null for inserted turns, `action` is keep, relabel, merge, relabel+merge or insert.

    Turns are taken in order of turn, then role and text. A null role is unknown, a null text empty, a null turn comes
    first; rows with a null conv_id form a conversation of their own. Repeated rows are turns like any other. Extra columns
    are ignored; an empty table gives an empty result.

    The dynamic program is associative. Turns are sorted over all partitions, so a conversation of any size, and turns of
    any number that repeat, are cut into stretches of STRETCH rows. Stretches, and each partition's part of a conversation,
    are reduced to (min, +) matrices over the four states; the matrices choose entry and exit states, first of parts, then of
    stretches; and stretches are repaired and rendered on their own. No task holds a conversation's turns or transcript.
    """
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    order = ["conv_id", "turn", "role", "text"]
    ship(turns.sparkSession)
    ordered = rows.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    fields = "conv_id long, turn long, role string, text string, part long, stretch long, costs array<bigint>, total array<bigint>"
    cut = materialise(ordered.mapInArrow(_stretches(STRETCH), fields))
    parts = cut.where("total is not null").select("conv_id", "part", "total").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    paths = parts.mapInArrow(_paths, "conv_id long, part long, enter int, leave int, before long, last boolean")

    def beside(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
        """`left` with what `right` has beside the keys; null is a conversation, too."""
        same = F.col("l.conv_id").eqNullSafe(F.col("r.conv_id"))
        for k in keys:
            same = same & (F.col(f"l.{k}") == F.col(f"r.{k}"))
        return left.alias("l").join(right.alias("r"), same).select("l.*", "r.enter", "r.leave", "r.before", "r.last")

    inner = beside(cut.where("costs is not null").select("conv_id", "part", "stretch", "costs"), materialise(paths), "part")
    inner = inner.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "stretch")
    inner = materialise(inner.mapInArrow(_inner, "conv_id long, part long, stretch long, enter int, leave int, before long, last boolean"))
    joined = beside(cut.drop("costs", "total"), inner, "part", "stretch")
    return joined.repartition("conv_id", "part", "stretch").sortWithinPartitions("conv_id", "part", "stretch", *order[1:]).mapInArrow(
        _render, "conv_id long, position long, turn long, role string, action string, cost long, rendered string"
    )
