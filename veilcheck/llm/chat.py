"""Chat formatting: the cheapest repair of a conversation's roles, then its rendering.

A legal conversation is `[system] (user assistant)*`. A turn may join the one
before it (MERGE), take another role (RELABEL; RENAME for a role that is none
of the three), or have an empty turn put before it (INSERT), each at a cost;
dynamic programming over the automaton's four states finds the least sum. One
turn is a 4 by 4 table of costs, and tables of following turns combine into
one by minima of sums. So a conversation is cut into segments: each gives its
table, the tables of a conversation give the states at its segments' ends, and
every segment is repaired by itself between those. No conversation, however
long, is held by one task. Runs of turns go through the automaton together, a
turn a step, so that Python works by batches and not by conversations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .common import lean, settled, type_of

MERGE, RELABEL, RENAME, INSERT = 1, 2, 1, 3
ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Turns of a segment.
SEGMENT = 4096
#: Characters of a text that turns of one number and role are dealt by.
RANGE_CHARS = 64
START, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3
_NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
_FAR = 1 << 40


def known(role: str | None) -> int:
    """The state of a role, 0 for one that is none of the three."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else 0


def moves() -> tuple[np.ndarray, dict[tuple[int, int], tuple[str, int]]]:
    """costs[role, state before, state after] of a turn, and how it is placed: (keep, merge or insert, state of the empty turn)."""
    costs, how = np.full((4, 4, 4), _FAR, np.int64), {}
    for before in range(4):
        for after in (SYSTEM, USER, ASSISTANT):
            options = []
            if after in _NEXT[before]:
                options.append((0, "keep", 0))
            if after == before:
                options.append((MERGE, "merge", 0))
            options += [(INSERT, "insert", m) for m in _NEXT[before] if after in _NEXT[m]]
            if options:
                cost, kind, empty = min(options, key=lambda o: o[0])
                how[before, after] = kind, empty
                for role in range(4):
                    costs[role, before, after] = cost + (0 if role == after else RENAME if role == 0 else RELABEL)
    return costs, how


COSTS, HOW = moves()
#: What it costs to end in a state: empty turns up to an assistant's.
END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)


def _left(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs in order, the longest first, and how many of them have a turn at each step."""
    order = np.argsort(-sizes, kind="stable")
    return order, len(sizes) - np.searchsorted(sizes[order][::-1], np.arange(1, (sizes.max() if len(sizes) else 0) + 1))


def _ways(roles: np.ndarray, sizes: np.ndarray, cost: np.ndarray, trace: bool):
    """The least costs after each run of turns, and for each turn the state before it on the cheapest way to each state.

    roles holds the runs' turns end to end, sizes their lengths, cost the
    costs of the states before (a row a run). All runs go a turn a step
    together, the longest first, so a step is one operation over all that are
    left.
    """
    first = np.cumsum(sizes) - sizes
    order, left = _left(sizes)
    back = np.zeros((len(roles), 4), np.int8) if trace else None
    cost = cost.copy()
    for t, n in enumerate(left.tolist()):
        now = order[:n]
        at = first[now] + t
        step = cost[now][:, :, None] + COSTS[roles[at]]
        if trace:
            back[at] = step.argmin(axis=1)
        cost[now] = np.minimum(step.min(axis=1), _FAR)
    return cost, back


def tables(roles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of runs of turns: [run, 0, state before, state after] their costs, and [run, 1, ...] a rank of the states before, for each state after.

    Of two ways that cost the same, that one is taken which has the smaller
    state where they part, seen from the end. The rank tells this order, so
    that runs give together what they give as one.
    """
    begin = np.where(np.eye(4, dtype=bool), 0, _FAR)
    each = [_ways(roles, sizes, np.tile(begin[s], (len(sizes), 1)), True) for s in range(4)]
    costs = np.stack([c for c, _ in each], axis=1)
    back = np.stack([b for _, b in each], axis=1)  # turn, state before the run, state after the turn
    now = np.tile(np.arange(4), (len(sizes), 4, 1))  # run, state before it, state after it
    less = np.zeros((len(sizes), 4, 4, 4), np.int8)  # run, two states before, state after: -1, 0 or 1
    last = np.cumsum(sizes) - 1
    order, left = _left(sizes)
    for t, n in enumerate(left.tolist()):
        own = order[:n]
        now[own] = np.take_along_axis(back[last[own] - t], now[own], axis=2)
        sign = np.sign(now[own][:, :, None] - now[own][:, None]).astype(np.int8)
        less[own] = np.where(less[own] == 0, sign, less[own])
    return np.stack([costs, (less > 0).sum(axis=2)], axis=1)


def paths(roles: np.ndarray, sizes: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The state after each turn of the cheapest ways from a run's state before to its state after (-1: to wherever the end costs least); ties go to the smaller state."""
    begin = np.full((len(sizes), 4), _FAR, np.int64)
    begin[np.arange(len(sizes)), before] = 0
    cost, back = _ways(roles, sizes, begin, True)
    state = np.where(after < 0, (cost + END).argmin(axis=1), after)
    out = np.zeros(len(roles), np.int8)
    last = np.cumsum(sizes) - 1
    order, left = _left(sizes)
    for t, n in enumerate(left.tolist()):
        now = order[:n]
        at = last[now] - t
        out[at] = state[now]
        state[now] = back[at, state[now]]
    return out


def ends(tables: list[np.ndarray]) -> list[tuple[int, int]]:
    """(state before, state after) of each segment of a conversation."""
    cost = np.array([0, _FAR, _FAR, _FAR], np.int64)
    back = []
    for costs, rank in tables:
        step = cost[:, None] + costs
        cost = step.min(axis=0)
        back.append(np.where(step == cost, rank, 4).argmin(axis=0))
        cost = np.minimum(cost, _FAR)
    state, out = int((cost + END).argmin()), []
    for b in reversed(back):
        out.append((int(b[state]), state))
        state = int(b[state])
    return out[::-1]


KINDS = ("keep", "merge", "insert", "relabel", "end")
#: How a turn is placed between two states, as an index into KINDS, and the empty turn before it.
_KIND, _EMPTY = np.zeros((4, 4), np.int8), np.zeros((4, 4), np.int8)
for (_before, _after), (_kind, _state) in HOW.items():
    _KIND[_before, _after], _EMPTY[_before, _after] = KINDS.index(_kind), _state


def opened(state: int, first: bool) -> str:
    return ("" if first else "<|im_end|>\n") + f"<|im_start|>{ROLES[state - 1]}\n"


#: What a row begins with: of each state, as the conversation's first turn and as another; then a merged turn's and the end's.
_HEADS = pa.array([opened(s, f) if s else "" for f in (True, False) for s in range(4)] + ["\n", "<|im_end|>\n"])
_MERGED, _END = 8, 9


def rendered(conv: pa.Array, turn: pa.Array, roles: np.ndarray, texts: pa.Array, sizes: np.ndarray, before: np.ndarray, after: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    """Rows (conv, turn, step, action, state, text) of runs of turns; step 0 and 2 are empty turns before and after one, 3 the end of a run that is a conversation's last."""
    states = paths(roles, sizes, before, after).astype(np.int64)
    first = np.cumsum(sizes) - sizes
    came = np.r_[0, states[:-1]]
    came[first] = before
    kind, empty = _KIND[came, states], _EMPTY[came, states].astype(np.int64)
    at = np.arange(len(roles))
    started = came != START
    named = np.where(kind == 1, 1, np.where(roles == states, 0, 3))
    turns = at, np.full(len(at), 1), named, states, np.where(kind == 1, _MERGED, states + 4 * (started | (kind == 2)))
    put = np.flatnonzero(kind == 2)
    before_ = put, np.zeros(len(put), np.int64), np.full(len(put), 2), empty[put], empty[put] + 4 * started[put]
    close = (np.cumsum(sizes) - 1)[last]
    more = [(x := close[states[close] < s], np.full(len(x), 2), np.full(len(x), 2), np.full(len(x), s), np.full(len(x), s + 4)) for s in (USER, ASSISTANT)]
    done = close, np.full(len(close), 3), np.full(len(close), 4), np.full(len(close), ASSISTANT), np.full(len(close), _END)
    source, step, action, state, head = (np.concatenate(x) for x in zip(before_, turns, *more, done, strict=True))
    order = np.lexsort((state, step, source))
    source, step, action, state, head = source[order], step[order], action[order], state[order], head[order]
    # the template's own markers within a text are taken apart
    shown = pa.compute.replace_substring(pa.compute.fill_null(texts, ""), "<|", "< |")
    own = pa.array(np.where(step == 1, source, -1), pa.int64(), mask=step != 1)
    text = pa.compute.binary_join_element_wise(_HEADS.take(pa.array(head)), pa.compute.fill_null(shown.take(own), ""), "")
    source = pa.array(source)
    return pa.RecordBatch.from_arrays([conv.take(source), turn.take(source), pa.array(step, pa.int32()), pa.array(KINDS).take(pa.array(action)), pa.array(state, pa.int32()), text], names=["conv", "turn", "step", "action", "state", "text"])


def _changes(column: pa.Array) -> np.ndarray:
    """Which values differ from the one before; the first does, and nulls equal each other."""
    out = np.ones(len(column), bool)
    if len(column) > 1:
        a, b = column.slice(0, len(column) - 1), column.slice(1)
        same = pa.compute.fill_null(pa.compute.equal(a, b), False)
        out[1:] = ~pa.compute.or_(same, pa.compute.and_(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)
    return out


def _states(names: pa.Array) -> np.ndarray:
    """known() of each role."""
    coded = names.dictionary_encode()
    codes = np.array([*map(known, coded.dictionary.to_pylist()), 0], np.int64)
    return codes[pa.compute.fill_null(coded.indices, len(codes) - 1).to_numpy(zero_copy_only=False)]


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(i) for b in batches]) for i in range(batches[0].num_columns)], names=batches[0].schema.names)


def cutter(segment_turns: int):
    """A mapInArrow function over sorted (conv, turn, role, text).

    Rendered rows of conversations that begin and end within the task and one
    segment (segment null). Of others the turns, with their segment and place,
    and of each segment a row with its costs (place -1).
    """
    names = ["conv", "turn", "step", "action", "state", "text", "segment", "place", "costs"]

    def run(batches):
        name = TaskContext.get().partitionId() << 32

        def cut(rows: pa.RecordBatch, states: np.ndarray, sizes: np.ndarray):
            nonlocal name
            n, each = len(rows), len(sizes)
            first = np.cumsum(sizes) - sizes
            own = np.repeat(np.arange(each), sizes)
            yield [rows.column(0), rows.column(1), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.array(states, pa.int32()), rows.column(3), pa.array(own + name), pa.array(np.arange(n) - first[own], pa.int32()), pa.nulls(n, pa.binary())]
            number, word = pa.nulls(each, pa.int32()), pa.nulls(each, pa.string())
            costs = pa.array([x.astype(np.int64).tobytes() for x in tables(states, sizes)], pa.binary())
            yield [rows.column(0).take(pa.array(first)), pa.nulls(each, rows.column(1).type), number, word, number, word, pa.array(np.arange(each) + name), pa.array(np.full(each, -1), pa.int32()), costs]
            name += each

        def send(held: list[pa.RecordBatch], first_inner: bool, closed: bool):
            """Of conversations one after the other: whether the first is known to begin, and the last to end."""
            rows = _joined(held)
            states = _states(rows.column(2))
            sizes = np.diff(np.append(np.flatnonzero(_changes(rows.column(0))), len(rows)))
            inner = sizes <= segment_turns
            inner[0] &= first_inner
            inner[-1] &= closed
            mine = np.repeat(inner, sizes)
            if inner.any():
                some, n = rows.filter(pa.array(mine)), int(inner.sum())
                out = rendered(some.column(0), some.column(1), states[mine], some.column(3), sizes[inner], np.zeros(n, np.int64), np.full(n, -1), np.ones(n, bool))
                yield [*out.columns, pa.nulls(len(out), pa.int64()), pa.nulls(len(out), pa.int32()), pa.nulls(len(out), pa.binary())]
            if not inner.all():
                pieces = [min(segment_turns, n - lo) for n in sizes[~inner].tolist() for lo in range(0, n, segment_turns)]
                yield from cut(rows.filter(pa.array(~mine)), states[~mine], np.array(pieces, np.int64))

        def sent():
            held: list[pa.RecordBatch] = []  # turns of the open conversation
            conv, inner = None, False  # its name; whether it began within the task and no part of it was sent
            for batch in batches:
                if not len(batch):
                    continue
                new = _changes(batch.column(0))
                new[0] = conv is None or _changes(pa.concat_arrays([conv, batch.column(0).slice(0, 1)]))[1]
                at = np.flatnonzero(new)
                if len(at):
                    lo = int(at[-1])
                    if held or lo:
                        goes_on = bool(held) or not new[0]
                        yield from send([*held, batch.slice(0, lo)], inner if goes_on else conv is not None, True)
                    inner = conv is not None or lo > 0
                    held, conv = [batch.slice(lo)], batch.column(0).slice(lo, 1)
                else:
                    held.append(batch)
                if sum(map(len, held)) > segment_turns:
                    yield from send(held, False, False)
                    held, inner = [], False
            if held:
                yield from send(held, inner, False)

        for columns in sent():
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def between(batches):
    """A mapInArrow function over (conv, segment, costs), sorted: the states before and after each segment, and whether it is its conversation's last."""
    names = ["segment", "before", "after", "last"]

    def out(held):
        found = ends([np.frombuffer(x, np.int64).reshape(2, 4, 4) for _, x in held])
        n = len(found)
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in held], pa.int64()), pa.array([a for a, _ in found], pa.int32()), pa.array([b for _, b in found], pa.int32()), pa.array([i == n - 1 for i in range(n)])], names=names)

    conv, held = None, []
    for batch in batches:
        new = _changes(batch.column(0))
        if held and len(batch):
            new[0] = _changes(pa.concat_arrays([conv, batch.column(0).slice(0, 1)]))[1]
        for i, (segment, costs) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            if new[i] and held:
                yield out(held)
                held = []
            held.append((segment, costs))
        if len(batch):
            conv = batch.column(0).slice(len(batch) - 1)
    if held:
        yield out(held)


def repair(batches):
    """A mapInArrow function over (segment, place, conv, turn, state, text, before, after, last), a segment's note (place -1) first: rendered rows."""

    def out(rows: pa.RecordBatch):
        place = rows.column(1).to_numpy()
        notes = np.flatnonzero(place == -1)
        sizes = np.diff(np.append(notes, len(place))) - 1
        turns = rows.filter(pa.array(place >= 0))
        before, after, last = (rows.column(i).take(pa.array(notes)).to_numpy(zero_copy_only=False) for i in (6, 7, 8))
        return rendered(turns.column(2), turns.column(3), turns.column(4).to_numpy().astype(np.int64), turns.column(5), sizes, before.astype(np.int64), after.astype(np.int64), last.astype(bool))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        notes = np.flatnonzero(batch.column(1).to_numpy() == -1)
        lo = int(notes[-1]) if len(notes) else 0
        if lo or len(notes) and held:
            yield out(_joined([*held, batch.slice(0, lo)]))
            held = [batch.slice(lo)]
        elif len(batch):
            held.append(batch)
    if held:
        yield out(_joined(held))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment_turns: int = SEGMENT) -> DataFrame:
    """Repaired and rendered conversations, piece by piece.

    Returns (conv, turn, step, action, role, rendered): a row for each turn, one
    for each empty turn put in (step 0: before the turn, step 2: after the
    last), and one for the end (step 3); `rendered`, joined in order of turn and
    step, is the conversation in the template. Turns go by turn, a null one
    last, then by role and text, so repeated rows follow each other. Null roles
    and roles that are none of system, user, assistant or their aliases are
    given one; a null text is empty, and a text of any length is taken whole.
    Of repairs that cost the same, that one is taken which has the smaller
    state where they part, seen from the end. A null conversation is one
    like any other. Other columns are ignored; an empty table gives an empty
    one.

    Turns are dealt by ranges. A conversation within one range and one segment
    is repaired there; of any other, segments go by their tables of costs.
    """
    spark = turns.sparkSession
    parts = X.parts_of(spark)
    conv_kind, turn_kind = type_of(turns, conv_col), type_of(turns, turn_col)
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first()]
    # ranges go by the start of a text, so that the sample that bounds them is small; within one, whole texts decide
    ranged = rows.repartitionByRange(parts, *order, F.substring("text", 1, RANGE_CHARS).asc_nulls_first()).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    cuts = settled(ranged.mapInArrow(lean(cutter(segment_turns)), f"conv {conv_kind}, turn {turn_kind}, step int, action string, state int, text string, segment long, place int, costs binary"), "turns")

    # a row for each segment of a conversation that more than one task or segment holds
    tables_ = cuts.where("place = -1").select("conv", "segment", "costs").repartition(parts, "conv").sortWithinPartitions("conv", "segment")
    notes = tables_.mapInArrow(lean(between), "segment long, before int, after int, last boolean")
    none = [F.lit(None).cast(k).alias(c) for c, k in (("conv", conv_kind), ("turn", turn_kind), ("state", "int"), ("text", "string"))]
    noted = notes.select("segment", F.lit(-1).alias("place"), *none, "before", "after", "last")
    loose = cuts.where("place >= 0").select("segment", "place", "conv", "turn", "state", "text", *(F.lit(None).cast(k).alias(c) for c, k in (("before", "int"), ("after", "int"), ("last", "boolean"))))
    dealt = noted.unionByName(loose).repartition(parts, "segment").sortWithinPartitions("segment", "place")
    repaired = dealt.mapInArrow(lean(repair), f"conv {conv_kind}, turn {turn_kind}, step int, action string, state int, text string")
    out = cuts.where("segment is null").select(*repaired.columns).unionByName(repaired)
    return out.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), "step", "action", F.element_at(F.array(*map(F.lit, ROLES)), F.col("state")).alias("role"), F.col("text").alias("rendered"))
