"""Chat formatting by minimum-cost role repair.

Legal conversations are a small automaton: an optional system turn, then user and assistant in turn, ending with the
assistant. Dynamic programming over it chooses, for every turn, to keep, relabel or merge it, and where to insert
empty turns, at least total cost; the repaired conversation is rendered with a template.

The cost of a stretch of turns is a matrix from the state before to the state after, and such matrices combine
(least sums). Turns are range partitioned and sorted; only a conversation that crosses a partition border gets its
matrices combined, one per partition, which fixes its states at the borders. So a conversation of any length is
repaired by as many tasks as its turns fill, and the result is the optimum of the whole.

Defined cases: null and unknown roles may become any role at a low cost; null texts are empty; null conversation ids
are one conversation; turns with equal numbers are ordered by role and text, nulls first; repeated rows are turns of
their own; an empty table gives an empty result; further columns are not looked at.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstone.llm.common import settled

START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ["start", "system", "user", "assistant"]
LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
FAR = 1 << 40
OUT = "conv_id long, turn long, role string, new_role string, action string, inserted int, cost long, rendered string"


@dataclass(frozen=True)
class Costs:
    merge: int = 1
    insert: int = 2
    relabel: int = 3
    name: int = 1  # a role for a turn without a known one


@dataclass(frozen=True)
class Template:
    open: str = "<|{role}|>\n"
    close: str = "<|end|>\n"
    joint: str = "\n\n"


def steps(role: str | None, costs: Costs) -> list[list[tuple]]:
    """For each state before and after a turn: (cost, kind, inserted states); kind 0 follows, 1 merges, 2 is out."""
    out = []
    for s in range(4):
        row = []
        for t in range(4):
            if t == START:
                row.append((FAR, 2, ()))
                continue
            label = 0 if role == NAMES[t] else costs.relabel if role in NAMES[1:] else costs.name
            options = [(label, 0, ())] if (s, t) in LEGAL else []
            options += [(label + costs.merge, 1, ())] if s == t else []
            options += [(label + costs.insert, 0, (x,)) for x in (USER, ASSISTANT) if (s, x) in LEGAL and (x, t) in LEGAL]
            row.append(min(options, default=(FAR, 2, ())))
        out.append(row)
    return out


def ending(state: int, costs: Costs) -> tuple[int, tuple]:
    """Cost and empty turns that bring a conversation in this state to its end."""
    tail = {ASSISTANT: (), USER: (ASSISTANT,), SYSTEM: (USER, ASSISTANT), START: ()}[state]
    return len(tail) * costs.insert, tail


class _Tables:
    def __init__(self, costs: Costs):
        self.costs, self.known = costs, {}

    def __getitem__(self, role):
        if role not in NAMES[1:]:
            role = None
        if role not in self.known:
            table = steps(role, self.costs)
            self.known[role] = table, np.array([[c for c, _, _ in row] for row in table], np.int64)
        return self.known[role]


def stretch(roles: list, tables: _Tables) -> np.ndarray:
    """Least cost from each state before the turns to each state after them."""
    total = np.where(np.eye(4, dtype=bool), 0, FAR)
    for role in roles:
        total = np.minimum((total[:, :, None] + tables[role][1][None]).min(1), FAR)
    return total


def repair(roles: list, entry: int, leave: int | None, tables: _Tables) -> list[tuple]:
    """Per turn (state before, state after, step) of a cheapest way from ``entry`` to ``leave`` (None: to a legal end).

    Among equal costs the way back takes the least state.
    """
    costs = [[0 if s == entry else FAR for s in range(4)]]
    for role in roles:
        table, last = tables[role][0], costs[-1]
        costs.append([min(last[s] + table[s][t][0] for s in range(4)) for t in range(4)])
    state = leave if leave is not None else min(range(1, 4), key=lambda s: (costs[-1][s] + ending(s, tables.costs)[0], s))
    way = []
    for i in range(len(roles) - 1, -1, -1):
        table = tables[roles[i]][0]
        before = min(range(4), key=lambda s: (costs[i][s] + table[s][state][0], s))
        way.append((before, state, table[before][state]))
        state = before
    return way[::-1]


def _runs(batch):
    """(start, stop) of the rows of each conversation in a sorted batch."""
    ids = batch.column("conv_id").to_pylist()
    at = 0
    for i in range(1, len(ids) + 1):
        if i == len(ids) or ids[i] != ids[at]:
            yield ids[at], at, i
            at = i


def _stretches(batches, costs: Costs):
    """Matrices of a partition's first and last conversation: all others are whole in it. A running product: no rows are held."""
    tables, totals, order = _Tables(costs), {}, []
    piece = None
    for batch in batches:
        for conv, a, b in _runs(batch):
            piece = batch.column("piece")[a].as_py()
            part = stretch(batch.column("role").slice(a, b - a).to_pylist(), tables)
            if conv in totals:
                totals[conv] = (totals[conv][:, :, None] + part[None]).min(1)
            else:
                order.append(conv)
                totals[conv] = part
                for old in order[1:-1]:
                    totals.pop(old)
                order = [order[0], *([conv] if len(order) > 1 else [])]
    yield pa.RecordBatch.from_arrays(
        [pa.array(order, pa.int64()), pa.array([piece] * len(order), pa.int64()), pa.array([totals[c].reshape(-1) for c in order], pa.list_(pa.int64()))], ["conv_id", "piece", "matrix"]
    )


def _numbered(batches):
    from pyspark import TaskContext

    piece = TaskContext.get().partitionId()
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([piece] * batch.num_rows, pa.int64())], [*batch.schema.names, "piece"])


def border_states(matrices, costs: Costs) -> dict[tuple, tuple]:
    """(conversation, piece) -> (state before, state after or None at the end) for conversations in several pieces."""
    by_conv: dict = {}
    for conv, piece, matrix in matrices:
        by_conv.setdefault(conv, []).append((piece, np.array(matrix, np.int64).reshape(4, 4)))
    out = {}
    for conv, parts in by_conv.items():
        if len(parts) < 2:
            continue
        parts.sort(key=lambda x: x[0])
        forward = [np.array([0, FAR, FAR, FAR])]
        for _, m in parts:
            forward.append((forward[-1][:, None] + m).min(0))
        state = min(range(1, 4), key=lambda s: (forward[-1][s] + ending(s, costs)[0], s))
        leave = None
        for k in range(len(parts) - 1, -1, -1):
            piece, m = parts[k]
            before = min(range(4), key=lambda s: (int(forward[k][s] + m[s, state]), s))
            out[conv, piece] = (before, leave if leave is None else state)
            state, leave = before, before
        # the last piece may end anywhere legal; the others end where the next begins
    return out


def _rendered(text: str | None, before: int, after: int, step: tuple, template: Template) -> str:
    _, kind, inserted = step
    text = text or ""
    if kind == 1:
        return template.joint + text
    out, state = "", before
    for x in (*inserted, after):
        out += (template.close if state != START else "") + template.open.format(role=NAMES[x])
        state = x
    return out + text


def _repaired(batches, borders: dict, costs: Costs, template: Template, block: int = 4096):
    """Repairs conversations as they come; one that crosses batches is held until its rows in this partition are there."""
    tables = _Tables(costs)

    def done(conv, piece, rows):
        entry, leave = borders.get((conv, piece), (START, None))
        roles = [r[1] for r in rows]
        way = repair(roles, entry, leave, tables)
        out = []
        for k, ((turn, role, text), (before, after, step)) in enumerate(zip(rows, way, strict=True)):
            cost, kind, inserted = step
            shown = _rendered(text, before, after, step, template)
            count = len(inserted)
            if k == len(rows) - 1 and leave is None:
                extra, tail = ending(after, costs)
                cost, count = cost + extra, count + len(tail)
                for x in tail:
                    shown += template.close + template.open.format(role=NAMES[x])
                shown += template.close
            same = role == NAMES[after]
            action = ("merge" if same else "relabel+merge") if kind == 1 else ("keep" if same else "relabel")
            out.append((conv, turn, role, NAMES[after], action, count, cost, shown))
        return out

    names = [x.split()[0] for x in OUT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string()]
    packed = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], names)
    held, key, ready = [], None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("turn", "role", "text")]
        pieces = batch.column("piece").to_pylist()
        for conv, a, b in _runs(batch):
            if key is not None and key[0] != conv:
                ready += done(*key, held)
                held = []
            key = (conv, pieces[a])
            held += list(zip(*(c[a:b] for c in columns), strict=True))
            if len(ready) >= block:
                yield packed(ready)
                ready = []
    if key is not None:
        ready += done(*key, held)
    yield packed(ready)


def repaired_turns(turns: DataFrame, costs: Costs = Costs(), template: Template = Template()) -> DataFrame:  # noqa: B008
    """One row per turn of ``conv_id, turn, role, text``: new role, action, empty turns inserted, cost and rendering.

    The renderings of a conversation's turns, joined in order of turn, are the repaired conversation. Inserted turns
    are rendered with the turn that follows them, or with the last one at the end.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    order = ["conv_id", "turn", "role", "text"]
    sorted_rows = rows.repartitionByRange("conv_id", "turn", "role", F.xxhash64("text")).sortWithinPartitions(*order)
    pieces = settled(sorted_rows.mapInArrow(_numbered, "conv_id long, turn long, role string, text string, piece long"))
    # at most two rows a partition
    edges = pieces.select("conv_id", "role", "piece").mapInArrow(lambda b: _stretches(b, costs), "conv_id long, piece long, matrix array<long>").collect()
    borders = border_states([tuple(r) for r in edges], costs)
    return pieces.mapInArrow(lambda b: _repaired(b, borders, costs, template), OUT)
