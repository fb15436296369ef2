"""Conversation structure repair: a cost DP, then the least audit by prefix doubling over the arcs it leaves.

A conversation's rows are kept, given another role or deleted, and empty turns are inserted, at least cost, until the
initials of its roles read ``(s?(ua)+)?``. States of that pattern are nothing yet, after s, after u and after a; a node is a
state before a row. The DP runs backwards and gives every node its cost to go; arcs that lose nothing are optimal. Of all
cheapest repairs the one whose audit (initials of its edits) is least in ASCII is taken: nodes are ranked by the first 1, 2,
4, ... edits of their least audits, the next rank from a node's own rank and that of the node its doubled pointer leads to.
An edit leads from a node to one other only, so a rank has one pointer; the arc is taken whose edit, then whose target's
rank, is least, and the path is read off the doubled pointers.

Rows are range partitioned and sorted, so a conversation of any length fills as many tasks as its rows do. One that lies
in several partitions is settled by small tables: a 4 x 4 matrix of costs for each of its pieces (two a partition at most)
gives the costs to go at their borders, and with these each piece says in which state it leaves from each state. Its pieces
then send what they repaired in blocks to the task that hashes the whole, which holds one block at a time: a digest takes its
bytes in order. First occurrences are found by a grouping with partial sums.

Defined cases: null texts and roles are one space, and so are null ids and turns in the key of the damage; null ids are one
conversation; null turns come first; rows with equal turns follow each other by role, the text's first 64 characters and
its digest; repeated rows are rows of their own, told apart by their place in the table; an empty table gives an empty
result; further columns are not looked at.
"""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstone.llm.common import settled, small_side

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 40
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
EDITS = "DIKR"
GOAL = (NOTHING, ASSISTANT)
#: The state after a turn with this initial, from each state; -1: not legal there.
AFTER = {"s": (SYSTEM, -1, -1, -1), "u": (USER, USER, -1, USER), "a": (-1, -1, ASSISTANT, -1)}
#: The turn that may be inserted in each state, and that a row may be given the role of.
NEXT = ("u", "u", "a", "u")
ROLES = {"u": "user", "a": "assistant"}
WORDED = re.compile(r"[^\x20\x09-\x0D]")
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
LEGAL = {"su", "ua", "au"}
BLOCK = 1 << 20
OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


# --- damage --------------------------------------------------------------------------------------


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone, at, copy``: dropped rows stay as ``gone``, so that no conversation is lost."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key) % 20
    text, role = (F.coalesce(F.col(c).cast("string"), space) for c in ("text", "role"))
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"),
        F.monotonically_increasing_id().alias("at"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def as_given(turns: DataFrame) -> DataFrame:
    """Rows without any damage, in the same form."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("text", "role"))
    ids = [F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")]
    return turns.select(*ids, role, text, F.lit(False).alias("gone"), F.monotonically_increasing_id().alias("at"), F.lit(0).alias("copy"))


def with_first_seen(rows: DataFrame) -> DataFrame:
    """Rows with ``again``: an earlier row of the conversation has the same role and text."""
    rows = rows.withColumn("digest", F.sha2(F.concat_ws("\x1f", F.length("role").cast("string"), "role", "text"), 256))
    place = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", "at", "copy")
    seen = rows.filter("not gone").groupBy("conv_id", "digest").agg(F.min(place).alias("first"), F.count("*").alias("times")).filter("times > 1")
    seen = seen.select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "first")
    joined = rows.join(small_side(seen), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")), "left")
    later = F.col("first").isNotNull() & ~((F.col("first.at") == F.col("at")) & (F.col("first.copy") == F.col("copy")))
    return joined.withColumn("again", later & ~F.col("gone")).drop("_conv", "_digest", "first")


# --- costs and ranks -----------------------------------------------------------------------------


def fault(text: str, again: bool) -> str:
    if not WORDED.search(text):
        return "blank"
    if again:
        return "duplicate"
    return "" if text.rstrip(SPACES)[-1] in ".!?" else "truncated"


def arcs(initial: str, found: str) -> list[list[tuple[int, str, int]]]:
    """For each state before a row with this initial and fault: (cost, edit, state after)."""
    more = TRUNCATED if found == "truncated" else 0
    out = []
    for state in range(4):
        ways = [(DELETE, "D", state)]
        if found not in ("blank", "duplicate"):
            kept = AFTER.get(initial, (-1,) * 4)[state]
            ways += [(KEEP + more, "K", kept)] if kept >= 0 else []
            ways.append((REROLE + more, "R", AFTER[NEXT[state]][state]))
        out.append(ways)
    return out


INSERTS = [(INSERT, "I", AFTER[NEXT[state]][state]) for state in range(4)]
#: A state's cost of reaching another one by insertions alone.
BETWEEN = np.full((4, 4), FAR, np.int64)
for _s in range(4):
    _t, _cost = _s, 0
    while BETWEEN[_s, _t] > _cost:
        BETWEEN[_s, _t] = _cost
        _cost, _t = _cost + INSERT, INSERTS[_t][2]
ENDS = np.array([min(int(BETWEEN[s, g]) for g in GOAL) for s in range(4)], np.int64)


class Tables:
    """Arcs of every kind of row, made once a task."""

    def __init__(self):
        self.known: dict = {}

    def __getitem__(self, kind: tuple[str, str]):
        if kind not in self.known:
            ways = arcs(*kind)
            step = np.full((4, 4), FAR, np.int64)
            for state, options in enumerate(ways):
                for cost, _, after in options:
                    step[state, after] = min(step[state, after], cost)
            full = (BETWEEN[:, :, None] + step[None]).min(1)
            self.known[kind] = ways, np.minimum(full, FAR)
        return self.known[kind]


def matrix(kinds: list[tuple[str, str]], tables: Tables) -> np.ndarray:
    """Least cost from each state before the rows to each state after the last of them, insertions before rows included."""
    total = np.where(np.eye(4, dtype=bool), 0, FAR)
    for kind in kinds:
        total = np.minimum((total[:, :, None] + tables[kind][1][None]).min(1), FAR)
    return total


def costs_to_go(kinds: list[tuple[str, str]], end: np.ndarray, tables: Tables) -> np.ndarray:
    """Cost to go of each state before each row and after the last, where ``end`` is to be paid."""
    out = np.empty((len(kinds) + 1, 4), np.int64)
    out[-1] = end
    for i in range(len(kinds) - 1, -1, -1):
        out[i] = np.minimum((tables[kinds[i]][1] + out[i + 1][None]).min(1), FAR)
    return out


def optimal_arcs(kinds: list[tuple[str, str]], go: np.ndarray, tables: Tables, last: bool) -> list[tuple[int, int, int]]:
    """(node, edit, target) of arcs that lose nothing; node 4 * i + state is before row i. In the last piece of a conversation
    insertions may follow its rows; in others the next piece makes them."""
    out = []
    for i in range(len(kinds) + last):
        for state in range(4):
            value = int(go[i, state])
            if value >= FAR:
                continue
            cost, _, after = INSERTS[state]
            if cost + int(go[i, after]) == value:
                out.append((4 * i + state, EDITS.index("I"), 4 * i + after))
            if i < len(kinds):
                out += [(4 * i + state, EDITS.index(edit), 4 * i + 4 + to) for cost, edit, to in tables[kinds[i]][0][state] if cost + int(go[i + 1, to]) == value]
    return out


def doubled(found: list[tuple[int, int, int]], nodes: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each node the edit of its least audit (-1: none follows), and pointers 1, 2, 4, ... edits on.

    A node without an arc points to itself and ranks before any edit, so audits that end are less than those that go on.
    """
    source, edit, target = (np.array([a[k] for a in found], np.int64) for k in range(3))
    rank = np.zeros(nodes, np.int64)
    step = np.arange(nodes)
    label = np.full(nodes, -1, np.int64)
    order = np.lexsort((target, edit, source))[::-1]
    label[source[order]], step[source[order]] = edit[order], target[order]  # of a node's arcs the one with the least edit
    rank = label + 1
    pointers = [step]
    while not np.array_equal(pointers[-1], pointers[-1][pointers[-1]]):
        jump = pointers[-1]
        rank = np.unique(rank * (int(rank.max()) + 1) + rank[jump], return_inverse=True)[1]
        pointers.append(jump[jump])
    # the ranks of whole audits decide between a node's arcs
    order = np.lexsort((rank[target], edit, source))[::-1]
    label[source[order]], step = edit[order], step.copy()
    step[source[order]] = target[order]
    if not np.array_equal(step, pointers[0]):
        raise AssertionError("an edit leads from a node to two others")
    return label, pointers


def least_path(start: np.ndarray, pointers: list[np.ndarray]) -> list[np.ndarray]:
    """Nodes of the least paths from some nodes, each up to its end: the j-th is found by the pointers of j's binary digits."""
    reach = 1 << len(pointers)
    last = np.array(start)
    length = np.zeros(len(start), np.int64)
    for k in range(len(pointers) - 1, -1, -1):
        to = pointers[k][last]
        go = pointers[0][to] != to  # the path goes on beyond
        length[go] += 1 << k
        last = np.where(go, to, last)
    length += pointers[0][last] != last
    if int(length.max(initial=0)) >= reach:
        raise AssertionError("pointers too short")
    of = np.repeat(np.arange(len(start)), length + 1)
    first = np.cumsum(np.concatenate([[0], length + 1]))
    j = np.arange(len(of)) - first[of]
    node = np.array(start)[of]
    for k, pointer in enumerate(pointers):
        node = np.where(j >> k & 1, pointer[node], node)
    return np.split(node, first[1:-1])


# --- pieces --------------------------------------------------------------------------------------


def _numbered(batches):
    from pyspark import TaskContext

    piece = TaskContext.get().partitionId()
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([piece] * batch.num_rows, pa.int64())], [*batch.schema.names, "piece"])


def _conversations(batches) -> Iterator[tuple]:
    """(conv_id, piece, rows) of a sorted partition; rows are (turn, role, text, again) without dropped ones."""
    key, rows = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "piece", "turn", "role", "text", "again", "gone")]
        for conv, piece, turn, role, text, again, gone in zip(*columns, strict=True):
            if key is None or key[0] != conv:
                if key is not None:
                    yield *key, rows
                key, rows = (conv, piece), []
            if not gone:
                rows.append((turn, role, text, again))
    if key is not None:
        yield *key, rows


def _kinds(rows: list[tuple]) -> list[tuple[str, str]]:
    return [(role[:1], fault(text, again)) for _, role, text, again in rows]


def _edges(batches):
    """Cost matrices of a partition's first and last conversation: the others are whole in it."""
    ends: list[tuple] = []
    for item in _conversations(batches):
        ends = [*ends[:1], item]
    tables = Tables()
    out = [(conv, piece, matrix(_kinds(rows), tables).reshape(-1)) for conv, piece, rows in ends]
    columns = [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.list_(pa.int64()))]
    yield pa.RecordBatch.from_arrays(columns, ["conv_id", "piece", "matrix"])


def border_costs(edges: list[tuple]) -> dict[tuple, tuple[np.ndarray, bool]]:
    """(conversation, piece) -> costs to go after it, and whether it is the last, for conversations in several pieces."""
    by_conv: dict = {}
    for conv, piece, flat in edges:
        by_conv.setdefault(conv, []).append((piece, np.array(flat, np.int64).reshape(4, 4)))
    out = {}
    for conv, parts in by_conv.items():
        if len(parts) > 1:
            end = ENDS
            for k, (piece, m) in enumerate(sorted(parts, key=lambda x: -x[0])):
                out[conv, piece] = (end, k == 0)
                end = np.minimum((m + end[None]).min(1), FAR)
    return out


def _exits(batches, borders: dict):
    """For pieces of conversations in several partitions: the state after them from each state before."""
    tables, out = Tables(), []
    for conv, piece, rows in _conversations(batches):
        if (conv, piece) in borders:
            end, last = borders[conv, piece]
            kinds = _kinds(rows)
            go = costs_to_go(kinds, end, tables)
            _, pointers = doubled(optimal_arcs(kinds, go, tables, last), 4 * len(kinds) + 4)
            out.append((conv, piece, [int(pointers[-1][s] % 4) for s in range(4)]))
    columns = [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.list_(pa.int32()))]
    yield pa.RecordBatch.from_arrays(columns, ["conv_id", "piece", "leaves"])


def entry_states(exits: list[tuple]) -> dict[tuple, int]:
    by_conv: dict = {}
    for conv, piece, leaves in exits:
        by_conv.setdefault(conv, []).append((piece, leaves))
    out = {}
    for conv, parts in by_conv.items():
        state = NOTHING
        for piece, leaves in sorted(parts):
            out[conv, piece] = state
            state = leaves[state]
    return out


def repaired_lines(rows: list[tuple], path: list[int], label: np.ndarray) -> tuple[str, list[str]]:
    """The audit along a path of nodes, and the lines it gives."""
    audit, lines = [], []
    for node in path:
        if label[node] < 0:
            break
        edit, (i, state) = EDITS[label[node]], divmod(int(node), 4)
        audit.append(edit)
        if edit == "I":
            lines.append(ROLES[NEXT[state]] + ":")
        elif edit == "K":
            lines.append(f"{rows[i][1]}:{rows[i][2]}")
        elif edit == "R":
            lines.append(f"{ROLES[NEXT[state]]}:{rows[i][2]}")
    return "".join(audit), lines


def counts(rows: list[tuple], kinds: list[tuple[str, str]]) -> tuple:
    """(faults, illegal pairs, first and last turn and initial, different turns) of rows in order; no row: None for the ends."""
    turns = [t for t, *_ in rows if t is not None]
    faults = [sum(f == name for _, f in kinds) for name in ("blank", "duplicate", "truncated")]
    illegal = sum(a + b not in LEGAL for (a, _), (b, _) in zip(kinds, kinds[1:], strict=False))
    return *faults, illegal, min(turns, default=None), max(turns, default=None), len(set(turns)), *((kinds[0][0], kinds[-1][0]) if kinds else (None, None))


PARTS = "conv_id long, piece long, block int, blank long, duplicate long, truncated long, illegal long, low long, high long, turns long, first string, last string, cost long, audit string, lines long, body binary, whole boolean"
PART_KINDS = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 7, pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.bool_()]


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(PART_KINDS)], [c.split()[0] for c in PARTS.split(", ")])


def _repaired(batches, borders: dict, entries: dict, hold: int = 2048):
    """What each conversation or piece comes to. Conversations that lie in one partition are done in groups: one doubling for all
    their nodes; for these ``body`` is the digest. Pieces of others give their lines in blocks."""
    tables = Tables()

    def done(group: list[tuple]) -> Iterator[tuple]:
        found, start, at, parts = [], [], 0, []
        for conv, piece, rows in group:
            kinds = _kinds(rows)
            end, last = borders.get((conv, piece), (ENDS, True))
            go = costs_to_go(kinds, end, tables)
            state = entries.get((conv, piece), NOTHING)
            found += [(a + at, e, b + at) for a, e, b in optimal_arcs(kinds, go, tables, last)]
            start.append(at + state)
            parts.append((conv, piece, rows, kinds, int(go[0, state]) if state == NOTHING and piece == first_piece(conv, piece) else 0, at))
            at += 4 * len(kinds) + 4
        label, pointers = doubled(found, at)
        for (conv, piece, rows, kinds, cost, base), path in zip(parts, least_path(np.array(start), pointers), strict=True):
            audit, lines = repaired_lines(rows, [n - base for n in path], label[base : base + 4 * len(kinds) + 4])
            head = (conv, piece)
            stats = (*counts(rows, kinds), cost)
            if (conv, piece) not in borders:
                yield *head, 0, *stats, audit, len(lines), hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).digest(), True
                continue
            block, size, k = [], 0, 0
            for line in [*lines, None]:
                if line is None or size > BLOCK:
                    yield *head, k, *(stats if k == 0 else (0, 0, 0, 0, None, None, 0, None, None, 0)), audit if k == 0 else "", len(block), "\n".join(block).encode("utf-8", "surrogatepass"), False
                    block, size, k = [], 0, k + 1
                if line is not None:
                    block.append(line)
                    size += len(line)

    opening: dict = {}
    for conv, piece in borders:
        opening[conv] = min(piece, opening.get(conv, piece))
    first_piece = lambda conv, piece: opening.get(conv, piece)
    group, size, ready = [], 0, []
    for item in _conversations(batches):
        group.append(item)
        size += len(item[2]) + 1
        if size >= hold:
            for part in done(group):
                ready.append(part)
                if sum(len(p[-2]) for p in ready[-1:]) > BLOCK // 2 or len(ready) >= hold:
                    yield _packed(ready)
                    ready = []
            group, size = [], 0
    ready += done(group) if group else []
    yield _packed(ready)


def _joined(batches):
    """Results of conversations in several pieces from their parts in order; holds one batch of blocks at a time."""
    state: dict | None = None
    out: list[tuple] = []

    def close(s: dict) -> tuple:
        gaps = 0 if s["low"] is None else s["high"] - s["low"] + 1 - s["turns"]
        return s["conv"], gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], s["cost"], "".join(s["audit"]), s["hash"].hexdigest()

    for batch in batches:
        for r in batch.to_pylist():
            if state is None or state["conv"] != r["conv_id"]:
                if state is not None:
                    out.append(close(state))
                state = {"conv": r["conv_id"], "low": None, "high": None, "turns": 0, "last": None, "hash": hashlib.sha256(), "lines": 0, "audit": []} | dict.fromkeys(["blank", "duplicate", "truncated", "illegal", "cost"], 0)
            for c in ("blank", "duplicate", "truncated", "illegal", "cost"):
                state[c] += r[c]
            if r["first"] is not None:
                state["illegal"] += state["last"] is not None and state["last"] + r["first"] not in LEGAL
                state["last"] = r["last"]
            if r["low"] is not None:
                state["turns"] += r["turns"] - (state["high"] == r["low"])  # rows are in order of turn
                state["low"], state["high"] = r["low"] if state["low"] is None else state["low"], r["high"]
            state["audit"].append(r["audit"])
            if r["lines"]:
                state["hash"].update((b"\n" if state["lines"] else b"") + r["body"])
                state["lines"] += r["lines"]
        if len(out) >= 4096:
            yield _results(out)
            out = []
    yield _results([*out, *([close(state)] if state is not None else [])])


def _results(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [*[pa.int64()] * 7, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], [c.split()[0] for c in OUT.split(", ")])


def repaired(rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``damaged`` or ``as_given`` rows: faults, least cost, audit and digest of the repair."""
    marked = with_first_seen(rows).withColumn("opening", F.substring("text", 1, 64))
    order = ["conv_id", "turn", "role", "opening", "digest", "at", "copy"]
    columns = ["conv_id", "turn", "role", "text", "again", "gone"]
    in_order = marked.repartitionByRange(*order).sortWithinPartitions(*order).select(*columns)
    kinds = "conv_id long, turn long, role string, text string, again boolean, gone boolean"
    pieces = settled(in_order.mapInArrow(_numbered, f"{kinds}, piece long"))
    # two rows a partition at most
    edges = pieces.mapInArrow(_edges, "conv_id long, piece long, matrix array<long>").collect()
    borders = border_costs([tuple(r) for r in edges])
    entries = {}
    if borders:
        leaving = pieces.mapInArrow(lambda b: _exits(b, borders), "conv_id long, piece long, leaves array<int>").collect()
        entries = entry_states([tuple(r) for r in leaving])
    parts = settled(pieces.mapInArrow(lambda b: _repaired(b, borders, entries), PARTS))
    place = ["conv_id", "piece", "block"]
    split = parts.filter("not whole").repartition("conv_id").sortWithinPartitions(*place)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    whole = parts.filter("whole").select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.lower(F.hex("body")).alias("repaired_sha256"))
    return whole.unionByName(split.mapInArrow(_joined, OUT))
