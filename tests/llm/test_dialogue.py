import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardstone.llm import dialogue as D

TURNS = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]")
GOAL = re.compile(r"(s?(ua)+)?")


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    out, seen = [], set()
    for _, _, role, text in rows:
        words = WORD.findall(text)
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "" if words[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, lines) by trying every edit at every place, from what has been put out so far (its last initial)."""

    def legal(last, new):
        return last + new in {"s", "u", "su", "ua", "au"}

    @lru_cache(None)
    def best(i, last, inserted):
        ways = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        if i < len(rows):
            _, _, role, text = rows[i]
            more = found[i] == "truncated"
            options = [(3, "D", None)]
            if found[i] not in ("blank", "duplicate"):
                options += [(0 + more, "K", role), (2 + more, "R", "user"), (2 + more, "R", "assistant")]
            for cost, edit, new in options:
                if new is None or (new and legal(last, new[0])):
                    rest = best(i + 1, last if new is None else new[0], 0)
                    ways.append((cost + rest[0], edit + rest[1], ((f"{new}:{text}",) if new else ()) + rest[2]))
        if inserted < 3:
            for new in ("user", "assistant"):
                if legal(last, new[0]):
                    rest = best(i, new[0], inserted + 1)
                    ways.append((2 + rest[0], "I" + rest[1], (f"{new}:", *rest[2])))
        return min(ways, default=(10**9, "", ()))

    return best(0, "", 0)


def plain(rows, damage=True):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == conv]
        mine = after_damage(mine) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in mine]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        found = faults(mine)
        turns = [t for _, t, _, _ in mine if t is not None]
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(mine, mine[1:], strict=False)]
        cost, audit, lines = cheapest(mine, found)
        assert GOAL.fullmatch("".join(line[0] for line in lines))
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def got(frame):
    rows = frame.collect()
    out = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows) and frame.columns == [c.split()[0] for c in D.OUT.split(", ")]
    return out


def drawn(seed, convs, longest):
    draw = random.Random(seed)
    texts = ["hi.", "hi", "", " \t", "No!", "why?", "é.", "x. ", "ok", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, ""]
    rows = []
    for conv in range(convs):
        turn = draw.randrange(3)
        for _ in range(draw.randrange(1, longest)):
            rows.append((conv, turn, draw.choice(roles), draw.choice(texts) if draw.random() < 0.5 else f"text {draw.randrange(100)}."))
            turn += draw.choice([1, 1, 1, 2, 4])
    return rows


@pytest.mark.parametrize("damage", [True, False])
def test_repairs_against_every_edit(spark, damage):
    rows = drawn(4 + damage, 250, 9) + [(None, None, "user", "a?"), (None, 1, None, None), (None, 2, "assistant", "b.")]
    frame = spark.createDataFrame(rows, TURNS).withColumns({"digest": F.lit(1), "copy": F.lit("x"), "piece": F.lit(2)}).repartition(4)
    found = got(D.repaired(D.damaged(frame) if damage else D.as_given(frame)))
    assert found == plain(rows, damage)


def test_one_long_conversation_over_many_partitions(spark):
    rows = [(7, t, r, x) for _, t, r, x in drawn(9, 1, 2)] + [(7, 10 + i, *random.Random(i).choice([("user", "same."), ("assistant", "same."), ("assistant", f"n {i}"), ("user", "")])) for i in range(400)]
    rows += [(8, 1, "user", "q?"), (8, 2, "assistant", "a.")] + [(6, t, "assistant", "z.") for t in range(30)]
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = got(D.repaired(D.damaged(spark.createDataFrame(rows, TURNS))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert found == plain(rows)


def test_repeated_rows_empty_tables_and_dropped_conversations(spark):
    rows = [(1, 0, "user", "again.")] * 40 + [(1, 1, "assistant", "yes. " * 100_000)] + [(2, None, "user", "a."), (2, None, "user", "b."), (2, None, "assistant", "c.")]
    assert got(D.repaired(D.as_given(spark.createDataFrame(rows, TURNS)))) == plain(rows, False)
    assert D.repaired(D.damaged(spark.createDataFrame([], TURNS))).collect() == []
    gone = [(c, t, "user", "x.") for c in range(60) for t in (0, 1) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    assert gone
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got(D.repaired(D.damaged(spark.createDataFrame(gone, TURNS)))) == {c: empty for c, *_ in gone}


def test_ranks_order_whole_audits():
    tables = D.Tables()
    draw = random.Random(2)
    for _ in range(40):
        kinds = [(draw.choice("suat"), draw.choice(["", "", "blank", "truncated"])) for _ in range(draw.randrange(0, 12))]
        go = D.costs_to_go(kinds, D.ENDS, tables)
        found = D.optimal_arcs(kinds, go, tables, True)
        label, pointers = D.doubled(found, 4 * len(kinds) + 4)
        ways = {}
        for a, e, b in found:
            ways.setdefault(a, []).append((D.EDITS[e], b))

        def least(node):
            return min((e + least(b) for e, b in ways.get(node, [])), default="")

        (path,) = D.least_path(np.array([D.NOTHING]), pointers)
        assert "".join(D.EDITS[label[n]] for n in path if label[n] >= 0) == least(D.NOTHING)
