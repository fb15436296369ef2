import gzip
import hashlib
import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from wardstone.llm import ann, chat, warc

PAGES = "page_id long, url string, html string"


def archived(rows, least=1000):
    """What the records of pages must be; of equal payloads the greatest page id is the response."""
    payloads = [(h or "").encode() for _, _, h in rows]
    out = []
    for (p, _, _), body in zip(rows, payloads, strict=True):
        best = max((q for (q, _, _), b in zip(rows, payloads, strict=True) if b == body and q is not None), default=None)
        again = len(body) >= least and best is not None and p != best
        out.append((p, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", best if again else None))
    return sorted(out, key=str)


def test_pages_through_archives_and_back(spark):
    big = "<p>" + "x" * 1500 + "é\r\n\r\nWARC/1.1\r\n\n</p>"
    rows = [
        (1, "http://a.org/1", big), (5, "http://a.org/5", big), (3, None, big), (4, "http://b c/\n", "small"), (6, "http://a.org/6", "small"), (7, "http://x/", None), (8, "", ""), (9, "http://y/", "e" * 999),
        (10, "http://y/", "e" * 999), (11, "http://y/", "f" * 1000), (12, "http://y/", "f" * 1000), (13, "http://z/", "long " * 200_000), (None, "http://n/", "g" * 2000),
    ]
    frame = spark.createDataFrame(rows, PAGES).withColumns({"offset": F.lit("mine"), "block": F.lit(1)})
    for version in (1, 2):
        got = warc.archived_pages(frame.repartition(3), version).collect()
        assert sorted((tuple(r) for r in got), key=str) == archived(rows)
    twice = spark.createDataFrame([(1, "u", big), (1, "u", big)], PAGES)
    assert sorted((r.record_type, r.refers_to) for r in warc.archived_pages(twice).collect()) == [("response", None), ("revisit", 1)]
    assert warc.archived_pages(spark.createDataFrame([], PAGES)).collect() == []


def test_archive_files_are_plain_archives(spark, tmp_path):
    rows = [(1, "http://a.org/1", "a" * 1200), (2, "http://a.org/2", "a" * 1200), (3, "http://a.org/3", "b")]
    frame = spark.createDataFrame(rows, PAGES).coalesce(1)
    arc, out = str(tmp_path / "arc"), str(tmp_path / "warc")
    warc.write_arc(frame, arc, 2, "19990102030405")
    records = warc.read_arc(spark, arc)
    warc.convert(records, out)
    data = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "arc").glob("part-*"))
    assert data.startswith(b"filedesc://pages.arc 0.0.0.0 19990102030405 text/plain 200 - - - - ")
    assert [f["URL"] for _, f, _ in warc.arc_records(data)] == [r[1] for r in rows]
    data = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "warc").glob("part-*"))
    fields = [f for f, _ in warc.warc_records(data)]
    assert [f["warc-type"] for f in fields] == ["warcinfo", "revisit", "response", "response"]
    assert fields[1]["warc-refers-to"] == fields[2]["warc-record-id"] and fields[1]["warc-date"] == "1999-01-02T03:04:05Z"
    assert len({f["warc-record-id"] for f in fields}) == 4 and warc.read_warc(spark, out).filter("not intact").count() == 0
    same = [r.record_id for r in warc.read_arc(spark, arc).collect()]
    assert same == [r.record_id for r in records.collect()]


def test_foreign_arc_bytes():
    body = b"\xff\xfe raw \n\n bytes"
    block = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n" + body
    info = b"1 0 origin\nURL IP-address Archive-date Content-type Archive-length\n"
    data = b"filedesc://x.arc 1.1.1.1 1996 text/plain %d\n" % len(info) + info + b"\nhttp://a b/ 1.2.3.4 199609 text/html %d\n" % len(block) + block + b"\n\nhttp://c/ 1.2.3.4 1996 text/plain 3\nabc\n"
    got = list(warc.arc_records(data))
    assert [(f["URL"], b) for _, f, b in got] == [("http://a b/", block), ("http://c/", b"abc")]
    assert warc.http_parts(block) == (len(block) - len(body), {"a": "b"})


def least_cost(roles, costs):
    """Cheapest repair by trying every sequence of roles and ways for the turns."""
    best = math.inf
    for labels in itertools.product((chat.SYSTEM, chat.USER, chat.ASSISTANT), repeat=len(roles)):
        cost = sum(0 if r == chat.NAMES[t] else costs.relabel if r in chat.NAMES[1:] else costs.name for r, t in zip(roles, labels, strict=True))
        state = chat.START
        for t in labels:
            ways = [0] if (state, t) in chat.LEGAL else []
            ways += [costs.merge] if state == t else []
            ways += [costs.insert] if any((state, x) in chat.LEGAL and (x, t) in chat.LEGAL for x in (chat.USER, chat.ASSISTANT)) else []
            cost, state = cost + min(ways, default=math.inf), t
        best = min(best, cost + chat.ending(state, costs)[0])
    return best


def legal(text):
    roles = [line[2:-2] for line in text.split("\n") if line.startswith("<|") and line != "<|end|>"]
    states = [chat.START, *[chat.NAMES.index(r) for r in roles]]
    return all(p in chat.LEGAL for p in itertools.pairwise(states)) and states[-1] == chat.ASSISTANT


def test_repairs_cost_least_and_are_legal(spark):
    rng = random.Random(1)
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", None, "tool"]), rng.choice(["hi", "", None, "x" * 20])))
    rows += [(500, 1, "user", "a"), (500, 1, "user", "a"), (500, None, "assistant", "b"), (None, 1, "user", "c"), (None, 2, None, "d"), (501, 1, "user", "w " * 500_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"piece": F.lit("mine"), "cost": F.lit(1)})
    got = chat.repaired_turns(frame).collect()
    assert len(got) == len(rows)
    costs = chat.Costs()
    for conv in {r[0] for r in rows}:
        key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "")
        roles = [r[2] for r in sorted((r for r in rows if r[0] == conv), key=key)]
        mine = [r for r in got if r.conv_id == conv]
        assert sum(r.cost for r in mine) == least_cost(roles, costs)
        mine.sort(key=lambda r: key((r.conv_id, r.turn, r.role)))
        if len({(r.turn, r.role) for r in mine}) == len(mine):
            assert legal("".join(r.rendered for r in mine))


def test_long_conversations_are_repaired_in_pieces(spark):
    rng = random.Random(2)
    roles = [rng.choice(["user", "assistant", "system", None]) for _ in range(3000)]
    rows = [(1, i, r, f"t{i}") for i, r in enumerate(roles)] + [(2, i, "user", "x") for i in range(3)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.repaired_turns(frame).orderBy("conv_id", "turn").collect()
    tables = chat._Tables(chat.Costs())
    way = chat.repair(roles, chat.START, None, tables)
    whole = sum(step[0] for _, _, step in way) + chat.ending(way[-1][1], chat.Costs())[0]
    mine = [r for r in got if r.conv_id == 1]
    assert sum(r.cost for r in mine) == whole and legal("".join(r.rendered for r in mine))
    assert [r.action for r in got if r.conv_id == 2] == ["keep", "merge", "merge"]
    assert chat.repaired_turns(frame.limit(0)).collect() == []


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((10, 16))
    vectors = centers[rng.integers(0, 10, 3000)] + 0.8 * rng.standard_normal((3000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(9000 + i, vectors[7].tolist()) for i in range(200)]
    odd = [(20000, None), (20020, []), (20040, [0.0] * 16), (20060, [float("nan")] * 16), (20080, [1.0, float("inf")] + [0.0] * 14), (20100, [None, *[1.0] * 15]), (None, [1.0] * 16), (20120, [1.0, 2.0]), (20140, [3.0, 4.0])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("ids", F.lit("mine"))
    got = ann.nearest(frame, frame.filter("vec_id % 20 = 0"), shard_rows=700, block_rows=64).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert {q for q in by} == {i for i, _ in rows if i % 20 == 0} | {20120, 20140}
    every, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    hit = total = 0
    for q, found in by.items():
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, len(found) + 1)) and q not in {r.vec_id for r in found}
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        if q in (20120, 20140):
            assert [(r.vec_id, r.score) for r in found] == [(40260 - q, 11.0)]
            continue
        scores = every @ every[np.flatnonzero(ids == q)[0]]
        order = [i for i in np.lexsort((ids, -np.round(scores, 9))) if ids[i] != q][:20]
        assert len(found) == 20
        for r in found:
            assert abs(r.score - scores[np.flatnonzero(ids == r.vec_id)[0]]) < 1e-9
        hit += len({int(ids[i]) for i in order} & {r.vec_id for r in found})
        total += 20
    assert hit >= 0.95 * total
    assert ann.nearest(frame.limit(0), frame.limit(0)).collect() == []
