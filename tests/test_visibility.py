"""Sets of pools against a loop over every node and request."""

import datetime as dt
import random

from pyspark.sql import functions as F

from wardstone.functions import filters as FL
from wardstone.operators import visibility
from wardstone.operators.access import make_pools
from wardstone.operators.visibility import _intervals, _pool_numbers, visible_nodes, visible_sizes

NODE = {c: c for c in ("source", "mime_type", "doc_id", "tags", "folder_path", "folder_ancestors", "modified_time")}
SCHEMA = "node_id string, doc_id string, source string, mime_type string, tags array<string>, folder_path string, folder_ancestors array<string>, modified_time timestamp, signature array<string>"


def drawn(seed, nodes, requests):
    rnd = random.Random(seed)
    day = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(days=rnd.randrange(40), microseconds=rnd.choice([0, 1, 999_999]))
    some = lambda values, k: rnd.sample(values, rnd.randint(0, k))
    folders = [None, "a", "a/b", "c"]
    above = {None: None, "a": ["a"], "a/b": ["a", "a/b"], "c": ["c"]}
    rows = []
    for i in range(nodes):
        folder = rnd.choice(folders)
        rows.append((f"n{i}", f"d{i % 17}", rnd.choice(["drive", "local", None]), rnd.choice(["pdf", "txt"]), rnd.choice([None, some(["x", "y", "z"], 2)]), folder, above[folder], rnd.choice([None, day()]), rnd.choice([["*"], ["g:1"], ["g:1", "g:2"], ["e:a"], [], None])))
    asked = []
    for i in range(requests):
        ends = sorted([day(), day()])
        flt = None if rnd.random() < 0.2 else (some(["drive", " local "], 1), some(["pdf", "txt"], 1), some(["d1", "d2", "d3"], 1) if rnd.random() < 0.3 else [], some(["x", "y"], 2), some(["a", "/c/", "a/b"], 1), [], rnd.choice([None, ends[0]]), rnd.choice([None, ends[1]]))
        asked.append((f"q{i}", ["*", *some(["g:1", "g:2", "e:a"], 2)] if rnd.random() < 0.9 else [], flt))
    return rows, asked


def pairs(seen, pooled):
    pool = {}
    for r in pooled.collect():
        pool.setdefault(r.pool_id, []).append(r.query_id)
    got = [(q, n) for p, n in ((r.pool_id, r.node_id) for r in seen.pairs("node_id").collect()) for q in pool[p]]
    assert len(got) == len(set(got))
    return set(got)


def test_sets_against_every_pair(spark):
    rows, asked = drawn(3, 150, 90)
    nodes = spark.createDataFrame(rows, SCHEMA)
    requests = spark.createDataFrame(asked, f"query_id string, tokens array<string>, filters {FL.FILTER_TYPE}")
    both = nodes.crossJoin(requests)
    held = F.coalesce(F.arrays_overlap("signature", "tokens"), F.lit(False))
    pooled = make_pools(requests)
    seen = visible_nodes(nodes, pooled, NODE)
    want = {(r.query_id, r.node_id) for r in both.filter(held & FL.metadata_filter(F.col("filters"), NODE)).select("query_id", "node_id").collect()}
    assert len(want) > 500 and pairs(seen, pooled) == want and seen.access is None
    assert seen.nodes.count() == len({n for _, n in want}) and seen.nodes.columns == [*nodes.columns, "set_id"]
    open_pools = make_pools(requests.drop("filters"))
    plain = visible_nodes(nodes, open_pools)
    assert pairs(plain, open_pools) == {(r.query_id, r.node_id) for r in both.filter(held).select("query_id", "node_id").collect()}
    per_set = {}
    for r in plain.pools.collect():
        per_set.setdefault(r.set_id, set()).add(r.pool_id)
    assert len({frozenset(v) for v in per_set.values()}) == len(per_set)  # equal sets are one
    for none in (visible_nodes(nodes, pooled.limit(0), NODE), visible_nodes(nodes.limit(0), pooled, NODE), visible_nodes(nodes, open_pools.limit(0))):
        assert none.nodes.isEmpty() and none.pools.isEmpty()


def test_counts_against_every_pair_and_without_sets(spark, monkeypatch):
    rows, asked = drawn(5, 150, 90)
    nodes = spark.createDataFrame(rows, SCHEMA)
    requests = spark.createDataFrame(asked, f"query_id string, tokens array<string>, filters {FL.FILTER_TYPE}")
    held = F.coalesce(F.arrays_overlap("signature", "tokens"), F.lit(False))
    want = dict(map(tuple, nodes.crossJoin(requests).filter(held & FL.metadata_filter(F.col("filters"), NODE)).groupBy("query_id").count().collect()))
    # requests that each name a document of their own: sets of pools would differ by node and each list the pools of the others
    monkeypatch.setattr(visibility, "_numbered_sets", None)
    pooled = make_pools(requests)
    got = {r.query_id: r.n for r in pooled.join(visible_sizes(nodes, pooled, NODE), "pool_id").collect()}
    assert got == want and len(want) > 50
    own = spark.range(3000).select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("query_id"), F.array(F.lit("*")).alias("tokens"), F.concat(F.lit("d"), F.col("id").cast("string")).alias("d"))
    own = make_pools(own.withColumn("filters", F.from_json(F.to_json(F.struct(F.array("d").alias("doc_ids"))), FL.FILTER_TYPE)))
    some = spark.range(0, 6000, 2).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("doc_id"), F.array(F.lit("*")).alias("signature"))
    assert dict(map(tuple, own.join(visible_sizes(some, own, {"doc_id": "doc_id"}), "pool_id").select("d", "n").collect())) == {f"d{i}": 1 for i in range(0, 3000, 2)}
    for none in (visible_sizes(nodes, pooled.limit(0), NODE), visible_sizes(nodes.limit(0), pooled, NODE)):
        assert none.isEmpty()


def test_more_pools_than_one_bitmap_holds(spark):
    requests = spark.range(70_000).select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("query_id"), F.array(F.concat(F.lit("u:"), F.col("id").cast("string")), F.lit("*")).alias("tokens"))
    nodes = spark.createDataFrame([("all", ["*"]), ("one", ["u:69999"]), ("two", ["u:5", "u:40000"]), ("none", ["u:x"])], "node_id string, signature array<string>")
    seen = visible_nodes(nodes, make_pools(requests))
    assert dict(map(tuple, seen.pairs("node_id").groupBy("node_id").count().collect())) == {"all": 70_000, "one": 1, "two": 2}


def test_bits_and_aligned_intervals(spark):
    numbers = [1, 8, 9, 512, 513, 32768, 32769, 65000]
    made = spark.createDataFrame([(n,) for n in numbers], "n long").groupBy(F.bitmap_bucket_number("n").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits"))
    assert sorted(r[0] for r in made.select(F.explode(_pool_numbers(F.col("b"), F.col("bits")))).collect()) == numbers
    rnd = random.Random(1)
    spans = [(0, 0), (0, 1), (5, 5), (7, 4), (0, (1 << 63) - 1), (1, (1 << 63) - 2)] + [tuple(sorted(rnd.randrange(200) for _ in "ab")) for _ in range(60)]
    got = spark.createDataFrame(spans, "a long, b long").select("a", "b", _intervals(F.col("a"), F.col("b")).alias("cells")).collect()
    for a, b, cells in got:
        found = [(int(n) << int(k), (int(n) + 1 << int(k)) - 1) for k, n in (c.split(":") for c in cells)]
        assert sum(y - x + 1 for x, y in found) == max(0, b - a + 1)
        if found:
            assert min(x for x, _ in found) == a and max(y for _, y in found) == b
