import binascii
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, WORDS, docs
from wardstone.llm.mixing import mix, mixed_documents
from wardstone.llm.sharding import shard_documents

ROWS = (
    [(i, "w " * (1 + i % 7), "big") for i in range(300)]
    + [(1000 + i, f"x{i} y", "small") for i in range(5)]
    + [(None, "no id here", None), (7, None, "big"), (8, "", "nulls"), (9, " \t", "nulls"), (2000, "long " * 5000, None), (3, "w " * 4, "big"), (3, "w " * 4, "big")]
)


def filled(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Round after round: share out by weight, clamp, reshare what is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    left, open_ = share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        for s in list(open_):
            target[s] += left * w[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_.discard(s)
    return target


def test_targets_and_taken_words(spark):
    table = docs(spark, ROWS)
    got = mix(table).collect()
    assert len(got) == len(ROWS)
    assert sorted((r.doc_id is None, r.doc_id, r.size) for r in got) == sorted((d is None, d, len(WORDS.findall(t or ""))) for d, t, _ in ROWS)
    sizes = Counter()
    for _, t, s in ROWS:
        sizes[s] += len(WORDS.findall(t or ""))
    want = filled(sizes)
    by_size = {n: s for s, n in sizes.items()}
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        s = by_size[r.source_size]
        assert abs(r.target - want[s]) < 1e-6
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    again = mix(table.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_repetitions_keep_columns_and_clashing_names(spark):
    table = docs(spark, ROWS).withColumns({"_size": F.lit("mine"), "taken": F.lit(1), "_order": F.lit(2)})
    out = mixed_documents(table)
    assert out.columns == table.columns
    rows = out.collect()
    words = Counter()
    for r in rows:
        assert r["_size"] == "mine" and r.n_chars == len(r.text)
        words[r.source] += len(WORDS.findall(r.text))
    want = Counter()
    narrow = {(r.source_size): r.target for r in mix(docs(spark, ROWS)).collect()}
    for r in mix(docs(spark, ROWS)).collect():
        want[r.source_size] += r.taken
    assert sorted(v for v in want.values() if v) == sorted(words.values()) and narrow


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert mix(none).collect() == [] and mixed_documents(none).collect() == [] and shard_documents(none).collect() == []


def test_shards(spark):
    table = docs(spark, ROWS)
    got = shard_documents(table, 16, rows_per_range=10).collect()
    assert len(got) == len(ROWS) and {r.law for r in got} == {"key"}
    for r in got:
        assert r.grown_shard in (r.shard, 16)
    want = Counter((d, len((t or "").encode()) + 1, binascii.crc32((t or "").encode())) for d, t, _ in ROWS)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    for j in range(16):
        assert sorted(r.slot for r in got if r.shard == j) == list(range(sum(r.shard == j for r in got)))
    shards = {}
    for r in got:
        assert shards.setdefault(r.doc_id, r.shard) == r.shard
    again = shard_documents(table.repartition(3), 16, rows_per_range=100).collect()
    assert {(r.doc_id, r.shard) for r in got} == {(r.doc_id, r.shard) for r in again}
    more = shard_documents(table, 17).collect()
    assert {(r.doc_id, r.grown_shard) for r in got} == {(r.doc_id, r.shard) for r in more}


def test_weights_and_kept_columns(spark):
    table = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("mine").alias("shard"), F.lit(1).alias("_own"))
    got = shard_documents(table, weights=[1.0, 3.0], keep=True).collect()
    share = sum(r["shard_"] == 1 for r in got) / 4000
    assert 0.7 < share < 0.8 and {r["shard"] for r in got} == {"mine"}
