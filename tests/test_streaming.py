"""Follow-up state, ingest runs and access changes over several batches."""

import uuid

import pytest
from pyspark.sql import functions as F

from wardstone.catalog import stream_queries as SQ
from wardstone.plans.ingesting import registry
from wardstone.session import checkpoint_dir
from wardstone.sources.tables import NodeStore, run_status
from wardstone.streaming import feeds as X

TURNS = "conv_id long, turn long, role string, text string"


def test_late_and_repeated_turns_change_no_state(spark):
    root = f"{checkpoint_dir(spark)}/followups-{uuid.uuid4().hex}"
    batches = [
        [(1, 0, "user", "What is the fund size?"), (1, 2, "user", "and what about it?"), (2, 5, "user", "Alpha?")],
        [(1, 1, "user", "late"), (1, 4, "user", "and what about it?"), (1, 4, "user", "and what about it?"), (2, 6, "assistant", "no"), (2, 7, "user", " ")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, TURNS).coalesce(1).write.mode("append").parquet(f"{root}/in")
        out = X.stream_followups(spark.readStream.schema(TURNS).parquet(f"{root}/in"))
        q = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    got = sorted(((r.conv_id, r.turn, r.previous) for r in spark.read.parquet(f"{root}/out").collect()), key=str)
    want = [(1, 0, None), (1, 1, None), (1, 2, "What is the fund size?"), (1, 4, "and what about it?"), (1, 4, None), (2, 5, None)]
    assert got == sorted(want, key=str)


ACL = "struct<allowed_groups:array<string>,is_public:boolean>"


def test_replays_change_nothing_and_the_feed_reaches_stored_nodes(spark):
    root = f"{checkpoint_dir(spark)}/feed-{uuid.uuid4().hex}"
    docs = lambda rows: spark.createDataFrame(rows, f"doc_id string, text string, acl {ACL}")
    changes = lambda rows: spark.createDataFrame(rows, f"doc_id string, changed_at long, acl {ACL}")
    nodes = lambda: {r.doc_id: (r.text, tuple(r.acl.allowed_groups), r.acl.is_public) for r in NodeStore(spark, f"{root}/nodes").read().collect()}
    version = lambda: NodeStore(spark, f"{root}/nodes").version()
    load, feed = X.ingest_batch(root, ["doc_id", "acl"], acl_log=f"{root}/acl"), X.acl_batch(f"{root}/acl", f"{root}/nodes")

    first = docs([("a", "alpha text", (["g"], True)), ("b", "beta text", (["g"], True)), ("c", "", (["g"], True))])
    load(first, 0)
    before, at, runs = nodes(), version(), spark.read.parquet(f"{root}/runs").count()
    assert sorted(before) == ["a", "b"] and sorted(r.doc_id for r in registry(spark, root).collect()) == ["a", "b", "c"]
    load(first, 0)
    load(first.withColumn("text", F.lit("other")), 0)  # the batch's run has ended
    assert nodes() == before and version() == at and spark.read.parquet(f"{root}/runs").count() == runs

    late = changes([("a", 5, (["new"], False)), ("x", 5, (["new"], False))])
    feed(late, 0)
    assert nodes() == before | {"a": ("alpha text", ("new",), False)}
    at = version()
    feed(late, 0)
    feed(changes([("a", 3, (["early"], True))]), 1)
    assert nodes()["a"] == ("alpha text", ("new",), False) and version() == at

    load(docs([("a", "alpha again", (["g"], True)), ("d", "delta text", (["g"], True))]), 1)
    assert nodes()["a"] == ("alpha again", ("new",), False) and sorted(r.doc_id for r in registry(spark, root).collect()) == ["a", "b", "c", "d"]
    states = {r.run_id: (r.status, r.added, r.updated) for r in run_status(spark.read.parquet(f"{root}/runs")).collect()}
    assert states == {"stream-0": ("completed", 3, 0), "stream-1": ("completed", 1, 1)}


@pytest.mark.parametrize("parts", [1, 3])
def test_streams_read_tables_that_are_folders(spark, parts):
    root = f"{checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"
    docs = spark.createDataFrame([(i, f"text {i % 4}") for i in range(12)] + [(12, None)], "doc_id long, text string")
    docs.repartition(parts).write.parquet(f"{root}/documents.parquet")
    turns = [(c, t, "user", f"question {t}") for c in range(5) for t in (0, 2)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(parts).write.parquet(f"{root}/conversations.parquet")
    assert SQ.stream_dedupe(spark, root).first().documents == 4
    assert {(r.conv_id, r.rewritten.split("\n")[0]) for r in SQ.stream_followups(spark, root).collect()} == {(c, "question 0") for c in range(5)}
    assert SQ.stream_ingest(spark, root).count() == 12
