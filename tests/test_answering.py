"""The whole answering plan and repeated ingestion."""

import tempfile

from pyspark.sql import functions as F

from wardstone.catalog.stream_queries import _world, quoting_model
from wardstone.plans.answering import answer_requests
from wardstone.plans.ingesting import ingest, registry
from wardstone.operators.skew import settle
from wardstone.sources import tables
from wardstone.sources.tables import NodeStore, run_status
from wardstone.functions import acl as A

SF = "/root/testdata/sf0.001"


def test_plan_answers_everything_and_leaks_nothing(spark):
    asked, people, docs, nodes = _world(spark, SF)
    out = answer_requests(asked, people, docs, nodes, generate=quoting_model)
    answers = out.answers.join(out.routed.select("query_id", "route"), "query_id").collect()
    assert len(answers) == asked.count()
    by = {}
    for r in answers:
        by.setdefault(r.route, []).append(r)
    assert all(r.refusal_reason == "policy_violation" for r in by["blocked"])
    assert all(r.response_status == "chat_fallback" for r in by["chat"])
    assert any(r.response_status == "answered" and "[1]" in r.answer for r in by["rag"])
    assert any(r.answer.startswith("Indexed corpus categories") for r in by["inventory"])
    who = people.withColumnRenamed("principal_id", "pid")
    ev = out.evidence.join(who, F.col("principal_id") == F.col("pid"))
    assert ev.filter(~A.access_allowed(F.col("acl"), "user_id", "email", "domain", "groups")).isEmpty()
    c = out.counts.filter("generation_count > allowed_count OR allowed_count > evidence_count OR citation_count > generation_count")
    assert c.isEmpty()


def test_ingest_twice(spark):
    state = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    one = spark.createDataFrame([("a", "Alpha text"), ("b", "Beta text")], "doc_id string, text string")
    two = spark.createDataFrame([("a", "Alpha text"), ("b", "Beta changed"), ("c", "New")], "doc_id string, text string")
    assert tuple(ingest(spark, one, state, "r1", ["doc_id"]).first()) == (2, 0, 0, 0, 2, 0)
    assert tuple(ingest(spark, one, state, "r2", ["doc_id"]).first())[:3] == (0, 0, 0)
    assert tuple(ingest(spark, two, state, "r3", ["doc_id"], sync_deletes=True).first())[:3] == (1, 1, 0)
    assert tuple(ingest(spark, two.filter("doc_id <> 'a'"), state, "r4", ["doc_id"], sync_deletes=True).first())[:3] == (0, 0, 1)
    stored = {r.doc_id: r.text for r in NodeStore(spark, f"{state}/nodes").read().collect()}
    assert stored == {"b": "Beta changed", "c": "New"}
    assert {r.doc_id for r in registry(spark, state).collect()} == {"b", "c"}
    states = {r.run_id: r.status for r in run_status(spark.read.parquet(f"{state}/runs")).collect()}
    assert states == {f"r{i}": "completed" for i in (1, 2, 3, 4)}


def test_unauthenticated_askers_learn_nothing(spark):
    asked, people, docs, nodes = _world(spark, SF)
    out = answer_requests(asked, people.withColumn("authenticated", F.lit(False)), docs, nodes, generate=quoting_model)
    names = [r.name for r in docs.select("name").collect()]
    answers = [r.answer for r in out.answers.collect()]
    assert len(answers) == asked.count() and not [a for a in answers if any(n in a for n in names)]
    assert out.evidence.isEmpty() and out.citations.isEmpty()
    decided = out.parts["decisions"]
    assert decided.count() == out.routed.filter("route = 'rag'").count() and decided.filter("decision.allow").isEmpty()


def test_access_changes_and_emptied_documents_reach_the_store(spark):
    state = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    schema = "doc_id string, text string, acl struct<allowed_groups:array<string>,is_public:boolean>"
    one = spark.createDataFrame([("a", "Alpha text", (["x"], True)), ("b", "Beta text", ([], True)), ("c", "Gamma", ([], True))], schema)
    two = spark.createDataFrame([("a", "Alpha text", (["x"], False)), ("b", "", ([], True)), ("c", "Gamma", ([], True))], schema)
    keep = ["doc_id", "acl"]
    assert tuple(ingest(spark, one, state, "r1", keep).first())[:3] == (3, 0, 0)
    assert tuple(ingest(spark, two, state, "r2", keep).first())[:3] == (0, 2, 0)
    stored = {r.doc_id: r.acl.is_public for r in NodeStore(spark, f"{state}/nodes").read().collect()}
    assert stored == {"a": False, "c": True}
    assert {r.doc_id: r.acl.is_public for r in registry(spark, state).collect()} == {"a": False, "b": True, "c": True}


def test_hidden_documents_neither_tie_nor_hide(spark):
    from wardstone.operators.access import make_pools, with_principal_tokens, with_signature
    from wardstone.plans.answering import pre_target, route_requests

    acl = "struct<allowed_emails:array<string>,allowed_domains:array<string>,allowed_users:array<string>,allowed_groups:array<string>,is_public:boolean>"
    docs = with_signature(spark.createDataFrame(
        [("d1", "quarterly letter q1 2024 alpha.pdf", ([], [], [], ["other"], False)), ("d2", "quarterly letter q1 2024 beta.pdf", ([], [], [], [], True))], f"doc_id string, name string, acl {acl}"
    ))
    people = spark.createDataFrame([("p", True, "u", None, None, ["mine"])], "principal_id string, authenticated boolean, user_id string, email string, domain string, groups array<string>")
    asked = spark.createDataFrame([("q", "summarize the quarterly letter of q1 2024", "p")], "query_id string, query string, principal_id string")
    routed = route_requests(asked).join(with_principal_tokens(people).select("principal_id", "tokens"), "principal_id")
    assert pre_target(routed, docs).first().filters.doc_ids == ["d2"]
    both = docs.withColumn("signature", docs.filter("doc_id = 'd2'").select("signature").scalar())
    filters = pre_target(routed, both).first().filters
    assert filters is None or not filters.doc_ids
    assert make_pools(routed).count() == 1


def test_verdict_is_read_once(spark):
    """The JSON of a verdict is parsed once a row, however many fields look at it."""
    from wardstone.functions.answers import parse_verdict

    texts = ['a {"answerable": true, "support_indices": [2, "1", 9, "x", 2, true, 3.0]} b', '{"answerable": "", "reason": "r"}', "none", None, "{} {}", '{"answerable": 1, "support_indices": []}', '{"answerable": 1, "reason": "0"}']
    read = spark.createDataFrame([(t,) for t in texts], "raw string").select(parse_verdict("raw", F.lit(3)).alias("v"))
    got = [r.v and (r.v.answerable, r.v.reason, r.v.support, r.v.source) for r in read.collect()]
    assert got == [(True, "supported", [2, 1, 3], "llm"), (False, "r", [], "llm"), None, None, None, (True, "supported", [1], "llm"), (True, "supported", [1], "llm")]
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") <= 3 and plan.count("regexp_extract") <= 1


def test_an_ingest_keeps_no_second_copy_of_its_nodes(spark, tmp_path, monkeypatch):
    kept = []
    monkeypatch.setattr(tables, "settle", lambda df: kept.append(df.columns) or settle(df))
    docs = spark.createDataFrame([(f"d{i}", "One line. " * (i + 1)) for i in range(20)], "doc_id string, text string")
    assert tuple(ingest(spark, docs, str(tmp_path), "r1", ["doc_id"]).first())[:3] == (20, 0, 0)
    later = docs.withColumn("text", F.when(F.col("doc_id") == "d3", "").when(F.col("doc_id") == "d4", "New.").otherwise(F.col("text")))
    assert tuple(ingest(spark, later, str(tmp_path), "r2", ["doc_id"]).first())[:3] == (0, 2, 0)
    stored = {r.doc_id: r.text for r in tables.NodeStore(spark, f"{tmp_path}/nodes").read().collect()}
    assert stored == {f"d{i}": "New." if i == 4 else ("One line. " * (i + 1)).strip() for i in range(20) if i != 3}
    assert kept and all(c == ["doc_id"] for c in kept)
