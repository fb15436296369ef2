"""Queries over counters, load summaries, registry, audit, validation and sources."""

import uuid

from pyspark.sql import functions as F

from wardstone import vocab as V
from wardstone.catalog import corpus as C
from wardstone.catalog.base import query
from wardstone.functions.text import content_hash
from wardstone.operators import audit as AU
from wardstone.operators import metrics as M
from wardstone.operators import validation as VA
from wardstone.operators.skew import nearest_rank_percentiles
from wardstone.session import checkpoint_dir
from wardstone.sources import files as SF
from wardstone.sources import tables as ST

# --- counters and load ------------------------------------------------------------------------


@query(
    "run_counters",
    f"""WITH {C.SQL_DOCS}, {C.SQL_NODES} SELECT (SELECT count(*) FROM docs WHERE source = 'google_drive') AS added, (SELECT count(*) FROM docs WHERE source <> 'google_drive') AS skipped,
      (SELECT count(*) FROM labels WHERE toxic = 1) AS errors, (SELECT count(*) FROM nodes) AS text_nodes, (SELECT count(*) FROM pages) AS image_nodes""",
)
def run_counters(spark, sf):
    d = C.docs(spark, sf)
    nodes = C.nodes(spark, sf).select("modality").unionByName(C.table(spark, sf, "pages").select(F.lit("image").alias("modality")))
    drive = F.col("source") == "google_drive"
    return M.run_counters(d.filter(drive), d.filter(~drive), C.table(spark, sf, "labels").filter("toxic = 1"), nodes)


def _registries(spark, sf):
    old = C.docs(spark, sf).filter("n % 10 <> 0").select("doc_id", "n", content_hash("text").alias("content_hash"))
    changed = F.when(F.col("n") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = C.docs(spark, sf).filter("n % 9 <> 0").select("doc_id", "n", content_hash(changed).alias("content_hash"))
    return old, new


SQL_CHANGE = "CASE WHEN n % 10 = 0 THEN 'added' WHEN n % 9 = 0 THEN 'deleted' WHEN n % 7 = 0 THEN 'updated' ELSE 'unchanged' END"


@query(
    "registry_diff",
    f"WITH {C.SQL_DOCS} SELECT doc_id, {SQL_CHANGE} AS change FROM docs WHERE n % 10 <> 0 OR n % 9 <> 0",
)
def registry_diff(spark, sf):
    return M.registry_diff(*_registries(spark, sf))


@query(
    "registry_upsert",
    f"""WITH {C.SQL_DOCS} SELECT doc_id, 'v' || CASE WHEN n % 9 <> 0 THEN 2 ELSE 1 END AS title, CASE WHEN n % 10 <> 0 THEN '2024-01-01' ELSE '2024-02-02' END AS created,
      CASE WHEN n % 9 <> 0 THEN '2024-02-02' ELSE '2024-01-01' END AS updated FROM docs WHERE n % 10 <> 0 OR n % 9 <> 0""",
)
def registry_upsert(spark, sf):
    t0, t1 = (F.lit(t).cast("timestamp") for t in ("2024-01-01", "2024-02-02"))
    d = C.docs(spark, sf).select("doc_id", "n")
    old = d.filter("n % 10 <> 0").select("doc_id", F.lit("v1").alias("title"), t0.alias("created_at"), t0.alias("updated_at"))
    # every new document arrives twice; the later row must win, and its NUL is dropped
    batch = d.filter("n % 9 <> 0").withColumn("seq", F.explode(F.array(F.lit(2), F.lit(1)))).select(
        "doc_id", F.concat(F.lit("v\x00"), F.col("seq").cast("string")).alias("title"), "seq"
    )
    out = ST.upsert_registry(old, batch, t1, "seq")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return out.select("doc_id", "title", day("created_at").alias("created"), day("updated_at").alias("updated"))


@query(
    "node_upsert",
    f"""WITH {C.SQL_DOCS}, {C.SQL_NODES} SELECT doc_id, seq, n % 9 = 0 AS old FROM nodes WHERE n % 9 = 0 OR seq < 2""",
)
def node_upsert(spark, sf):
    n = C.nodes(spark, sf).select("doc_id", "n", F.col("seq").cast("bigint").alias("seq"))
    old = n.withColumn("old", F.lit(True))
    new = n.filter("n % 9 <> 0 AND seq < 2").withColumn("old", F.lit(False))
    return ST.upsert_nodes(old, new).select("doc_id", "seq", "old")


@query(
    "node_delete",
    f"""WITH {C.SQL_DOCS}, {C.SQL_NODES} SELECT doc_id, count(*) AS nodes FROM nodes WHERE n NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY doc_id""",
)
def node_delete(spark, sf):
    gone = C.table(spark, sf, "labels").filter("toxic = 1").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("doc_id"))
    return ST.delete_docs(C.nodes(spark, sf).select("doc_id"), gone).groupBy("doc_id").agg(F.count("*").alias("nodes"))


@query(
    "request_counts",
    """SELECT event_type AS method, 'k' || (user_id % 5) AS path, CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status, count(*) AS requests FROM events GROUP BY ALL""",
)
def request_counts(spark, sf):
    return M.request_metrics(_http_log(spark, sf))[0]


SQL_LE = ", ".join([f"count(*) FILTER (value / 50 <= {b}::DOUBLE) AS b{i}" for i, b in enumerate(V.LATENCY_BUCKETS)] + ["count(*) AS b_inf"])
SQL_PAIRS = ", ".join([f"{{'le': '{b}', 'c': b{i}}}" for i, b in enumerate(V.LATENCY_BUCKETS)] + ["{'le': '+Inf', 'c': b_inf}"])


@query(
    "latency_histogram",
    f"""WITH h AS (SELECT event_type AS method, 'k' || (user_id % 5) AS path, {SQL_LE} FROM events GROUP BY ALL), u AS (SELECT method, path, unnest([{SQL_PAIRS}]) AS p FROM h)
    SELECT method, path, p.le AS le, p.c AS requests FROM u""",
)
def latency_histogram(spark, sf):
    return M.request_metrics(_http_log(spark, sf))[1].select("method", "path", "le", "requests")


def _http_log(spark, sf):
    return C.table(spark, sf, "events").select(
        F.col("event_type").alias("method"),
        F.concat(F.lit("k"), (F.col("user_id") % 5).cast("string")).alias("path"),
        F.when(F.col("event_type") == "error", "500").otherwise("200").alias("status"),
        (F.col("value") / 50).alias("latency"),
    )


def _load_log(spark, sf):
    return C.table(spark, sf, "events").select(
        "event_id", (F.col("user_id") % 10).alias("client"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency"),
        F.when(F.col("event_type") == "error", 503).otherwise(200).alias("status"), F.when(F.col("event_type") == "error", "http_503").alias("error"),
    )


def _sql_pct(p):
    return f"list(value ORDER BY value) FILTER (event_type <> 'error')[CAST(round_even({p / 100.0}::DOUBLE * (count(*) FILTER (event_type <> 'error') - 1), 0) AS BIGINT) + 1]"


SQL_LOAD = f"""count(*) AS total_requests, count(*) FILTER (event_type <> 'error') AS success_requests, count(*) FILTER (event_type = 'error') AS failed_requests,
    round(count(*) FILTER (event_type = 'error')::DOUBLE / count(*), 6) AS failure_rate, round(count(*) / 60.0::DOUBLE, 6) AS throughput,
    round(avg(value) FILTER (event_type <> 'error'), 6) AS avg_latency, count(*) FILTER (event_type = 'error')::DOUBLE / count(*) <= 0.2 AS passed,
    (list(value ORDER BY value) FILTER (event_type <> 'error'))[CAST(round_even(0.5::DOUBLE * (count(*) FILTER (event_type <> 'error') - 1), 0) AS BIGINT) + 1] AS p50_latency,
    (list(value ORDER BY value) FILTER (event_type <> 'error'))[CAST(round_even(0.95::DOUBLE * (count(*) FILTER (event_type <> 'error') - 1), 0) AS BIGINT) + 1] AS p95_latency"""


def _shown(df, keys):
    rounded = [F.round(c, 6).alias(c) for c in ("failure_rate", "throughput", "avg_latency")]
    return df.select(*keys, "total_requests", "success_requests", "failed_requests", *rounded, "passed", "p50_latency", "p95_latency")


@query("load_summary", f"SELECT {SQL_LOAD} FROM events")
def load_summary(spark, sf):
    return _shown(M.load_summary(_load_log(spark, sf), [], 60.0, 0.2), [])


@query("load_summary_by_client", f"SELECT user_id % 10 AS client, {SQL_LOAD} FROM events GROUP BY user_id % 10")
def load_summary_by_client(spark, sf):
    return _shown(M.load_summary(_load_log(spark, sf), ["client"], 60.0, 0.2), ["client"])


@query(
    "price_percentiles",
    """WITH g AS (SELECT l_returnflag, list(l_extendedprice ORDER BY l_extendedprice) AS v FROM lineitem GROUP BY 1), p AS (SELECT unnest([0.0, 1.0, 50.0, 90.0, 99.9, 100.0]::DOUBLE[]) AS percent)
    SELECT l_returnflag, percent, v[CAST(round_even(percent / 100.0 * (len(v) - 1), 0) AS BIGINT) + 1] AS value FROM g, p""".replace("FROM g, p", "FROM g JOIN p ON true"),
)
def price_percentiles(spark, sf):
    li = C.table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    return nearest_rank_percentiles(li, ["l_returnflag"], "l_extendedprice", [0, 1, 50, 90, 99.9, 100])


@query(
    "failure_samples",
    """SELECT client, event_id, status, sample FROM (SELECT user_id % 10 AS client, event_id, 503 AS status, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS sample FROM events WHERE event_type = 'error') WHERE sample <= 5""",
)
def failure_samples(spark, sf):
    return M.failure_samples(_load_log(spark, sf), ["client"], "event_id").select("client", "event_id", "status", "sample")


@query(
    "stage_counts",
    """SELECT l_orderkey AS query_id, count(*) FILTER (l_returnflag = 'A') AS evidence_count, count(*) FILTER (l_returnflag = 'N') AS allowed_count, count(*) FILTER (l_returnflag = 'R') AS usable_count,
      0 AS scoped_count, 0 AS generation_count, 0 AS citation_count FROM lineitem GROUP BY l_orderkey""",
)
def stage_counts(spark, sf):
    stage = F.when(F.col("l_returnflag") == "A", "evidence").when(F.col("l_returnflag") == "N", "allowed").otherwise("usable")
    return M.stage_counts(C.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), stage.alias("stage")))


@query(
    "feedback_summary",
    """SELECT d.doc_id AS run_id, count(*) FILTER (quality = 1) AS up, count(*) FILTER (quality = 0) AS down FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.doc_id""",
)
def feedback_summary(spark, sf):
    votes = C.table(spark, sf, "labels").select(F.col("doc_id").alias("run_id"), F.when(F.col("quality") == 1, "up").otherwise("down").alias("thumb"))
    return M.feedback_summary(votes, C.table(spark, sf, "documents").select(F.col("doc_id").alias("run_id")))


@query(
    "mode_comparison",
    """SELECT 'item' || item_id AS question, item_id % 3 AS text_only_citations, item_id % 5 AS multimodal_citations, CASE WHEN item_id % 3 = 0 THEN 'insufficient_evidence' END AS text_only_refusal,
      CASE WHEN item_id % 5 = 0 THEN 'insufficient_evidence' END AS multimodal_refusal FROM benchmark""",
)
def mode_comparison(spark, sf):
    b = C.table(spark, sf, "benchmark").withColumn("include_images", F.explode(F.array(F.lit(True), F.lit(False))))
    cites = F.when(F.col("include_images"), F.col("item_id") % 5).otherwise(F.col("item_id") % 3)
    rows = b.select(
        F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("question"), "include_images", cites.alias("citations"),
        F.when(cites == 0, "insufficient_evidence").alias("refusal_reason"),
    )
    return M.compare_modes(rows)


def _cases(spark, sf):
    i = F.col("event_id")
    e = C.table(spark, sf, "events").withColumn("id", i.cast("string"))
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("refuse", "deny", "answer_with_citation", "Answer", "other")]), (i % 5 + 1).cast("int"))
    cases = e.select(
        "id", kinds.alias("expect"), F.when(i % 11 == 0, 403).alias("expect_status"), F.when(i % 3 == 0, 2).alias("min_citations"),
        F.when(i % 4 == 0, F.array(F.lit("VIEW"))).alias("must_contain"), F.when(i % 4 == 1, F.array(F.lit("Error"))).alias("must_not_contain"),
    )
    responses = e.select(
        "id", F.lit(200).alias("status_code"), F.concat(F.lit("Got "), "event_type").alias("answer"),
        F.when(F.col("user_id") % 2 == 0, "insufficient_evidence").alias("refusal_reason"), (F.col("user_id") % 4).cast("int").alias("citations"),
    )
    return cases, responses


SQL_CHECK = """checked AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'unexpected_status:200!= 403' WHEN event_id % 5 = 4 THEN 'unknown_expectation:other'
    WHEN event_id % 5 IN (0, 1) AND user_id % 2 <> 0 THEN 'expectation_failed:' || CASE event_id % 5 WHEN 0 THEN 'refuse' ELSE 'deny' END
    WHEN event_id % 5 = 2 AND (user_id % 2 = 0 OR user_id % 4 < CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END) THEN 'expectation_failed:answer_with_citation'
    WHEN event_id % 5 = 3 AND user_id % 2 = 0 THEN 'expectation_failed:answer'
    WHEN event_id % 4 = 0 AND event_type <> 'view' THEN 'missing_required_terms' WHEN event_id % 4 = 1 AND event_type = 'error' THEN 'forbidden_terms_present' ELSE 'ok' END AS reason FROM events)"""


@query("case_checks", f"WITH {SQL_CHECK} SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN reason = 'ok' THEN 'PASS' ELSE 'FAIL' END AS status, reason FROM checked")
def case_checks(spark, sf):
    return M.check_cases(*_cases(spark, sf)).select("id", "status", "reason")


@query("case_summary", f"WITH {SQL_CHECK} SELECT CASE WHEN reason = 'ok' THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS cases FROM checked GROUP BY 1")
def case_summary(spark, sf):
    return M.case_summary(M.check_cases(*_cases(spark, sf)))


# --- audit ------------------------------------------------------------------------------------


def _audit_inputs(spark, sf):
    o = C.table(spark, sf, "orders")
    run = F.concat(F.lit("run"), F.col("o_orderkey").cast("string"))
    runs = o.select(
        run.alias("run_id"), F.col("o_orderpriority").alias("query"), F.lit("qa").alias("mode"),
        F.when(F.col("o_orderstatus") == "F", "refused").otherwise("answered").alias("response_status"),
        F.when(F.col("o_orderstatus") == "F", "insufficient_evidence").alias("refusal_reason"),
        F.when(F.col("o_custkey") % 3 != 0, F.concat(F.lit("U"), F.col("o_custkey").cast("string"))).alias("user_id"),
        F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit(" C"), F.col("o_custkey").cast("string"), F.lit("@x.org "))).alias("email"),
        F.array(F.lit("hr")).alias("groups"),
        F.struct(F.lit(True).alias("allow"), F.lit("public_document").alias("reason"), F.lit("1.0").alias("policy_version")).alias("decision"),
        F.lit("m").alias("model_id"), F.lit("local").alias("model_version"),
    )
    li = C.table(spark, sf, "lineitem").select(
        F.concat(F.lit("run"), F.col("l_orderkey").cast("string")).alias("run_id"), F.col("l_returnflag").alias("f"),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("node_id"), F.concat(F.lit("d"), F.col("l_suppkey").cast("string")).alias("doc_id"),
        F.lit(None).cast("int").alias("page"), F.col("l_linestatus").alias("chunk_id"), F.lit("text").alias("modality"), F.col("l_discount").alias("score"),
        F.concat(F.lit("S"), F.col("l_linenumber").cast("string")).alias("sheet_name"),
    ).dropDuplicates(["run_id", "node_id"])
    return runs, li, li.filter("f = 'A'").withColumn("citation_label", F.col("doc_id"))


SQL_AUDIT_NODES = """ev AS (SELECT DISTINCT 'run' || l_orderkey AS run_id, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS node_id, 'S' || l_linenumber AS sheet_name FROM lineitem)"""


@query(
    "audit_runs",
    """SELECT 'run' || o_orderkey AS run_id, sha256(CASE WHEN o_custkey % 3 <> 0 THEN 'u' || o_custkey ELSE 'c' || o_custkey || '@x.org' END) AS user_hash, sha256(o_orderpriority) AS query_hash, NULL AS raw_query,
      CASE WHEN o_orderstatus = 'F' THEN 'refused' ELSE 'answered' END AS response_status FROM orders""",
)
def audit_runs(spark, sf):
    rows = AU.audit_rows(*_audit_inputs(spark, sf), F.lit("2024-01-01").cast("timestamp"))
    q = rows["query_runs"]
    return q.select("run_id", F.col("user_id_hash").alias("user_hash"), "query_hash", "raw_query", "response_status")


@query(
    "run_detail",
    f"""WITH {SQL_AUDIT_NODES}, c AS (SELECT run_id, count(*) AS n FROM ev GROUP BY 1) SELECT 'run' || o_orderkey AS run_id, coalesce(n, 0) AS evidence FROM orders LEFT JOIN c ON c.run_id = 'run' || o_orderkey""",
)
def run_detail(spark, sf):
    runs, ev, ci = _audit_inputs(spark, sf)
    rows = AU.audit_rows(runs, ev, ci, F.lit("2024-01-01").cast("timestamp"))
    found, _cited = AU.run_detail(rows["query_runs"], rows["query_run_evidence"], rows["query_run_citations"])
    return found.groupBy("run_id").agg(F.count("node_id").alias("evidence"))


@query(
    "citation_read_back",
    """SELECT DISTINCT 'run' || l_orderkey AS run_id, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS node_id, 'S' || l_linenumber AS sheet_name FROM lineitem l
    WHERE l_returnflag = 'A' AND NOT EXISTS (SELECT 1 FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND m.l_linenumber = l.l_linenumber AND m.l_partkey = l.l_partkey AND m.l_suppkey = l.l_suppkey AND m.l_returnflag <> 'A')
      AND 'run' || l_orderkey IN (SELECT 'run' || o_orderkey FROM orders)""",
)
def citation_read_back(spark, sf):
    runs, ev, _ci = _audit_inputs(spark, sf)
    # only nodes whose every line is returned are cited, so that duplicate lines cannot decide by chance
    li = C.table(spark, sf, "lineitem")
    sure = li.groupBy("l_orderkey", F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("node_id")).agg(F.min(F.col("l_returnflag") == "A").alias("a")).filter("a")
    ci = ev.join(sure.select(F.concat(F.lit("run"), F.col("l_orderkey").cast("string")).alias("run_id"), "node_id"), ["run_id", "node_id"], "left_semi").withColumn("citation_label", F.col("doc_id"))
    rows = AU.audit_rows(runs, ev, ci, F.lit("2024-01-01").cast("timestamp"))
    _found, cited = AU.run_detail(rows["query_runs"], rows["query_run_evidence"], rows["query_run_citations"])
    return cited.filter("node_id IS NOT NULL").select("run_id", "node_id", "sheet_name")


@query(
    "run_states",
    """SELECT 'ing' || o_orderkey AS run_id, CASE WHEN o_orderstatus = 'F' THEN 'failed' WHEN o_custkey % 2 = 0 THEN 'completed_with_errors' ELSE 'completed' END AS status, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_custkey END AS added,
      CASE WHEN o_orderstatus = 'F' OR o_custkey % 2 = 0 THEN 1 ELSE 0 END AS error_count, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_custkey * 3 END AS text_nodes, 'second' AS tag FROM orders""",
)
def run_states(spark, sf):
    o = C.table(spark, sf, "orders")
    run, key, failed = F.concat(F.lit("ing"), F.col("o_orderkey").cast("string")), F.col("o_custkey"), F.col("o_orderstatus") == "F"
    none_i, none_s = F.lit(None).cast("int"), F.lit(None).cast("string")
    counts = ["added", "updated", "deleted", "skipped"]
    first = o.select(
        run.alias("run_id"), F.lit(0).alias("seq"), F.lit("running").alias("status"), F.lit("local").alias("source"), F.lit("x").alias("dataset_source"),
        *[none_i.alias(c) for c in counts], F.lit(None).cast("array<string>").alias("errors"), F.create_map(F.lit("tag"), F.lit("first")).alias("metadata"), F.col("o_orderdate").alias("at"),
    )
    errors = F.when(failed | (key % 2 == 0), F.array(F.lit("e"))).otherwise(F.array().cast("array<string>"))
    meta = F.when(failed, F.create_map(F.lit("tag"), F.lit("second"))).otherwise(
        F.create_map(F.lit("text_nodes_indexed"), (key * 3).cast("string"), F.lit("tag"), F.lit("second"))
    )
    last = o.select(
        run.alias("run_id"), F.lit(1).alias("seq"), F.when(failed, "failed").otherwise(ST.final_status(errors)).alias("status"), none_s.alias("source"), none_s.alias("dataset_source"),
        F.when(~failed, key.cast("int")).alias("added"), *[none_i.alias(c) for c in counts[1:]], errors.alias("errors"), meta.alias("metadata"), F.col("o_orderdate").alias("at"),
    )
    s = ST.run_status(first.unionByName(last))
    return s.select(
        "run_id", "status", F.col("added").cast("bigint").alias("added"), F.col("error_count").cast("bigint").alias("error_count"),
        F.col("text_nodes_indexed").cast("bigint").alias("text_nodes"), F.col("metadata")["tag"].alias("tag"),
    )


@query(
    "settings_effective",
    """SELECT 'env' AS origin, 'hr=a|b' AS mapping, (SELECT count(*) FROM region) AS stored UNION ALL SELECT 'db', 'g=' || (SELECT lower(max(r_name)) FROM region), (SELECT count(*) FROM region) UNION ALL SELECT 'env', '', (SELECT count(*) FROM region)""",
)
def settings_effective(spark, sf):
    r = C.table(spark, sf, "region")
    t0 = F.lit("2024-01-01").cast("timestamp")
    base = r.select(F.lower("r_name").alias("key"), F.lit("{}").alias("value"), t0.alias("created_at"), t0.alias("updated_at"))
    top = r.agg(F.max("r_name").alias("m"))
    change = top.select(F.lower("m").alias("key"), F.concat(F.lit('{"G": "'), "m", F.lit('"}')).alias("value"))
    stored = ST.upsert_settings(base, change, F.lit("2024-02-02").cast("timestamp"))
    renamed = stored.withColumn("key", F.when(F.col("value") != "{}", "group_map").otherwise(F.col("key")))

    def show(df):
        pairs = F.transform(F.array_sort(F.map_entries("mapping")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|")))
        return df.select("origin", F.array_join(pairs, ";").alias("mapping"), renamed.agg(F.count("*")).scalar().alias("stored"))

    return (
        show(ST.effective_setting(renamed, "group_map", '{"/HR": ["b", "A"]}'))
        .unionByName(show(ST.effective_setting(renamed, "group_map", "{}")))
        .unionByName(show(ST.effective_setting(renamed, "absent", None)))
    )


@query(
    "snapshot_restore",
    """SELECT 'customer' AS name, 'ok' AS status, (SELECT count(*) FROM customer) AS n UNION ALL SELECT 'orders', 'ok', (SELECT count(*) FROM orders) UNION ALL SELECT 'missing', 'skipped', NULL""",
)
def snapshot_restore(spark, sf):


    root = f"{checkpoint_dir(spark)}/snapshots-{uuid.uuid4().hex}"
    tables = {"customer": C.table(spark, sf, "customer"), "orders": C.table(spark, sf, "orders"), "missing": None}
    ST.snapshot(spark, {"customer": tables["customer"]}, root, "20240101")
    ST.snapshot(spark, tables, root, "20240202")
    found, manifest = ST.restore(spark, root)
    counts = None
    for name, df in found.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        counts = row if counts is None else counts.unionByName(row)
    return manifest.select("name", "status").join(counts, "name", "left")


@query(
    "append_only_audit",
    """SELECT count(*) * 2 AS feedback_rows, true AS guarded FROM labels""",
)
def append_only_audit(spark, sf):


    log = ST.AppendOnly(spark, f"{checkpoint_dir(spark)}/audit-{uuid.uuid4().hex}")
    rows = C.table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("run_id"), F.when(F.col("quality") == 1, "up").otherwise("down").alias("thumb")
    )
    log.append({"feedback_events": rows})
    log.append({"feedback_events": rows})
    try:
        log.overwrite("feedback_events", rows)
        guarded = False
    except PermissionError:
        guarded = True
    return log.read("feedback_events").agg(F.count("*").alias("feedback_rows"), F.lit(guarded).alias("guarded"))


@query(
    "node_store",
    f"""WITH {C.SQL_DOCS}, {C.SQL_NODES} SELECT doc_id, count(*) AS nodes FROM nodes WHERE (n % 9 <> 0 OR seq < 1) AND n % 10 <> 3 GROUP BY doc_id""",
)
def node_store(spark, sf):


    store = ST.NodeStore(spark, f"{checkpoint_dir(spark)}/nodes-{uuid.uuid4().hex}", buckets=8)
    n = C.nodes(spark, sf).select("doc_id", "n", "seq")
    store.replace_documents(n)
    store.replace_documents(n.filter("n % 9 = 0 AND seq < 1"))
    store.delete_documents(n.filter("n % 10 = 3").select("doc_id"))
    return store.read().groupBy("doc_id").agg(F.count("*").alias("nodes"))


# --- validation -------------------------------------------------------------------------------


@query(
    "value_checks",
    f"""SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN role = 'system' THEN 'value:role' END, CASE WHEN turn % 4 = 3 THEN 'value:mode' END, CASE WHEN length(text) > 500 THEN 'null:text' END], lambda v: v IS NOT NULL), ',') AS violations
    FROM conversations WHERE role = 'system' OR turn % 4 = 3 OR length(text) > 500""",
)
def value_checks(spark, sf):
    t = C.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "system", "robot").otherwise(F.col("role")).alias("role"),
        F.when(F.col("turn") % 4 == 3, "other").otherwise("qa").alias("mode"), F.when(F.length("text") <= 500, F.col("text")).alias("text"),
    )
    _ok, bad = VA.check_values(t, required=["text"])
    return bad.select("conv_id", "turn", F.array_join("violations", ",").alias("violations"))


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return VA.duplicate_keys(C.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "orphan_references",
    "SELECT 'labels' AS child, doc_id AS key FROM labels WHERE doc_id + 1 NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'lineitem', l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')",
)
def orphan_references(spark, sf):
    docs = C.table(spark, sf, "documents").select((F.col("doc_id") - 1).alias("doc_id"))
    a = VA.orphans(C.table(spark, sf, "labels"), docs, "doc_id").select(F.lit("labels").alias("child"), F.col("doc_id").alias("key"))
    orders = C.table(spark, sf, "orders").filter("o_orderstatus <> 'P'")
    b = VA.orphans(C.table(spark, sf, "lineitem"), orders, "l_orderkey", "o_orderkey").select(F.lit("lineitem").alias("child"), F.col("l_orderkey").alias("key"))
    return a.unionByName(b)


@query(
    "first_seen_union",
    "SELECT p_partkey, 'a' AS origin FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 'b' FROM part WHERE p_size % 2 <> 0",
)
def first_seen_union(spark, sf):
    p = C.table(spark, sf, "part").select("p_partkey", "p_size")
    a = p.filter("p_size % 2 = 0").select("p_partkey", F.lit("a").alias("origin"))
    return VA.first_seen_union(a, p.select("p_partkey", F.lit("b").alias("origin")), key=["p_partkey"])


@query(
    "set_operations",
    """SELECT 'both' AS kind, count(*) AS n FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT 'left', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0)
    UNION ALL SELECT 'nodes', (SELECT count(*) FROM documents) + (SELECT count(*) FROM pages)""",
)
def set_operations(spark, sf):
    o = C.table(spark, sf, "orders").select("o_custkey")
    c = C.table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    union = C.table(spark, sf, "documents").select(F.col("doc_id").alias("k")).unionByName(C.table(spark, sf, "pages").select(F.col("page_id").alias("k")))
    count = lambda kind, df: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count("both", o.intersect(c)).unionByName(count("left", o.subtract(c))).unionByName(count("nodes", union))


# --- sources ----------------------------------------------------------------------------------


@query(
    "permission_rows_to_acl",
    """WITH p AS (SELECT l_partkey AS f, lower('User' || (l_suppkey % 5) || '@X.org') AS m, CASE l_linenumber % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'group' WHEN 2 THEN 'domain' ELSE CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 'anyone' ELSE 'user' END END AS t FROM lineitem)
    SELECT p_partkey, coalesce(string_agg(DISTINCT m, ',' ORDER BY m) FILTER (t IN ('user', 'group')), '') AS emails, coalesce(string_agg(DISTINCT m, ',' ORDER BY m) FILTER (t = 'group'), '') AS groups,
      CASE WHEN bool_or(t = 'domain') THEN 'x.org' ELSE '' END AS domains, coalesce(bool_or(t = 'anyone'), false) AS is_public FROM part LEFT JOIN p ON p.f = p_partkey GROUP BY p_partkey""",
)
def permission_rows_to_acl(spark, sf):
    files = C.table(spark, sf, "part").select(F.col("p_partkey").alias("file_id"))
    k = F.col("l_linenumber") % 4
    any_one = (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)
    perms = C.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("file_id"),
        F.when(k == 0, "user").when(k == 1, "group").when(k == 2, "domain").when(any_one, "anyone").otherwise("user").alias("type"),
        F.when(k != 2, F.concat(F.lit("User"), (F.col("l_suppkey") % 5).cast("string"), F.lit("@X.org"))).alias("email_address"),
        F.when(k == 2, "X.org").alias("domain"),
    )
    a = SF.permissions_to_acl(files, perms)
    return a.select(
        F.col("file_id").alias("p_partkey"), F.array_join("acl.allowed_emails", ",").alias("emails"), F.array_join("acl.allowed_groups", ",").alias("groups"),
        F.array_join("acl.allowed_domains", ",").alias("domains"), "acl.is_public",
    )


@query(
    "acl_sidecar",
    f"""WITH {C.SQL_DOCS} SELECT doc_id, CASE WHEN n % 4 = 0 THEN 'path' WHEN n % 4 = 1 THEN 'name' ELSE '' END AS groups, n % 4 = 1 AND n % 2 = 1 AS is_public FROM docs""",
)
def acl_sidecar(spark, sf):
    d = C.docs(spark, sf).drop("acl")
    n = F.col("n")

    def acl(group, public):
        none = F.array().cast("array<string>")
        return F.struct(none.alias("allowed_emails"), none.alias("allowed_domains"), none.alias("allowed_users"), F.array(F.lit(group)).alias("allowed_groups"), public.alias("is_public")).alias("acl")

    by_path = d.filter(n % 4 == 0).select(F.col("doc_id").alias("key"), acl("path", F.lit(False)))
    by_name = d.filter(n % 4 < 2).select(F.col("name").alias("key"), acl("name", n % 2 == 1))
    out = SF.apply_acl_sidecar(d, by_path.unionByName(by_name))
    return out.select("doc_id", F.array_join("acl.allowed_groups", ",").alias("groups"), F.col("acl.is_public").alias("is_public"))


def _listing(spark, sf):
    """A folder tree out of regions, nations and customers; orders are the files, some of unknown types."""
    folder = F.lit(V.FOLDER_MIME_TYPE)
    s = lambda c: F.col(c).cast("string")
    r = C.table(spark, sf, "region").select(F.concat(F.lit("r"), s("r_regionkey")).alias("file_id"), F.col("r_name").alias("name"), folder.alias("mime_type"), F.lit("root").alias("parent_id"))
    n = C.table(spark, sf, "nation").select(F.concat(F.lit("n"), s("n_nationkey")).alias("file_id"), F.col("n_name").alias("name"), folder.alias("mime_type"), F.concat(F.lit("r"), s("n_regionkey")).alias("parent_id"))
    loop = C.table(spark, sf, "region").select(F.concat(F.lit("r"), s("r_regionkey")).alias("file_id"), F.lit("loop").alias("name"), folder.alias("mime_type"), F.concat(F.lit("n"), s("r_regionkey")).alias("parent_id"))
    mime = F.when(F.col("c_custkey") % 3 == 0, "application/pdf").when(F.col("c_custkey") % 3 == 1, "text/plain").otherwise("image/png")
    c = C.table(spark, sf, "customer").select(F.concat(F.lit("c"), s("c_custkey")).alias("file_id"), F.col("c_name").alias("name"), mime.alias("mime_type"), F.concat(F.lit("n"), s("c_nationkey")).alias("parent_id"))
    return r.unionByName(n).unionByName(loop).unionByName(c)


@query(
    "listing_walk",
    """SELECT 'c' || c_custkey AS file_id, r_name || '/' || n_name || '/' || c_name AS drive_path, lower(r_name) || '|' || lower(r_name || '/' || n_name) AS ancestors, CASE WHEN c_custkey % 3 = 2 THEN 'skipped' ELSE 'supported' END AS state
    FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
)
def listing_walk(spark, sf):
    ok, skipped = SF.resolve_tree(_listing(spark, sf), "root")
    cols = ["file_id", "drive_path", F.array_join("folder_ancestors", "|").alias("ancestors")]
    return ok.select(*cols, F.lit("supported").alias("state")).unionByName(skipped.select(*cols, F.lit("skipped").alias("state")))


@query(
    "mime_split",
    f"""SELECT p_partkey, CASE WHEN p_size % 8 < 6 THEN 'supported' ELSE 'skipped' END AS state FROM part""",
)
def mime_split(spark, sf):
    kinds = F.array(*[F.lit(m) for m in V.DRIVE_MIME_TYPES], F.lit("image/png"), F.lit("text/csv"))
    p = C.table(spark, sf, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("file_id"), F.element_at(kinds, (F.col("p_size") % 8 + 1).cast("int")).alias("mime_type"))
    ok, skipped = SF.split_mime(p)
    return ok.select("p_partkey", F.lit("supported").alias("state")).unionByName(skipped.select("p_partkey", F.lit("skipped").alias("state")))


@query(
    "content_merge",
    f"""WITH {C.SQL_DOCS}, x AS (SELECT doc_id, n, n % 3 = 0 AS reader, n % 4 = 3 AS sheet, n % 6 = 0 AS tables FROM docs), y AS (SELECT *, NOT reader OR (sheet AND NOT tables) AS native FROM x)
    SELECT doc_id, CASE WHEN native AND n % 7 = 0 THEN CASE WHEN reader THEN 'spreadsheet_parse_failed: bad' ELSE 'content_download_failed: bad' END WHEN native THEN 'native' ELSE 'reader' END AS outcome FROM y""",
)
def content_merge(spark, sf):
    d = C.docs(spark, sf).select(F.col("doc_id").alias("file_id"), "n", "name", "mime_type")
    n = F.col("n")
    reader = d.filter(n % 3 == 0).select("file_id", F.lit("reader").alias("text"), (n % 6 == 0).alias("has_tables"))
    native = d.select("file_id", F.lit("native").alias("text"), F.when(n % 7 == 0, "bad").alias("error"))
    docs, skipped = SF.merge_contents(d, reader, native)
    return docs.select(F.col("file_id").alias("doc_id"), F.col("text").alias("outcome")).unionByName(
        skipped.select(F.col("file_id").alias("doc_id"), F.col("reason").alias("outcome"))
    )


@query(
    "reader_gaps",
    f"WITH {C.SQL_DOCS} SELECT doc_id, CASE WHEN n % 3 = 0 THEN 'read' ELSE 'missing' END AS state FROM docs",
)
def reader_gaps(spark, sf):
    d = C.docs(spark, sf).select(F.col("doc_id").alias("file_id"), "n")
    have, gone = SF.split_missing(d.drop("n"), d.filter("n % 3 = 0"))
    return have.select(F.col("file_id").alias("doc_id"), F.lit("read").alias("state")).unionByName(gone.select(F.col("file_id").alias("doc_id"), F.lit("missing").alias("state")))


#: bytes of the lines written to one file, on the average
FILE_BYTES = 8_000_000


@query(
    "file_scan",
    """SELECT 'part-' || lang || '.txt' AS name, '.txt' AS suffix, 'lang=' || lang AS folder, count(*) AS lines, sum(length(text))::BIGINT AS chars,
      min(md5(replace(text, chr(10), ' '))) AS lowest, max(md5(replace(text, chr(10), ' '))) AS highest FROM documents GROUP BY lang""",
)
def file_scan(spark, sf):
    """Files of lines written, scanned, decoded and compared line by line."""
    root = f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
    d = C.table(spark, sf, "documents").select("doc_id", "lang", F.replace("text", F.lit("\n"), F.lit(" ")).alias("value"))
    # a file is read as one row, so the lines of a language go to as many files as its bytes ask for
    total = d.agg(F.sum(F.octet_length("value"))).first()[0] or 0
    pieces = max(1, -(-total // FILE_BYTES))
    dealt = d.withColumn("_piece", F.pmod(F.xxhash64("doc_id"), F.lit(pieces)))
    dealt.repartition(pieces, "_piece").drop("doc_id", "_piece").write.partitionBy("lang").text(root)
    ok, skipped = SF.scan_files(spark, root)
    assert skipped.filter("path LIKE '%.txt'").isEmpty()
    docs = SF.docs_from_binary(ok)
    lang = F.regexp_extract("folder_path", "lang=(.*)$", 1)
    lines = docs.select("folder_path", "mime_type", F.explode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("line"))
    return lines.groupBy("folder_path", "mime_type").agg(
        F.first(F.concat(F.lit("part-"), lang, F.lit(".txt"))).alias("name"), F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"),
        F.min(F.md5("line")).alias("lowest"), F.max(F.md5("line")).alias("highest"),
    ).select("name", F.col("mime_type").alias("suffix"), F.col("folder_path").alias("folder"), "lines", "chars", "lowest", "highest")


def _one_file(spark, text, name):
    """A one-row string frame as one file; its path."""
    root = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    text.coalesce(1).write.text(root)
    return spark.read.format("binaryFile").load(root).filter("path LIKE '%part-%'").select("path").first().path


@query(
    "acl_sidecar_file",
    """SELECT 'docs/s' || s_suppkey || '.txt' AS key, 'g' || (s_nationkey % 3) AS grp, s_suppkey % 5 = 0 AS is_public FROM supplier""",
)
def acl_sidecar_file(spark, sf):
    """Access lists of a side file written from the suppliers and read back."""
    k = F.col("s_suppkey")
    entry = F.struct(F.array(F.concat(F.lit("G"), (F.col("s_nationkey") % 3).cast("string"))).alias("allowed_groups"), (k % 5 == 0).alias("is_public"))
    pairs = C.table(spark, sf, "supplier").select(F.struct(F.concat(F.lit("docs/s"), k.cast("string"), F.lit(".txt")).alias("k"), entry.alias("v")).alias("e"))
    text = pairs.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list("e")).alias("documents"))).alias("value"))
    got = SF.read_acl_sidecar(spark, _one_file(spark, text, "sidecar"))
    return got.select("key", F.get("acl.allowed_groups", F.lit(0)).alias("grp"), F.col("acl.is_public").alias("is_public"))


@query(
    "case_file",
    """SELECT 'c' || item_id AS id, md5(text) AS digest, CASE WHEN item_id % 3 = 0 THEN 'deny' ELSE 'refuse' END AS expect, item_id % 4 AS min_citations FROM benchmark""",
)
def case_file(spark, sf):
    """Evaluation cases of a file written from the benchmark and read back."""
    i = F.col("item_id")
    case = F.struct(
        F.concat(F.lit("c"), i.cast("string")).alias("id"), F.col("text").alias("prompt"), F.when(i % 3 == 0, "deny").otherwise("refuse").alias("expect"), (i % 4).cast("int").alias("min_citations")
    )
    text = C.table(spark, sf, "benchmark").agg(F.to_json(F.struct(F.collect_list(case).alias("cases"))).alias("value"))
    got = SF.read_cases(spark, _one_file(spark, text, "cases"))
    return got.select("id", F.md5("prompt").alias("digest"), "expect", F.col("min_citations").cast("bigint").alias("min_citations"))
