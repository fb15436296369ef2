"""Queries over access lists, policy, groups, visibility and metadata filters."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardstone.catalog import corpus as C
from wardstone.catalog.base import query
from wardstone.functions import acl as A
from wardstone.functions import filters as FL
from wardstone.functions import identity as ID
from wardstone.operators import access as AC
from wardstone.operators.metrics import preview_access
from wardstone.operators.validation import membership_diff
from wardstone.plans.answering import NODE_COLUMNS

SQL_BASE = f"{C.SQL_DOCS}, {C.SQL_PRINCIPALS}"
SQL_DOC_TOKENS = f"doc_tokens AS (SELECT n, doc_id, acl, {C.sql_tokens('acl')} AS signature FROM docs)"


def sql_allowed(acl, who):
    return (
        f"({acl}.is_public OR coalesce(list_contains({acl}.emails, {who}.email), false) OR list_contains({acl}.domains, {who}.domain)"
        f" OR list_contains({acl}.users, {who}.user_id) OR list_has_any({acl}.groups, {who}.groups))"
    )


def sql_reason(acl, who):
    return (
        f"CASE WHEN NOT {who}.authenticated THEN 'default_deny' WHEN {acl}.is_public THEN 'public_document' WHEN list_contains({acl}.users, {who}.user_id) THEN 'allowed_user_match'"
        f" WHEN list_has_any({acl}.groups, {who}.groups) THEN 'allowed_group_match' WHEN coalesce(list_contains({acl}.emails, {who}.email), false) THEN 'transitional_allowed_email'"
        f" WHEN list_contains({acl}.domains, {who}.domain) THEN 'transitional_allowed_domain' ELSE 'default_deny' END"
    )


@query(
    "acl_extract",
    f"""WITH {SQL_BASE} SELECT doc_id, array_to_string(acl.emails, '|') AS emails, array_to_string(acl.groups, '|') AS groups, acl.is_public AS is_public FROM docs""",
)
def acl_extract(spark, sf):
    n = F.col("n")
    a = F.col("acl")
    shaped = C.docs(spark, sf).select(
        "doc_id",
        F.when(n % 3 == 0, a["allowed_emails"]).alias("allowed_emails"),
        F.when(n % 3 == 0, a["allowed_groups"]).alias("allowed_groups"),
        F.when(n % 3 == 0, a["is_public"]).alias("is_public"),
        F.when(n % 3 == 1, a).alias("permissions_summary"),
        F.struct(a.alias("permissions_summary")).alias("metadata"),
    )
    got = shaped.withColumn("x", A.extract_acl(shaped.schema))
    return got.select(
        "doc_id",
        F.array_join("x.allowed_emails", "|").alias("emails"),
        F.array_join("x.allowed_groups", "|").alias("groups"),
        F.col("x.is_public").alias("is_public"),
    )


@query(
    "policy_decisions",
    f"""WITH {SQL_BASE}, k AS (SELECT count(*) AS m FROM principals), x AS (SELECT d.doc_id, d.acl, d.n % (SELECT m FROM k) AS who FROM docs d)
    SELECT doc_id, {sql_reason('x.acl', 'p')} AS reason, {sql_reason('x.acl', 'p')} <> 'default_deny' AS allow, {sql_allowed('x.acl', 'p')} AS visible FROM x JOIN principals p ON p.principal_id = 'p' || who""",
)
def policy_decisions(spark, sf):
    p = C.principals(spark, sf)
    total = p.agg(F.count("*")).scalar()
    d = C.docs(spark, sf).select("doc_id", "acl", F.concat(F.lit("p"), (F.col("n") % total).cast("string")).alias("principal_id"))
    j = d.join(p, "principal_id")
    args = ("user_id", "email", "domain", "groups")
    j = j.withColumn("d", A.decision_or_default(A.policy_decision(F.col("acl"), "authenticated", *args)))
    return j.select("doc_id", "d.reason", "d.allow", A.access_allowed(F.col("acl"), *args).alias("visible"))


@query(
    "policy_outage_default",
    """SELECT event_id, event_id % 4 <> 0 AS closed_allow, CASE WHEN event_id % 4 = 0 THEN 'opa_unavailable_fail_closed' ELSE 'public_document' END AS closed_reason,
      true AS open_allow, CASE WHEN event_id % 4 = 0 THEN 'opa_unavailable_fail_open' ELSE 'public_document' END AS open_reason FROM events""",
)
def policy_outage_default(spark, sf):
    given = F.when(F.col("event_id") % 4 != 0, A._decision(True, "public_document"))
    e = C.table(spark, sf, "events").select(
        "event_id", A.decision_or_default(given).alias("c"), A.decision_or_default(given, fail_closed=False).alias("o")
    )
    return e.select(
        "event_id", F.col("c.allow").alias("closed_allow"), F.col("c.reason").alias("closed_reason"),
        F.col("o.allow").alias("open_allow"), F.col("o.reason").alias("open_reason"),
    )


@query(
    "visible_document_counts",
    f"""WITH {SQL_BASE}, {SQL_DOC_TOKENS}, sizes AS (SELECT signature, count(*) AS n FROM doc_tokens GROUP BY signature)
    SELECT principal_id, CAST(coalesce(sum(s.n), 0) AS BIGINT) AS visible_docs FROM members m LEFT JOIN sizes s ON list_has_any(s.signature, m.tokens) GROUP BY principal_id""",
)
def visible_document_counts(spark, sf):
    return AC.visible_counts(C.docs(spark, sf), C.principals(spark, sf))


def _suppliers(spark, sf):
    k = F.col("s_suppkey")
    return C.table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), k.cast("string")).alias("principal_id"),
        F.lit(True).alias("authenticated"),
        F.concat(F.lit("u"), (k % 40).cast("string")).alias("user_id"),
        F.concat(F.lit("user"), (k % 50).cast("string"), F.lit("@example.com")).alias("email"),
        F.lit("other.org").alias("domain"),
        F.array(F.concat(F.lit("Team"), (k % 7).cast("string"))).alias("groups"),
    )


@query(
    "authorized_pairs",
    f"""WITH {C.SQL_DOCS}, s AS (SELECT 's' || s_suppkey AS principal_id, 'u' || (s_suppkey % 40) AS user_id, 'user' || (s_suppkey % 50) || '@example.com' AS email,
      'team' || (s_suppkey % 7) AS grp FROM supplier)
    SELECT principal_id, doc_id FROM s JOIN docs d ON d.acl.is_public OR list_contains(d.acl.emails, s.email) OR list_contains(d.acl.users, s.user_id) OR list_contains(d.acl.groups, s.grp)""",
)
def authorized_pairs(spark, sf):
    """Every pair of a principal and a document that it may open."""
    return AC.authorize_pairs(C.docs(spark, sf), _suppliers(spark, sf))


@query(
    "group_expansion",
    f"""WITH {SQL_BASE}, gm AS (SELECT 'team' || r_regionkey AS g, unnest([lower(r_name), 'staff']) AS m FROM region),
    e AS (SELECT principal_id, unnest(groups) AS g FROM principals), f AS (SELECT principal_id, g FROM e UNION SELECT principal_id, m FROM e JOIN gm USING (g))
    SELECT principal_id, string_agg(g, '|' ORDER BY g) AS groups FROM f GROUP BY principal_id""",
)
def group_expansion(spark, sf):
    p = C.principals(spark, sf).withColumn("groups", F.transform("groups", lambda g: F.concat(F.lit("/"), F.upper(g))))
    gm = C.table(spark, sf, "region").select(
        F.concat(F.lit("team"), F.col("r_regionkey").cast("string")).alias("group_name"),
        F.array(F.lower("r_name"), F.lit("staff")).alias("mapped"),
    )
    return AC.expand_groups(p, gm).select("principal_id", F.array_join("groups", "|").alias("groups"))


@query(
    "authorized_evidence",
    f"""WITH {SQL_BASE}, e AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rank FROM lineitem),
    x AS (SELECT e.*, d.acl, p.*, {sql_reason('d.acl', 'p')} AS reason, {sql_allowed('d.acl', 'p')} AS visible FROM e
      JOIN (SELECT count(*) AS m FROM documents) c ON true JOIN docs d ON d.n = e.l_partkey % c.m
      JOIN orders o ON o.o_orderkey = e.l_orderkey JOIN principals p ON p.principal_id = 'p' || o.o_custkey)
    SELECT 'r' || l_orderkey AS query_id, CAST(count(*) AS BIGINT) AS evidence, CAST(count(*) FILTER (visible AND reason <> 'default_deny') AS BIGINT) AS allowed,
      coalesce(arg_max(reason, rank) FILTER (visible AND reason <> 'default_deny'), 'default_deny') AS reason FROM x GROUP BY l_orderkey""",
)
def authorized_evidence(spark, sf):
    li, orders = C.table(spark, sf, "lineitem"), C.table(spark, sf, "orders")
    total = C.table(spark, sf, "documents").agg(F.count("*")).scalar()
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    ranked = (
        li.select("l_orderkey", "l_partkey", F.row_number().over(w).alias("rank"))
        .join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        .select(
            F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("query_id"),
            F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("principal_id"),
            (F.col("l_partkey") % total).alias("n"),
            "rank",
        )
        .join(C.docs(spark, sf).select("n", "acl"), "n")
    )
    people = C.principals(spark, sf)
    ranked = ranked.join(people.select("principal_id"), "principal_id", "left_semi")
    allowed, runs = AC.authorize_ranked(ranked, people)
    kept = allowed.groupBy("query_id").agg(F.count("*").alias("allowed"))
    return (
        ranked.groupBy("query_id")
        .agg(F.count("*").alias("evidence"))
        .join(kept, "query_id", "left")
        .join(runs, "query_id")
        .select("query_id", "evidence", F.coalesce("allowed", F.lit(0)).alias("allowed"), "decision.reason")
    )


def _filters(i):
    empty = F.array().cast("array<string>")

    def some(cond, *v):
        return F.when(cond, F.array(*v)).otherwise(empty)

    return F.when(
        i % 8 != 7,
        F.struct(
            some(i % 8 == 0, F.lit(" google_drive ")).alias("sources"),
            some(i % 8 == 1, F.lit("application/pdf"), F.lit("text/plain")).alias("mime_types"),
            some(i % 8 == 2, F.concat(F.lit("doc"), i.cast("string")), F.lit("doc1")).alias("doc_ids"),
            some(i % 8 == 3, F.concat(F.lit("tag"), (i % 9).cast("string"))).alias("tags"),
            some(i % 8 == 4, F.lit("/05_DEALFLOW/")).alias("folder_prefixes"),
            some(i % 8 == 5, F.lit("06_legal_compliance//en")).alias("path_prefixes"),
            F.when(i % 8 == 6, F.lit("2024-03-01").cast("timestamp")).alias("modified_from"),
            F.when(i % 8 == 6, F.lit("2024-06-30").cast("timestamp")).alias("modified_to"),
        ),
    )


SQL_FILTER_TEST = """CASE i % 8 WHEN 0 THEN source = 'google_drive' WHEN 1 THEN mime_type IN ('application/pdf', 'text/plain') WHEN 2 THEN doc_id IN ('doc' || i, 'doc1')
      WHEN 3 THEN d.n % 9 = i % 9 WHEN 4 THEN starts_with(folder_path, '05_dealflow/') WHEN 5 THEN folder_path = '06_legal_compliance/en'
      WHEN 6 THEN modified_time BETWEEN TIMESTAMP '2024-03-01' AND TIMESTAMP '2024-06-30' ELSE true END"""


@query(
    "metadata_filters",
    f"""WITH {C.SQL_DOCS}, r AS (SELECT c_custkey AS i FROM customer), f AS (SELECT i % 72 AS k, min(i) AS i FROM r WHERE i % 8 <> 2 GROUP BY i % 72 UNION ALL SELECT i + 100000, i FROM r WHERE i % 8 = 2)
    SELECT r.i AS request, CAST(coalesce(c.n, 0) AS BIGINT) AS docs FROM r JOIN f ON f.k = CASE WHEN r.i % 8 = 2 THEN r.i + 100000 ELSE r.i % 72 END
    LEFT JOIN (SELECT f.i AS fi, count(*) AS n FROM f JOIN docs d ON {SQL_FILTER_TEST.replace('i %', 'f.i %').replace("|| i,", "|| f.i,")} GROUP BY f.i) c ON c.fi = f.i""",
)
def metadata_filters(spark, sf):
    i = F.col("c_custkey")
    asked = C.spread(C.table(spark, sf, "customer"), "c_custkey").select(
        i.alias("request"), F.concat(F.lit("q"), i.cast("string")).alias("query_id"), F.array(F.lit("*")).alias("tokens"), _filters(i).alias("filters")
    )
    pooled = AC.make_pools(asked)
    open_docs = C.docs(spark, sf).withColumn("signature", F.array(F.lit("*")))
    return AC.visible_filtered_counts(open_docs, pooled, NODE_COLUMNS).select("request", "docs")


@query(
    "metadata_filter_pushdown",
    f"""WITH {C.SQL_DOCS} SELECT doc_id FROM docs WHERE source = 'google_drive' AND mime_type IN ('application/pdf', 'text/plain') AND modified_time >= TIMESTAMP '2024-02-01' AND starts_with(folder_path || '/', '01_portfolio/')""",
)
def metadata_filter_pushdown(spark, sf):
    cond = FL.literal_filter(
        NODE_COLUMNS, sources=["google_drive"], mime_types=["application/pdf", "text/plain"], modified_from="2024-02-01", folder_prefixes=["01_portfolio"]
    )
    return C.docs(spark, sf).filter(cond).select("doc_id")


@query(
    "visible_and_filtered",
    f"""WITH {SQL_BASE}, r AS (SELECT m.*, CAST(replace(principal_id, 'p', '') AS BIGINT) AS i FROM members m)
    SELECT r.principal_id AS query_id, CAST(count(d.doc_id) AS BIGINT) AS docs FROM r LEFT JOIN docs d ON {sql_allowed('d.acl', 'r')} AND ({SQL_FILTER_TEST.replace('i %', 'r.i %').replace("|| i,", "|| r.i,")}) GROUP BY r.principal_id""",
)
def visible_and_filtered(spark, sf):
    p = AC.with_principal_tokens(C.spread(C.principals(spark, sf), "principal_id"))
    i = F.regexp_replace("principal_id", "p", "").cast("bigint")
    pooled = AC.make_pools(p.select(F.col("principal_id").alias("query_id"), "tokens", _filters(i).alias("filters")))
    return AC.visible_filtered_counts(AC.with_signature(C.docs(spark, sf)), pooled, NODE_COLUMNS).select("query_id", "docs")


@query(
    "access_preview",
    f"""WITH {SQL_BASE}, reg AS (SELECT d.*, TIMESTAMP '2024-01-01' + to_seconds((n * 7919) % 100000) AS updated_at FROM docs d),
    recent AS (SELECT * FROM reg WHERE source = 'google_drive' ORDER BY updated_at DESC, doc_id LIMIT 200)
    SELECT principal_id, (SELECT count(*) FROM recent) AS total_scanned, CAST(count(r.doc_id) AS BIGINT) AS allowed_count
    FROM principals p LEFT JOIN recent r ON {sql_allowed('r.acl', 'p')} GROUP BY principal_id""",
)
def access_preview(spark, sf):
    reg = C.docs(spark, sf).withColumn(
        "updated_at", F.timestamp_add("SECOND", ((F.col("n") * 7919) % 100000).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    )
    return preview_access(reg, C.principals(spark, sf), 200, ["google_drive"])


@query(
    "admin_roles",
    f"""WITH {SQL_BASE} SELECT principal_id, list_has_any(groups, ['team3', 'g1']) AS admin, false AS nobody FROM principals""",
)
def admin_roles(spark, sf):
    p = C.principals(spark, sf).withColumn("groups", F.transform("groups", lambda g: F.concat(F.lit(" /"), F.upper(g))))
    none = F.array().cast("array<string>")
    return p.select(
        "principal_id",
        ID.has_admin_role("groups", F.array(F.lit("/Team3"), F.lit("G1 "), F.lit(" "))).alias("admin"),
        ID.has_admin_role("groups", none).alias("nobody"),
    )


@query(
    "claim_checks",
    """SELECT c_custkey, c_nationkey % 3 <> 2 AS issuer_ok, c_custkey % 2 = 0 AS audience_ok FROM customer""",
)
def claim_checks(spark, sf):
    issuer = F.element_at(F.array(F.lit("HTTPS://Id.example.com/r/"), F.lit("https://alias.example.com"), F.lit("https://evil.example.com")), F.col("c_nationkey") % 3 + 1)
    aud = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("x"), F.lit("api"))).otherwise(F.array(F.lit("web")))
    return C.table(spark, sf, "customer").select(
        "c_custkey",
        ID.issuer_allowed(issuer, F.array(F.lit("https://id.example.com/r"), F.lit("https://ALIAS.example.com/"))).alias("issuer_ok"),
        ID.audience_allowed(aud, F.array(F.lit(" api "), F.lit(""))).alias("audience_ok"),
    )


@query(
    "membership_diff",
    """WITH cur AS (SELECT c_custkey AS u, lower(c_mktsegment) AS g FROM customer), tgt AS (SELECT c_custkey AS u, 'building' AS g FROM customer UNION SELECT c_custkey, 'ghost' FROM customer WHERE c_custkey % 3 = 0),
    known AS (SELECT DISTINCT lower(c_mktsegment) AS g FROM customer)
    SELECT u AS user_id, g AS group_name, 'add' AS action FROM tgt WHERE g IN (SELECT g FROM known) AND (u, g) NOT IN (SELECT u, g FROM cur)
    UNION ALL SELECT u, g, 'remove' FROM cur WHERE (u, g) NOT IN (SELECT u, g FROM tgt)
    UNION ALL SELECT u, g, 'unknown' FROM tgt WHERE g NOT IN (SELECT g FROM known)""",
)
def membership_diffs(spark, sf):
    c = C.table(spark, sf, "customer")
    current = c.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("group_name"))
    target = c.select(
        F.col("c_custkey").alias("user_id"),
        F.explode(F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit(" Building"), F.lit("ghost"))).otherwise(F.array(F.lit("Building"), F.lit(" ")))).alias("group_name"),
    )
    changes, unknown = membership_diff(current, target, current)
    return changes.unionByName(unknown.select("user_id", "group_name", F.lit("unknown").alias("action")))
