"""Queries over scalar text, path, identifier and identity expressions."""

from pyspark.sql import functions as F

from wardstone import vocab as V
from wardstone.catalog import corpus as C
from wardstone.catalog.base import arr, collapse, lit, ordered_distinct, query, strip, tokens
from wardstone.functions import answers as AN
from wardstone.functions import identity as ID
from wardstone.functions import ids as I
from wardstone.functions import paths as P
from wardstone.functions import text as T


def joined(c, sep="|"):
    return F.array_join(c, sep)


SQL_URL_PATH = r"regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/', '\\\\//', 'g')"
SQL_NORM = r"trim(regexp_replace(trim(replace({x}, '\', '/')), '/{{2,}}', '/', 'g'), '/')"


@query(
    "path_normalize",
    f"""SELECT page_id, {SQL_NORM.format(x=SQL_URL_PATH)} AS path FROM pages""",
)
def path_normalize(spark, sf):
    return C.table(spark, sf, "pages").select("page_id", P.normalize_path(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "/", r"\\\\//")).alias("path"))


@query(
    "path_ancestors",
    f"""WITH p AS (SELECT page_id, string_split(lower({SQL_NORM.format(x="regexp_replace(url, '^[a-z]+://', '')")}), '/') AS parts FROM pages)
    SELECT page_id, array_to_string(list_transform(range(1, len(parts) + 1), lambda i: array_to_string(parts[1:i], '/')), '|') AS ancestors FROM p""",
)
def path_ancestors(spark, sf):
    return C.table(spark, sf, "pages").select("page_id", joined(P.path_ancestors(F.regexp_replace("url", "^[a-z]+://", ""))).alias("ancestors"))


@query(
    "modified_time_parse",
    """SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS modified FROM events""",
)
def modified_time_parse(spark, sf):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("bad "), iso)).otherwise(F.concat(iso, F.lit("Z")))
    return C.table(spark, sf, "events").select(
        "event_id", F.date_format(P.parse_modified_time(raw), "yyyy-MM-dd HH:mm:ss").alias("modified")
    )


@query(
    "text_normalize",
    rf"""SELECT doc_id, md5(regexp_replace({strip("replace(text, chr(10), repeat(chr(10), CAST(doc_id % 5 + 1 AS INTEGER)))")}, '\n{{3,}}', chr(10) || chr(10), 'g')) AS digest FROM documents""",
)
def text_normalize(spark, sf):
    spread = F.replace("text", F.lit("\n"), F.repeat(F.lit("\n"), (F.col("doc_id") % 5 + 1).cast("int")))
    return C.table(spark, sf, "documents").select("doc_id", F.md5(T.normalize_text(spread)).alias("digest"))


@query(
    "whitespace_collapse",
    f"""WITH f AS (SELECT doc_id, {collapse('text')} AS flat FROM documents)
    SELECT doc_id, md5(CASE WHEN length(flat) > 700 THEN rtrim(left(flat, 700)) ELSE flat END) AS digest, md5(flat) AS whole FROM f""",
)
def whitespace_collapse(spark, sf):
    return C.table(spark, sf, "documents").select("doc_id", F.md5(T.collapse_ws("text", 700)).alias("digest"), F.md5(T.collapse_ws("text")).alias("whole"))


@query(
    "nul_strip",
    """SELECT event_id, event_type, props, 'k=' || event_type AS nested FROM events""",
)
def nul_strip(spark, sf):
    nul = F.lit("\x00")
    dirty = C.table(spark, sf, "events").select(
        "event_id",
        F.concat(nul, "event_type").alias("event_type"),
        F.concat("props", nul).alias("props"),
        F.struct(F.create_map(F.concat(F.lit("k"), nul), F.array(F.concat(nul, "event_type", nul))).alias("m")).alias("deep"),
    )
    clean = T.strip_nul(dirty)
    entry = F.map_entries("deep.m")[0]
    return clean.select("event_id", "event_type", "props", F.concat(entry["key"], F.lit("="), entry["value"][0]).alias("nested"))


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf):
    return C.table(spark, sf, "documents").select("doc_id", T.content_hash("text").alias("content_hash"))


@query(
    "user_pseudonym",
    f"""WITH {C.SQL_PRINCIPALS}, r AS (SELECT principal_id, CASE WHEN authenticated THEN upper(user_id) || ' ' ELSE '' END AS u,
      upper(email) AS m FROM principals), w AS (SELECT principal_id, trim(lower(coalesce(nullif(u, ''), nullif(m, ''), ''))) AS who FROM r)
    SELECT principal_id, CASE WHEN who <> '' THEN sha256(who) END AS user_hash FROM w""",
)
def user_pseudonym(spark, sf):
    p = C.principals(spark, sf)
    uid = F.when(F.col("authenticated"), F.concat(F.upper("user_id"), F.lit(" "))).otherwise(F.lit(""))
    return p.select("principal_id", ID.pseudonymize(uid, F.upper("email")).alias("user_hash"))


@query(
    "group_normalize",
    """SELECT c_custkey, 'household/' || lower(c_mktsegment) AS group_name FROM customer""",
)
def group_normalize(spark, sf):
    raw = F.concat(F.lit(" //Household/"), "c_mktsegment", F.lit(" "))
    return C.table(spark, sf, "customer").select("c_custkey", ID.normalize_group(raw).alias("group_name"))


@query(
    "email_pick",
    f"""WITH {C.SQL_PRINCIPALS} SELECT principal_id, CASE WHEN email IS NOT NULL THEN email ELSE 'c' || principal_id || '@x.org' END AS email FROM principals""",
)
def email_pick(spark, sf):
    p = C.principals(spark, sf)
    return p.select(
        "principal_id",
        ID.first_email_like("user_id", F.upper("email"), F.concat(F.lit(" C"), "principal_id", F.lit("@X.org "))).alias("email"),
    )


def _claims():
    k = F.col("c_custkey")
    return F.from_json(
        F.to_json(
            F.struct(
                F.when(k % 4 == 0, F.concat(F.lit("User"), k.cast("string"), F.lit("@Example.com"))).alias("email"),
                F.concat(F.lit("name"), k.cast("string"), F.when(k % 2 == 0, F.lit("@corp.org")).otherwise(F.lit(""))).alias("preferred_username"),
                F.when(k % 3 == 0, F.concat(F.lit("sub"), k.cast("string"))).alias("sub"),
                F.when(k % 3 == 0, F.array(F.lit("/B"), F.lit("a"))).alias("groups"),
                F.when(k % 3 == 1, F.struct(F.array(F.lit("Role1"), F.lit("")).alias("roles"))).alias("realm_access"),
                F.create_map(
                    F.lit("web"), F.struct(F.array(F.lit("z"), F.lit("/Y")).alias("roles")),
                    F.lit("api"), F.struct(F.array(F.lit("x")).alias("roles")),
                ).alias("resource_access"),
            )
        ),
        ID.CLAIMS_SCHEMA,
    )


def _person(c):
    return [c["user_id"].alias("user_id"), c["email"].alias("email"), c["domain"].alias("domain"), joined(c["groups"]).alias("groups")]


@query(
    "claims_to_principal",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'sub' || c_custkey ELSE 'name' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '@corp.org' ELSE '' END END AS user_id,
      CASE WHEN c_custkey % 4 = 0 THEN 'user' || c_custkey || '@example.com' WHEN c_custkey % 2 = 0 THEN 'name' || c_custkey || '@corp.org' END AS email,
      CASE WHEN c_custkey % 4 = 0 THEN 'example.com' WHEN c_custkey % 2 = 0 THEN 'corp.org' END AS domain,
      CASE c_custkey % 3 WHEN 0 THEN 'a|b' WHEN 1 THEN 'role1' ELSE 'x|y|z' END AS groups FROM customer""",
)
def claims_to_principal(spark, sf):
    rows = C.table(spark, sf, "customer").select("c_custkey", _claims().alias("c"))
    return rows.withColumn("p", ID.entitlements_from_claims(F.col("c"))).select("c_custkey", *_person(F.col("p")))


@query(
    "context_to_principal",
    """SELECT c_custkey, c_custkey % 2 = 0 OR c_custkey % 3 = 0 AS authenticated, CASE WHEN c_custkey % 2 = 0 THEN 'me' || c_custkey || '@corp.org' END AS email,
      CASE WHEN c_custkey % 5 = 0 THEN 'given.net' WHEN c_custkey % 2 = 0 THEN 'corp.org' END AS domain, lower(c_mktsegment) AS groups FROM customer""",
)
def context_to_principal(spark, sf):
    k = F.col("c_custkey")
    e = ID.entitlements_from_context(
        F.when(k % 3 == 0, "U1"),
        F.when(k % 2 == 0, F.concat(F.lit("Me"), k.cast("string"), F.lit("@Corp.org"))),
        F.when(k % 5 == 0, "Given.net"),
        F.array("c_mktsegment"),
    )
    rows = C.table(spark, sf, "customer").select("c_custkey", e.alias("p"))
    return rows.select("c_custkey", "p.authenticated", "p.email", "p.domain", joined("p.groups").alias("groups"))


@query(
    "userinfo_merge",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'sub' || c_custkey ELSE 'info' || c_custkey END AS sub,
      CASE WHEN c_custkey % 4 = 0 THEN 'User' || c_custkey || '@Example.com' ELSE 'info@x.org' END AS email,
      CASE WHEN c_custkey % 3 = 0 THEN '/B|a' WHEN c_custkey % 3 = 1 AND c_custkey % 4 = 0 THEN NULL ELSE 'ig' END AS groups
    FROM (SELECT c_custkey FROM customer) WHERE NOT (c_custkey % 4 = 0 AND c_custkey % 3 = 1)
    UNION ALL SELECT c_custkey, NULL, 'User' || c_custkey || '@Example.com', NULL FROM customer WHERE c_custkey % 4 = 0 AND c_custkey % 3 = 1""",
)
def userinfo_merge(spark, sf):
    k = F.col("c_custkey").cast("string")
    users = C.table(spark, sf, "customer").select("c_custkey", _claims().alias("c"))
    infos = C.table(spark, sf, "customer").select(
        "c_custkey",
        F.from_json(
            F.concat(F.lit('{"email":"info@x.org","groups":["ig"],"sub":"info'), k, F.lit('"}')), ID.CLAIMS_SCHEMA
        ).alias("answer"),
    )
    # several issuers may answer; the first in order wins
    ranked = infos.withColumn("issuer_rank", F.explode(F.array(F.lit(2), F.lit(1)))).groupBy("c_custkey").agg(
        F.min_by("answer", "issuer_rank").alias("info")
    )
    merged = users.join(ranked, "c_custkey", "left").withColumn("m", ID.merge_userinfo(F.col("c"), F.col("info")))
    return merged.select("c_custkey", "m.sub", "m.email", joined("m.groups").alias("groups"))


@query(
    "group_map_normalize",
    """SELECT n_nationkey, 'nation_' || n_nationkey || '=a|b;r' || n_regionkey || '=solo' AS mapping FROM nation WHERE n_nationkey % 5 <> 0
    UNION ALL SELECT n_nationkey, '' FROM nation WHERE n_nationkey % 5 = 0""",
)
def group_map_normalize(spark, sf):
    n = C.table(spark, sf, "nation")
    raw = F.when(F.col("n_nationkey") % 5 == 0, "{broken").otherwise(
        F.concat(
            F.lit('{"/'), "n_name", F.lit('": ["/B", "a ", ""], " ": ["x"], "none": [], "num": 3, "R'), F.col("n_regionkey").cast("string"), F.lit('": "Solo"}')
        )
    )
    m = n.select("n_nationkey", F.map_entries(ID.normalize_group_map(raw)).alias("e"))
    line = F.transform(F.array_sort("e"), lambda e: F.concat(e["key"], F.lit("="), joined(e["value"])))
    return m.select("n_nationkey", F.array_join(line, ";").alias("mapping"))


@query(
    "tokenize",
    f"""SELECT doc_id, len({tokens('text')}) AS n, md5(array_to_string({tokens('text')}, ' ')) AS digest FROM documents""",
)
def tokenize(spark, sf):
    t = C.table(spark, sf, "documents").select("doc_id", T.tokenize("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


SQL_TERMS = ordered_distinct("t")


@query(
    "meaningful_terms",
    f"""WITH {C.SQL_QUESTIONS}, k AS (SELECT n, list_filter({tokens('query')}, lambda t: length(t) >= 3 AND NOT list_contains({arr(V.ANSWERABILITY_STOPWORDS)}, t)) AS t FROM questions)
    SELECT n, array_to_string({SQL_TERMS}, ' ') AS terms FROM k""",
)
def meaningful_terms(spark, sf):
    return C.questions(spark, sf).select("n", joined(T.meaningful_terms("query"), " ").alias("terms"))


@query(
    "raw_markers",
    f"""WITH {C.SQL_QUESTIONS}, k AS (SELECT n, list_filter({tokens('query')}, lambda t: length(t) >= 2) AS t FROM questions),
    d AS (SELECT n, {SQL_TERMS} AS t FROM k),
    e AS (SELECT n, flatten(list_transform(t, lambda x: CASE WHEN x LIKE '%s' AND length(x) > 3 THEN [x, left(x, length(x) - 1)] ELSE [x] END)) AS t FROM d)
    SELECT n, array_to_string({SQL_TERMS}, ' ') AS markers FROM e""",
)
def raw_markers(spark, sf):
    return C.questions(spark, sf).select("n", joined(T.raw_markers("query"), " ").alias("markers"))


SQL_EXPANSION = "MAP {" + ", ".join(f"{lit(k)}: {arr(v)}" for k, v in V.QUERY_TERM_EXPANSIONS.items()) + "}"


@query(
    "expanded_query_terms",
    f"""WITH {C.SQL_QUESTIONS}, b AS (SELECT n, lower(query) AS q, list_filter(list_transform({tokens('query')},
      lambda v: CASE WHEN length(v) > 4 AND v LIKE '%ies' THEN left(v, length(v) - 3) || 'y' WHEN length(v) > 4 AND v LIKE '%s' THEN left(v, length(v) - 1) ELSE v END),
      lambda t: length(t) > 2 AND NOT list_contains({arr(V.QUERY_STOPWORDS)}, t)) AS t FROM questions),
    e AS (SELECT n, list_concat(t, flatten(list_transform(t, lambda x: coalesce({SQL_EXPANSION}[x], []))),
      CASE WHEN contains(q, 'capital commitment') THEN {arr(V.PHRASE_EXPANSION)} ELSE [] END) AS t FROM b)
    SELECT n, array_to_string(list_sort(list_distinct(t)), '|') AS terms FROM e""",
)
def expanded_query_terms(spark, sf):
    return C.questions(spark, sf).select("n", joined(T.expanded_query_terms("query")).alias("terms"))


@query(
    "doc_reference_normalize",
    f"""WITH {C.SQL_DOCS} SELECT doc_id, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS reference FROM docs""",
)
def doc_reference_normalize(spark, sf):
    return C.docs(spark, sf).select("doc_id", T.normalize_doc_ref("name").alias("reference"))


@query(
    "doc_aliases",
    f"""WITH {C.SQL_DOCS} SELECT doc_id, array_to_string([trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')),
      trim(regexp_replace(regexp_replace(lower(name), '\\.(pdf|docx|txt|xlsx)$', ''), '[^a-z0-9]+', ' ', 'g')), doc_id], '|') AS aliases FROM docs""",
)
def doc_aliases(spark, sf):
    return C.docs(spark, sf).select("doc_id", joined(T.doc_aliases("name", F.lit(None).cast("string"), "doc_id")).alias("aliases"))


@query(
    "embedding_text",
    f"""WITH {C.SQL_DOCS} SELECT doc_id, md5('title: ' || name || chr(10) || 'page: ' || (n % 7) || chr(10) || 'type: ' || mime_type || chr(10)
      || CASE WHEN n % 3 = 0 THEN 'sheet: S' || n || chr(10) || 'tabular_type: row_block' || chr(10) || 'rows: 2-' || n || chr(10)
        || 'headers: h' || n || ', x' || chr(10) ELSE '' END || text) AS digest FROM docs""",
)
def embedding_text(spark, sf):
    n = F.col("n")
    d = C.docs(spark, sf).withColumns(
        {
            "page": n % 7,
            "sheet_name": F.when(n % 3 == 0, F.concat(F.lit(" S"), n.cast("string"))),
            "tabular_node_type": F.when(n % 3 == 0, "row_block"),
            "row_start": F.when(n % 3 == 0, F.lit(2)),
            "column_headers": F.when(n % 3 == 0, F.array(F.concat(F.lit("h"), n.cast("string")), F.lit("x"))),
        }
    )
    built = I.embedding_text(
        "text", name="name", page="page", mime_type="mime_type", sheet_name="sheet_name", tabular_node_type="tabular_node_type",
        row_start="row_start", row_end="n", column_headers="column_headers",
    )
    return d.select("doc_id", F.md5(built).alias("digest"))


@query("hash_vector", f"""SELECT item_id, round(v[1], 6) AS first, round(v[64], 6) AS last, round(list_sum(v), 4) AS total
    FROM (SELECT item_id, {C.sql_hash_vector('text')} AS v FROM benchmark)""")
def hash_vector(spark, sf):
    v = C.table(spark, sf, "benchmark").select("item_id", I.hash_embedding("text", C.VECTOR_DIM).alias("v"))
    return v.select(
        "item_id",
        F.round(F.col("v")[0].cast("double"), 6).alias("first"),
        F.round(F.col("v")[63].cast("double"), 6).alias("last"),
        F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"),
    )


@query(
    "point_ids",
    f"""WITH {C.SQL_DOCS}, {C.SQL_NODES}, k AS (SELECT doc_id || '::n' || seq || '::' || left(sha256(text), 8) AS node_id, doc_id || '::c' || seq AS chunk_id FROM nodes),
    h AS (SELECT *, sha1(unhex('{V.UUID_NAMESPACE_URL}') || encode(node_id)) AS h FROM k)
    SELECT node_id, chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
      || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h""",
)
def point_ids(spark, sf):
    return C.nodes(spark, sf).select("node_id", "chunk_id", I.stable_point_id("node_id").alias("point_id"))


@query(
    "tabular_and_image_ids",
    """SELECT l_orderkey, l_linenumber, 'ord' || l_orderkey || '::' || CASE WHEN l_linenumber = 1 THEN 'workbook_summary::workbook::na-na' ELSE 'row_block::' || l_returnflag || '::' || l_linenumber || '-' || CASE WHEN l_partkey = 0 THEN 'na' ELSE CAST(l_partkey AS VARCHAR) END END AS tabular_id,
      'ord' || l_orderkey || '::img::' || l_linenumber || '::' || CASE WHEN l_linestatus = 'O' THEN 'page' ELSE 'embedded::' || l_suppkey END || '::' || left(sha256(l_returnflag), 8) AS image_id FROM lineitem""",
)
def tabular_and_image_ids(spark, sf):
    li = C.table(spark, sf, "lineitem")
    doc = F.concat(F.lit("ord"), F.col("l_orderkey").cast("string"))
    first = F.col("l_linenumber") == 1
    return li.select(
        "l_orderkey",
        "l_linenumber",
        I.tabular_chunk_id(
            doc, F.when(first, "workbook_summary").otherwise("row_block"), F.when(~first, F.col("l_returnflag")),
            F.when(~first, F.col("l_linenumber")), F.when(~first, F.col("l_partkey")),
        ).alias("tabular_id"),
        I.with_hash8(
            I.image_chunk_id(doc, "l_linenumber", F.when(F.col("l_linestatus") != "O", F.col("l_suppkey"))), F.sha2("l_returnflag", 256)
        ).alias("image_id"),
    )


SQL_CITE_NAME = "'**' || name || '** ('"


@query(
    "citation_labels",
    f"""WITH {C.SQL_DOCS} SELECT doc_id, {SQL_CITE_NAME} || CASE WHEN n % 3 = 0 THEN 'sheet=S' || n || ', ' ELSE '' END
      || CASE WHEN n % 4 = 0 THEN 'rows=1-' || n || ', ' WHEN n % 4 = 1 THEN 'range=A1:B' || n || ', ' WHEN n % 4 = 2 THEN 'page=' || n || ', ' ELSE '' END
      || 'node=' || doc_id || '::n0, chunk=None)' AS label FROM docs""",
)
def citation_labels(spark, sf):
    n = F.col("n")
    d = C.docs(spark, sf).withColumns(
        {
            "sheet_name": F.when(n % 3 == 0, F.concat(F.lit("S"), n.cast("string"))),
            "row_start": F.when(n % 4 == 0, F.lit(1)),
            "row_end": F.when(n % 4 == 0, n),
            "cell_range": F.when(n % 4 < 2, F.concat(F.lit("A1:B"), n.cast("string"))),
            "page": F.when(n % 4 == 2, n),
            "node_id": F.concat("doc_id", F.lit("::n0")),
        }
    )
    cols = {c: c for c in ("doc_id", "name", "sheet_name", "row_start", "row_end", "cell_range", "page", "node_id")}
    c = d.select(AN.citation(cols).alias("c")).select("c.*")
    return c.select("doc_id", AN.citation_label({k: k for k in c.columns}).alias("label"))


@query(
    "inventory_category",
    f"""WITH {C.SQL_DOCS} SELECT doc_id, CASE WHEN n % 7 = 0 THEN CASE WHEN n % 2 = 0 THEN 'Google Drive' ELSE 'Local Folder' END
      ELSE (['Portfolio', 'Fund Management', 'Due Diligence', 'Market Research', 'Dealflow', 'Legal Compliance'])[n % 6 + 1] END AS category FROM docs""",
)
def inventory_category(spark, sf):
    folder = F.when(F.col("n") % 7 != 0, F.concat(F.lit("root/"), "folder_path"))
    return C.docs(spark, sf).select(
        "doc_id", P.inventory_category(folder, F.lit(None).cast("string"), "source", F.lit(None).cast("string")).alias("category")
    )


@query(
    "generation_options",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'custom' ELSE 'base' END AS model, CASE WHEN event_id % 2 = 0 THEN greatest(0.0::DOUBLE, least(1.5::DOUBLE, value / 50 - 0.5)) ELSE 0.0::DOUBLE END AS temperature,
      CASE WHEN event_id % 5 = 0 THEN greatest(0.1::DOUBLE, least(1.0::DOUBLE, value / 100)) END AS top_p,
      CASE WHEN event_id % 7 = 0 THEN greatest(64, least(2048, CAST(user_id * 20 AS INTEGER))) ELSE 384 END AS max_tokens FROM events""",
)
def generation_options(spark, sf):
    i = F.col("event_id")
    o = AN.generation_options(
        F.when(i % 3 == 0, " custom ").when(i % 3 == 1, ""),
        F.when(i % 2 == 0, F.col("value") / 50 - 0.5),
        F.when(i % 5 == 0, F.col("value") / 100),
        F.when(i % 7 == 0, (F.col("user_id") * 20).cast("int")),
        "base",
    )
    return C.table(spark, sf, "events").select("event_id", o.alias("o")).select("event_id", "o.*")


SQL_META = "t"
for _p in V.META_PATTERNS:
    SQL_META = f"regexp_replace({SQL_META}, {lit('(?i)' + _p)}, '', 'g')"


@query(
    "meta_language_strip",
    rf"""WITH {C.SQL_QUESTIONS}, r AS (SELECT n, {strip("CASE n % 3 WHEN 0 THEN ': Segun el texto, ' WHEN 1 THEN 'Based on the provided context: ' ELSE '- ' END || query || ' as seen in the text, it is so. In the text'")} AS t FROM questions),
    s AS (SELECT n, {SQL_META} AS t FROM r)
    SELECT n, {strip(r"regexp_replace(regexp_replace(t, '\s{2,}', ' ', 'g'), '^[,;:\-\s]+', '')")} AS answer FROM s""",
)
def meta_language_strip(spark, sf):
    n = F.col("n")
    lead = F.when(n % 3 == 0, ": Segun el texto, ").when(n % 3 == 1, "Based on the provided context: ").otherwise("- ")
    raw = F.concat(lead, "query", F.lit(" as seen in the text, it is so. In the text"))
    return C.questions(spark, sf).select("n", AN.strip_meta_language(raw).alias("answer"))


@query(
    "safe_doc_ids",
    """SELECT page_id, replace(replace(url, '/', '_'), ':', '_') AS safe_id FROM pages""",
)
def safe_doc_ids(spark, sf):
    return C.table(spark, sf, "pages").select("page_id", T.safe_doc_id("url").alias("safe_id"))


@query(
    "clean_cells",
    f"""WITH f AS (SELECT doc_id, {collapse('text')} AS flat FROM documents)
    SELECT doc_id, CASE WHEN length(flat) > 200 THEN rtrim(left(flat, 199)) || '…' ELSE flat END AS cell FROM f
    UNION ALL SELECT doc_id + 2000000000, md5(flat) FROM f
    UNION ALL SELECT o_orderkey + 1000000000, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') FROM orders""",
)
def clean_cells(spark, sf):
    from wardstone.operators.tabular import cell_text, clean_cell

    docs = C.table(spark, sf, "documents").select("doc_id", clean_cell("text").alias("cell"))
    whole = C.table(spark, sf, "documents").select((F.col("doc_id") + 2000000000).alias("doc_id"), F.md5(clean_cell("text", None)).alias("cell"))
    dates = C.table(spark, sf, "orders").select(
        (F.col("o_orderkey") + 1000000000).alias("doc_id"), clean_cell(cell_text("o_orderdate", "timestamp")).alias("cell")
    )
    return docs.unionByName(whole).unionByName(dates)


@query(
    "column_letters",
    """WITH x AS (SELECT p_partkey, CAST(p_partkey % 18278 AS INTEGER) + 1 AS k FROM part)
    SELECT p_partkey, CASE WHEN k <= 26 THEN chr(64 + k) WHEN k <= 702 THEN chr(65 + (k - 27) // 26) || chr(65 + (k - 27) % 26)
      ELSE chr(65 + (k - 703) // 676) || chr(65 + ((k - 703) // 26) % 26) || chr(65 + (k - 703) % 26) END AS letter FROM x""",
)
def column_letters(spark, sf):
    return C.table(spark, sf, "part").select("p_partkey", I.column_letter(F.col("p_partkey") % 18278 + 1).alias("letter"))


@query(
    "model_verdict_parse",
    """SELECT event_id, CASE WHEN event_id % 7 IN (5, 6) THEN NULL ELSE event_id % 2 = 0 END AS answerable,
      CASE WHEN event_id % 7 IN (5, 6) THEN NULL WHEN event_id % 3 = 0 THEN 'r' || user_id WHEN event_id % 2 = 0 THEN 'supported' ELSE 'insufficient_evidence' END AS reason,
      CASE WHEN event_id % 7 IN (5, 6) THEN NULL WHEN event_id % 2 = 1 THEN '' WHEN event_id % 4 = 0 THEN '2,1' ELSE '1' END AS support FROM events""",
)
def model_verdict_parse(spark, sf):
    i = F.col("event_id")
    body = F.concat(
        F.lit('Verdict: {"answerable": '), F.when(i % 2 == 0, "true").otherwise("false"),
        F.when(i % 3 == 0, F.concat(F.lit(', "reason": "r'), F.col("user_id").cast("string"), F.lit('"'))).otherwise(F.lit("")),
        F.when(i % 4 == 0, F.lit(', "support_indices": [2, "1", 9, "x", 2]')).otherwise(F.lit("")), F.lit("} end"),
    )
    raw = F.when(i % 7 == 5, "no object").when(i % 7 == 6, "{broken} and {more}").otherwise(body)
    v = C.spread(C.table(spark, sf, "events"), "event_id").select("event_id", AN.parse_verdict(raw, F.lit(3)).alias("v"))
    return v.select("event_id", "v.answerable", "v.reason", F.array_join("v.support", ",").alias("support"))


@query(
    "model_selector_parse",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 AND user_id % 2 = 0 THEN 'd' || user_id END AS doc_id FROM events""",
)
def model_selector_parse(spark, sf):
    i, u = F.col("event_id"), F.col("user_id").cast("string")
    raw = F.concat(
        F.lit('Sure {"scope": "'), F.when(i % 3 == 0, "Single_Document").otherwise("none"), F.lit('", "doc_id": "d'), u, F.lit('"}')
    )
    known = F.when(F.col("user_id") % 2 == 0, F.array(F.concat(F.lit("d"), u))).otherwise(F.array(F.lit("other")))
    return C.table(spark, sf, "events").select("event_id", AN.parse_selector(raw, known).alias("doc_id"))


@query(
    "ordered_union",
    """SELECT doc_id, array_to_string(CASE WHEN source = lang THEN [source, 'x'] ELSE [source, 'x', lang] END, '|') AS merged FROM documents""",
)
def ordered_union(spark, sf):
    a = F.array(F.concat(F.lit(" "), "source"), F.lit("x"), F.lit(""))
    b = F.array("lang", "source", F.lit(None).cast("string"))
    return C.table(spark, sf, "documents").select("doc_id", joined(T.ordered_union(a, b)).alias("merged"))


@query(
    "useful_text",
    f"""WITH f AS (SELECT conv_id, turn, {collapse("CASE WHEN turn % 2 = 0 THEN text ELSE left(text, 45) END")} AS t FROM conversations)
    SELECT conv_id, turn, length(t) >= 40 AND len(string_split(t, ' ')) >= 6 AS useful FROM f""",
)
def useful_text(spark, sf):
    t = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.left("text", F.lit(45)))
    return C.table(spark, sf, "conversations").select("conv_id", "turn", T.has_useful_text(t).alias("useful"))
