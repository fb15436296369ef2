"""Queries over document targeting, inventory, clarification, answerability and answers."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardstone import vocab as V
from wardstone.catalog import corpus as C
from wardstone.catalog.access_queries import sql_allowed
from wardstone.catalog.base import arr, has_any, lit, matches, ordered_distinct, query, strip, tokens
from wardstone.functions.answers import enough_citations, used_citations
from wardstone.operators import access as AC
from wardstone.operators import answers as OA
from wardstone.operators import inventory as INV
from wardstone.operators import targeting as TG
from wardstone.operators.answerability import answerability, judge_prompt
from wardstone.operators.skew import kept_table
from wardstone.plans.answering import docs_with_pools

SQL_BASE = f"{C.SQL_DOCS}, {C.SQL_QUESTIONS}"


def sql_ref(x):
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def sql_stem(x):
    return rf"regexp_replace({x}, '(?i)\.(pdf|docx|txt|md|doc|xlsx)$', '')"


def sql_doc_tokens(x):
    return f"list_distinct(list_filter({tokens(x)}, lambda t: length(t) > 1 AND NOT list_contains({arr(V.QUERY_STOPWORDS)}, t)))"


SQL_ALIAS = rf"""aliases AS (SELECT doc_id, unnest([{sql_ref('name')}, {sql_ref(sql_stem('name'))}, doc_id]) AS alias FROM docs),
  alias_hits AS (SELECT DISTINCT q.n, a.doc_id FROM questions q JOIN aliases a ON length(a.alias) >= 5 AND contains({sql_ref('q.query')}, a.alias))"""
SQL_TITLE = f"""qt AS (SELECT n, unnest(t) AS token FROM (SELECT n, {sql_doc_tokens('query')} AS t FROM questions) WHERE len(t) >= 2),
  dt AS (SELECT doc_id, unnest({sql_doc_tokens('name')}) AS token FROM docs),
  ov AS (SELECT n, doc_id, count(*) + max((regexp_matches(token, '^20[0-9]{{2}}$'))::INTEGER) + max((regexp_matches(token, '^q[1-4]$'))::INTEGER) AS score FROM qt JOIN dt USING (token) GROUP BY n, doc_id HAVING count(*) >= 2),
  tops AS (SELECT n, max(score) AS best FROM ov GROUP BY n),
  title_hits AS (SELECT n, min(doc_id) AS doc_id FROM ov JOIN tops USING (n) WHERE score = best AND best >= 3 GROUP BY n HAVING count(*) = 1)"""


def _questions(spark, sf):
    return C.questions(spark, sf).withColumn("query_id", F.col("n").cast("string"))


@query("alias_targets", f"WITH {SQL_BASE}, {SQL_ALIAS} SELECT n, doc_id FROM alias_hits")
def alias_targets(spark, sf):
    hits = TG.alias_matches(_questions(spark, sf), C.docs(spark, sf))
    return hits.select(F.col("query_id").cast("bigint").alias("n"), "doc_id")


@query("title_targets", f"WITH {SQL_BASE}, {SQL_TITLE} SELECT n, doc_id FROM title_hits")
def title_targets(spark, sf):
    hits = TG.title_matches(_questions(spark, sf), C.docs(spark, sf))
    return hits.select(F.col("query_id").cast("bigint").alias("n"), "doc_id")


@query(
    "document_targets",
    f"""WITH {SQL_BASE}, {SQL_ALIAS}, {SQL_TITLE}, merged AS (SELECT n, doc_id FROM alias_hits UNION ALL SELECT n, doc_id FROM title_hits WHERE n NOT IN (SELECT n FROM alias_hits))
    SELECT n, doc_id, 'exact_match' AS selector FROM merged UNION ALL SELECT n, 'doc' || n, 'llm_selector' FROM questions WHERE n % 5 = 0 AND n NOT IN (SELECT n FROM merged)""",
)
def document_targets(spark, sf):
    q = _questions(spark, sf)
    picked = q.filter("n % 5 = 0").select("query_id", F.concat(F.lit("doc"), "query_id").alias("doc_id"))
    hits = TG.target_docs(q, C.docs(spark, sf), picked)
    return hits.select(F.col("query_id").cast("bigint").alias("n"), "doc_id", "selector")


#: Documents go in runs of six, run r to conversation r of as many as there are (or to all of them in turn), so every document is dealt
DEAL = 6
SQL_DEALS = f"deals AS (SELECT least((SELECT max(conv_id) + 1 FROM conversations), (SELECT max(n) // {DEAL} + 1 FROM docs)) AS k)"
SQL_DEALT = f"questions q JOIN deals ON true JOIN docs d ON (d.n // {DEAL}) % deals.k = (q.n // 8) % deals.k"
SQL_CANDIDATES = f"{SQL_DEALS}, cand AS (SELECT q.n, d.doc_id, d.name, d.n AS dn FROM {SQL_DEALT})"


def _dealt(spark, sf, *columns):
    """Questions and documents with ``k``, the number of the deal they share."""
    convs = C.table(spark, sf, "conversations").agg((F.max("conv_id") + 1).alias("k"))
    runs = C.table(spark, sf, "documents").agg((F.floor(F.max("doc_id") / DEAL) + 1).alias("k"))
    deals = convs.unionByName(runs).agg(F.min("k")).scalar()
    q = _questions(spark, sf).withColumn("k", F.pmod(F.floor(F.col("n") / 8), deals))
    return q, C.docs(spark, sf).select(*columns, F.col("n").alias("dn"), F.pmod(F.floor(F.col("n") / DEAL), deals).alias("k"))


@query(
    "targets_among_candidates",
    rf"""WITH {SQL_BASE}, {SQL_CANDIDATES}, x AS (SELECT c.n, c.doc_id, list_filter([{sql_ref('c.name')}, {sql_ref(sql_stem('c.name'))}, c.doc_id],
        lambda a: length(a) >= 5 AND contains({sql_ref('q.query')}, a)) AS hit, list_intersect({sql_doc_tokens('c.name')}, {sql_doc_tokens('q.query')}) AS shared, len({sql_doc_tokens('q.query')}) AS k FROM cand c JOIN questions q USING (n)),
    s AS (SELECT n, doc_id, len(hit) > 0 AS hit, CASE WHEN k >= 2 AND len(shared) >= 2 THEN len(shared) + (len(list_filter(shared, lambda t: regexp_matches(t, '^20[0-9]{{2}}$'))) > 0)::INTEGER + (len(list_filter(shared, lambda t: regexp_matches(t, '^q[1-4]$'))) > 0)::INTEGER END AS score FROM x),
    w AS (SELECT *, bool_or(hit) OVER (PARTITION BY n) AS any_hit, max(score) OVER (PARTITION BY n) AS best FROM s), t AS (SELECT *, count(*) FILTER (score = best) OVER (PARTITION BY n) AS ties FROM w)
    SELECT n, doc_id FROM t WHERE hit OR coalesce(NOT any_hit AND score = best AND best >= 3 AND ties = 1, false)""",
)
def targets_among_candidates(spark, sf):
    q, d = _dealt(spark, sf, "doc_id", "name")
    cand = d.join(q.select("query_id", "k"), "k").drop("k", "dn")
    return TG.target_docs_among(q, cand).select(F.col("query_id").cast("bigint").alias("n"), "doc_id")


@query(
    "target_scope",
    """WITH l AS (SELECT l_orderkey AS q, l_suppkey AS d, l_partkey AS p, l_linenumber AS k FROM lineitem), t AS (SELECT DISTINCT o_orderkey AS q, o_custkey % 10 AS d FROM orders WHERE o_orderstatus = 'F')
    SELECT q, d, p, k FROM l WHERE (q, d) IN (SELECT q, d FROM t) OR q NOT IN (SELECT q FROM t)""",
)
def target_scope(spark, sf):
    ranked = C.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("doc_id"), F.col("l_partkey").alias("p"), F.col("l_linenumber").alias("k")
    )
    targets = C.table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("query_id"), (F.col("o_custkey") % 10).alias("doc_id")
    )
    out = TG.scope_to_targets(ranked, targets)
    return out.select(F.col("query_id").alias("q"), F.col("doc_id").alias("d"), "p", "k")


@query(
    "candidate_documents",
    """WITH l AS (SELECT l_orderkey AS q, 's' || (l_suppkey % 5) AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem), g AS (SELECT q, d, min(r) AS r FROM l GROUP BY ALL)
    SELECT q, d, row_number() OVER (PARTITION BY q ORDER BY r) AS position FROM g""",
)
def candidate_documents(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    ranked = C.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("doc_id"), F.row_number().over(w).alias("rank")
    )
    return TG.candidate_documents(ranked).select(F.col("query_id").alias("q"), F.col("doc_id").alias("d"), "position")


# --- inventory ------------------------------------------------------------------------------

SQL_ASKERS = f"{SQL_BASE}, {C.SQL_PRINCIPALS}, askers AS (SELECT q.n, q.query, lower({strip('q.query')}) AS t, m.tokens, m.email, m.domain, m.user_id, m.groups FROM questions q JOIN members m ON m.principal_id = {C.sql_asker('q.n')})"
SQL_REQUESTED = "list_filter([" + ", ".join(f"CASE WHEN {has_any('t', h)} THEN {lit(c)} END" for c, h in V.INVENTORY_CATEGORY_HINTS) + "], lambda v: v IS NOT NULL)"
SQL_INVENTORY = f"""{SQL_ASKERS}, inv AS (SELECT *, {SQL_REQUESTED} AS requested FROM askers),
  cats AS (SELECT *, (['Portfolio', 'Fund Management', 'Due Diligence', 'Market Research', 'Dealflow', 'Legal Compliance'])[n % 6 + 1] AS category FROM docs),
  vis AS (SELECT i.n, i.requested, c.category, c.doc_id, c.name, row_number() OVER (PARTITION BY i.n, c.category ORDER BY lower(c.name), c.doc_id) AS r FROM inv i JOIN cats c ON {sql_allowed('c.acl', 'i')}
    AND (len(i.requested) = 0 OR list_contains(i.requested, c.category))),
  grouped AS (SELECT n, any_value(requested) AS requested, category, count(*) AS total, list(name ORDER BY r) FILTER (r <= 3) AS ex FROM vis GROUP BY n, category),
  marked AS (SELECT *, coalesce(sum(len(ex)) OVER (PARTITION BY n ORDER BY list_position(requested, category), category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    row_number() OVER (PARTITION BY n ORDER BY CASE WHEN len(requested) > 0 THEN list_position(requested, category) ELSE -total END, lower(category)) AS position FROM grouped)"""


def _askers(spark, sf):
    who = AC.with_principal_tokens(C.principals(spark, sf)).select("principal_id", "tokens")
    q = _questions(spark, sf).withColumn("principal_id", C.asker(spark, sf, F.col("n")))
    return AC.make_pools(q.join(who, "principal_id"))


def _signed_docs(spark, sf):
    return AC.with_signature(C.docs(spark, sf)).drop("text")


@query(
    "inventory_groups",
    f"""WITH {SQL_INVENTORY} SELECT n, category, total AS total_docs, CAST(before + 1 AS BIGINT) AS first_marker, array_to_string(ex, '; ') AS examples, position FROM marked""",
)
def inventory_groups(spark, sf):
    q = _askers(spark, sf)
    rows = INV.inventory(docs_with_pools(_signed_docs(spark, sf), q), q)
    names = F.array_join(F.transform("examples", lambda e: e["doc_name"]), "; ")
    return rows.select(F.col("query_id").cast("bigint").alias("n"), "category", "total_docs", F.col("first_marker").cast("bigint").alias("first_marker"), names.alias("examples"), "position")


@query(
    "inventory_answers",
    f"""WITH {SQL_INVENTORY}, lines AS (SELECT n, position, len(ex) AS c, '- ' || category || ' (' || total || ' indexed files): ' || array_to_string(list_transform(ex, lambda e, i: e || ' [' || CAST(before + i AS BIGINT) || ']'), '; ') AS line FROM marked),
    a AS (SELECT n, {lit(V.INVENTORY_HEADER)} || chr(10) || string_agg(line, chr(10) ORDER BY position) AS answer, sum(c) AS citations FROM lines GROUP BY n)
    SELECT k.n, coalesce(answer, {lit(V.INVENTORY_EMPTY_TEXT)}) AS answer, CAST(coalesce(citations, 0) AS BIGINT) AS citations FROM askers k LEFT JOIN a USING (n)""",
)
def inventory_answers(spark, sf):
    q = _askers(spark, sf)
    text = INV.inventory_text(INV.inventory(docs_with_pools(_signed_docs(spark, sf), q), q), q)
    return text.select(F.col("query_id").cast("bigint").alias("n"), "answer", F.col("citations").cast("bigint").alias("citations"))


SQL_EXPANSION = "MAP {" + ", ".join(f"{lit(k)}: {arr(v)}" for k, v in V.QUERY_TERM_EXPANSIONS.items()) + "}"
SQL_CLARIFY = f"""{SQL_ASKERS}, b AS (SELECT n, query, list_filter(list_transform({tokens('query')}, lambda v: CASE WHEN length(v) > 4 AND v LIKE '%ies' THEN left(v, length(v) - 3) || 'y' WHEN length(v) > 4 AND v LIKE '%s' THEN left(v, length(v) - 1) ELSE v END),
      lambda t: length(t) > 2 AND NOT list_contains({arr(V.QUERY_STOPWORDS)}, t)) AS k FROM askers),
  terms AS (SELECT n, query, list_distinct(list_concat(k, flatten(list_transform(k, lambda x: coalesce({SQL_EXPANSION}[x], []))), CASE WHEN contains(lower(query), 'capital commitment') THEN {arr(V.PHRASE_EXPANSION)} ELSE [] END)) AS terms FROM b),
  cats AS (SELECT *, (['Portfolio', 'Fund Management', 'Due Diligence', 'Market Research', 'Dealflow', 'Legal Compliance'])[n % 6 + 1] AS category FROM docs),
  scored AS (SELECT a.n, t.query, c.doc_id, c.name, c.category, list_sum(list_transform(t.terms, lambda x: CASE WHEN contains(lower(c.name), x) THEN 6 ELSE 0 END + CASE WHEN contains(lower(c.folder_path || '/' || c.name), x) THEN 3 ELSE 0 END))
      + CASE WHEN c.n % 4 = 3 THEN 3 ELSE 0 END AS score FROM askers a JOIN terms t USING (n) JOIN cats c ON {sql_allowed('c.acl', 'a')} WHERE len(t.terms) > 0),
  sugg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, lower(category), lower(name), doc_id) AS position FROM scored WHERE score > 0) WHERE position <= 3)"""


def _clarify(spark, sf):
    q = _askers(spark, sf)
    d = _signed_docs(spark, sf).withColumns(
        {
            "sheet_name": F.lit(None).cast("string"),
            "tabular_node_type": F.when(F.col("n") % 4 == 3, "workbook_summary"),
            "source_kind": F.when(F.col("n") % 4 == 3, "tabular"),
        }
    )
    return q, INV.clarify(q, docs_with_pools(d.drop("n"), q))


@query("clarification_suggestions", f"WITH {SQL_CLARIFY} SELECT n, doc_id, CAST(score AS BIGINT) AS score, position FROM sugg")
def clarification_suggestions(spark, sf):
    _q, s = _clarify(spark, sf)
    return s.select(F.col("query_id").cast("bigint").alias("n"), "doc_id", F.col("clarify_score").cast("bigint").alias("score"), "position")


@query(
    "clarification_answers",
    rf"""WITH {SQL_CLARIFY} SELECT n, md5({lit(V.CLARIFY_HEADER[0])} || chr(10) || {lit(V.CLARIFY_HEADER[1])} || chr(10) || string_agg('- ' || name || ' [' || position || ']', chr(10) ORDER BY position) || chr(10) || {lit(V.CLARIFY_PROMPTS_HEADER)} || chr(10)
      || '- "In ' || max(name) FILTER (position = 1) || ', summarize the relevant evidence with citations."' || coalesce(chr(10) || '- "Use only ' || max(name) FILTER (position = 1) || ' and ' || max(name) FILTER (position = 2) || '. What do they say about ' || regexp_replace(any_value(query), '\?+$', '') || '?"', '')) AS digest,
      count(*) AS citations FROM sugg GROUP BY n""",
)
def clarification_answers(spark, sf):
    q, s = _clarify(spark, sf)
    t = INV.clarify_text(s, q)
    return t.select(F.col("query_id").cast("bigint").alias("n"), F.md5("answer").alias("digest"), F.col("citations").cast("bigint").alias("citations"))


# --- answerability --------------------------------------------------------------------------

# every document is evidence of some question (SQL_DEALS), in place of a retrieval's result
SQL_EVIDENCE = f"""{SQL_DEALS}, ev AS (SELECT q.n, d.doc_id, d.name, d.text, row_number() OVER (PARTITION BY q.n ORDER BY d.n) AS rank FROM {SQL_DEALT}),
  q2 AS (SELECT *, CASE WHEN n % 9 = 0 THEN 'summarize' ELSE 'qa' END AS mode, {ordered_distinct(f"list_filter({tokens('query')}, lambda t: length(t) >= 3 AND NOT list_contains({arr(V.ANSWERABILITY_STOPWORDS)}, t))")} AS terms0, {tokens('query')} AS toks FROM questions)"""
SQL_ANSWERABLE = f"""{SQL_BASE}, {SQL_EVIDENCE}, k AS (SELECT n, query, mode, list_distinct(terms0) AS terms, list_has_any(terms0, {arr(V.DISCOVERY_TERMS)}) AS disc,
    list_distinct(flatten(list_transform(list_filter(toks, lambda t: length(t) >= 2), lambda x: CASE WHEN x LIKE '%s' AND length(x) > 3 THEN [x, left(x, length(x) - 1)] ELSE [x] END))) AS marks FROM q2),
  e6 AS (SELECT * FROM ev WHERE rank <= 6),
  sc AS (SELECT e.n, e.rank, len(list_filter(k.terms, lambda t: contains(lower(e.name || chr(10) || e.text), t)))
      + CASE WHEN k.disc AND (len(list_filter(k.terms, lambda t: contains(lower(e.name), t))) > 0 OR len(list_filter(k.marks, lambda t: contains(lower(e.name), t))) > 0) THEN 2 ELSE 0 END AS s FROM e6 e JOIN k USING (n)),
  agg AS (SELECT n, count(*) AS c, coalesce(list(rank ORDER BY s DESC, rank) FILTER (s > 0), [])[1:3] AS top FROM sc GROUP BY n),
  heur AS (SELECT k.n, k.query, k.mode, coalesce(c, 0) AS c, CASE WHEN coalesce(c, 0) = 0 THEN 'insufficient_evidence' WHEN mode = 'summarize' THEN 'summary_supported' WHEN len(terms) = 0 THEN 'broad_query_supported'
      WHEN len(top) > 0 THEN CASE WHEN disc THEN 'document_discovery_supported' ELSE 'topic_supported' END ELSE 'insufficient_evidence' END AS reason,
    CASE WHEN coalesce(c, 0) = 0 THEN [] WHEN mode = 'summarize' THEN range(1, c + 1) WHEN len(terms) = 0 THEN range(1, least(c, 2) + 1) ELSE top END AS support FROM k LEFT JOIN agg USING (n))"""


def _ranked_deals(spark, sf):
    """Questions with their mode, documents with their rank in their deal."""
    q, d = _dealt(spark, sf, "doc_id", "name", "text")
    q = q.withColumn("mode", F.when(F.col("n") % 9 == 0, "summarize").otherwise("qa"))
    return q, d.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy("dn"))).drop("dn")


def _evidence(spark, sf):
    q, d = _ranked_deals(spark, sf)
    return q.drop("k"), d.join(q.select("query_id", "k"), "k").drop("k")


@query(
    "heuristic_answerability",
    f"WITH {SQL_ANSWERABLE} SELECT n, reason <> 'insufficient_evidence' AS answerable, reason, array_to_string(support, ',') AS support FROM heur",
)
def heuristic_answerability(spark, sf):
    q, ev = _evidence(spark, sf)
    a = answerability(ev, q)
    return a.select(F.col("query_id").cast("bigint").alias("n"), "answerable", "reason", F.array_join("support", ",").alias("support"))


@query(
    "answerability_arbitration",
    f"""WITH {SQL_ANSWERABLE}, f AS (SELECT *, c = 0 OR n % 3 = 2 OR mode = 'summarize' OR (reason <> 'insufficient_evidence' AND (list_contains({arr(V.HEURISTIC_PRIORITY_REASONS)}, reason) OR {has_any('lower(query)', V.MENTION_TERMS)})) AS firm FROM heur)
    SELECT n, CASE WHEN firm THEN reason WHEN n % 3 = 0 THEN 'supported' ELSE 'weak' END AS reason, CASE WHEN firm THEN array_to_string(support, ',') WHEN n % 3 = 0 THEN CASE WHEN c >= 2 THEN '2,1' ELSE '1' END ELSE '' END AS support,
      CASE WHEN firm THEN 'heuristic' ELSE 'llm' END AS source FROM f""",
)
def answerability_arbitration(spark, sf):
    q, ev = _evidence(spark, sf)
    n = F.col("n")
    raw = F.when(n % 3 == 0, '{"answerable": true, "support_indices": [2, 1]}').when(n % 3 == 1, '{"answerable": false, "reason": "weak"}').otherwise("cannot say")
    a = answerability(ev, q, q.select("query_id", raw.alias("verdict")))
    return a.select(F.col("query_id").cast("bigint").alias("n"), "reason", F.array_join("support", ",").alias("support"), "source")


@query(
    "judge_prompts",
    rf"""WITH {SQL_BASE}, {SQL_EVIDENCE}, b AS (SELECT n, rank, '[' || rank || '] doc=' || doc_id || ' node=' || doc_id || '::n0 page=None' || chr(10) || 'title=' || name || chr(10)
      || CASE WHEN length({strip('text')}) > 900 THEN rtrim(left({strip('text')}, 900)) || '...' ELSE {strip('text')} END AS block FROM ev WHERE rank <= 6), g AS (SELECT n, string_agg(block, chr(10) ORDER BY rank) AS blocks FROM b GROUP BY n)
    SELECT n, md5({lit(V.JUDGE_INSTRUCTIONS)} || chr(10) || chr(10) || 'Mode: ' || mode || chr(10) || 'Question: ' || query || chr(10) || chr(10) || 'Evidence blocks:' || chr(10) || blocks || chr(10) || chr(10) || 'JSON schema:' || chr(10) || {lit(V.JUDGE_SCHEMA)}) AS digest
    FROM q2 JOIN g USING (n)""",
)
def judge_prompts(spark, sf):
    q, ev = _evidence(spark, sf)
    shown = ev.withColumns({"node_id": F.concat("doc_id", F.lit("::n0")), "page": F.lit(None).cast("int")})
    return judge_prompt(shown, q).select(F.col("query_id").cast("bigint").alias("n"), F.md5("prompt").alias("digest"))


# --- prompts and answers --------------------------------------------------------------------

SQL_REGISTRY = "string_agg('[' || rank || '] doc=' || doc_id || ' page=' || rank || ' sheet=None rows=None-None range=None node=' || doc_id || '::n0', chr(10) ORDER BY rank)"


def _short_evidence(spark, sf, limit=4, *made):
    """Questions and their first evidence. The documents of it, with the columns ``made`` of them, are kept once, before they meet questions."""
    q, d = _ranked_deals(spark, sf)
    few = kept_table(d.filter(F.col("rank") <= limit).select("*", *made))
    none = F.lit(None).cast("string")
    few = few.join(q.select("query_id", "k"), "k").drop("k").withColumns(
        {
            "node_id": F.concat("doc_id", F.lit("::n0")), "page": F.col("rank"), "sheet_name": none, "row_start": none, "row_end": none,
            "cell_range": none, "modality": F.lit("text"),
        }
    )
    return q.drop("k"), few


@query(
    "grounded_prompts",
    f"""WITH {SQL_BASE}, {SQL_EVIDENCE}, e4 AS (SELECT *, '[E' || rank || '] ' || {strip('text')} || chr(10) AS block FROM ev WHERE rank <= 4), u AS (SELECT *, sum(length(block)) OVER (PARTITION BY n ORDER BY rank) AS upto FROM e4),
    c AS (SELECT n, string_agg(block, chr(10) ORDER BY rank) AS ctx FROM u WHERE upto <= 3500 GROUP BY n), g AS (SELECT n, {SQL_REGISTRY} AS reg FROM e4 GROUP BY n)
    SELECT n, md5({lit(V.GROUNDED_INSTRUCTIONS)} || chr(10) || chr(10) || 'Mode: ' || mode || chr(10) || 'Question: ' || query || chr(10) || chr(10) || 'Context:' || chr(10) || ctx || chr(10) || chr(10) || 'Citations:' || chr(10) || reg) AS digest
    FROM q2 JOIN c USING (n) JOIN g USING (n)""",
)
def grounded_prompts(spark, sf):
    q, ev = _short_evidence(spark, sf)
    return OA.grounded_prompt(ev, q).select(F.col("query_id").cast("bigint").alias("n"), F.md5("prompt").alias("digest"))


@query(
    "summary_prompts",
    f"""WITH {SQL_BASE}, {SQL_EVIDENCE}, e4 AS (SELECT * FROM ev WHERE rank <= 4), b AS (SELECT n, count(*) AS c, string_agg('Doc: ' || name || ' (' || doc_id || ')' || chr(10) || 'Map summary:' || chr(10) || left({strip('text')}, 700) || chr(10) || 'Citations: [' || rank || ']', chr(10) ORDER BY rank) AS blocks, {SQL_REGISTRY} AS reg FROM e4 GROUP BY n)
    SELECT n, md5(CASE WHEN {matches(f"lower({strip('query')})", V.PER_DOCUMENT_PATTERNS)} THEN {lit(V.PER_DOCUMENT_INSTRUCTIONS)} ELSE {lit(V.INTEGRATED_INSTRUCTIONS)} END || chr(10) || chr(10) || 'Question: ' || query || chr(10) || chr(10) || 'Map blocks:' || chr(10) || blocks || chr(10) || chr(10) || 'Citation registry:' || chr(10) || reg) AS digest
    FROM q2 JOIN b USING (n) WHERE mode = 'summarize' AND c > 1""",
)
def summary_prompts(spark, sf):
    q, ev = _short_evidence(spark, sf)
    return OA.map_prompt(ev, q).select(F.col("query_id").cast("bigint").alias("n"), F.md5("prompt").alias("digest"))


@query(
    "used_citation_markers",
    rf"""WITH x AS (SELECT event_id, list_filter(list_transform(['[' || event_id % 7 || ']', '[2]', '[' || user_id || ']', '[2]'], lambda s: CAST(regexp_extract(s, '\d+') AS INTEGER)), lambda i: i BETWEEN 1 AND 5) AS u FROM events)
    SELECT event_id, array_to_string({ordered_distinct('u')}, ',') AS used, len({ordered_distinct('u')}) >= 2 AS enough FROM x""",
)
def used_citation_markers(spark, sf):
    def mark(c):
        return F.concat(F.lit("["), c.cast("string"), F.lit("]"))

    text = F.concat_ws(" and ", mark(F.col("event_id") % 7), F.lit("[2]"), mark(F.col("user_id")), F.lit("[2] [x] [1234]"))
    e = C.table(spark, sf, "events").select("event_id", used_citations(text, F.lit(5)).alias("u"))
    return e.select("event_id", F.array_join("u", ",").alias("used"), enough_citations(F.size("u"), 2).alias("enough"))


def sql_segment(x):
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9_]{{3,}}'), lambda t: NOT list_contains({arr(V.SEGMENT_STOPWORDS)}, t)))"


# a generated answer per question: its own words, a cited or an unrelated line, a blank, a quote of its evidence
SQL_REPAIRED = f"""{SQL_BASE}, {SQL_EVIDENCE}, e4 AS (SELECT n, rank, {sql_segment("name || chr(10) || text")} AS t FROM ev WHERE rank <= 4),
  line2 AS (SELECT q2.n, replace(coalesce((SELECT max(left(e.text, 120)) FROM ev e WHERE e.n = q2.n AND e.rank = 2), ''), chr(10), ' ') AS quote FROM q2),
  lines AS (SELECT n, 1 AS pos, 'Take ' || replace(query, chr(10), ' ') AS line FROM q2 UNION ALL SELECT n, 2, CASE WHEN n % 4 = 0 THEN 'Fixed point [2]' ELSE 'zz' END FROM q2 UNION ALL SELECT n, 3, '   ' FROM q2 UNION ALL SELECT n, 4, quote FROM line2),
  bare AS (SELECT *, {sql_segment('line')} AS t FROM lines WHERE trim(line) <> '' AND NOT regexp_matches(line, '\\[[0-9]{{1,3}}\\]')),
  best AS (SELECT b.n, b.pos, max(len(list_intersect(b.t, e.t)) * 1000 - e.rank) AS m FROM bare b JOIN e4 e USING (n) WHERE len(list_intersect(b.t, e.t)) >= 2 GROUP BY ALL),
  fixed AS (SELECT l.n, l.pos, CASE WHEN m IS NOT NULL THEN regexp_replace(line, '\\s+$', '') || ' [' || CAST(-((m % 1000) - 1000) AS BIGINT) || ']' ELSE line END AS line FROM lines l LEFT JOIN best USING (n, pos)),
  repaired AS (SELECT n, string_agg(line, chr(10) ORDER BY pos) AS answer FROM fixed GROUP BY n)"""


def _drafts(spark, sf):
    q, ev = _short_evidence(spark, sf, 4, OA.evidence_segments(["name"]).alias("segments"))
    quote = ev.filter("rank = 2").select("query_id", F.left("text", F.lit(120)).alias("quote"))
    flat = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))
    second = F.when(F.col("n") % 4 == 0, "Fixed point [2]").otherwise("zz")
    text = F.concat_ws("\n", F.concat(F.lit("Take "), flat(F.col("query"))), second, F.lit("   "), flat(F.col("quote")))
    return q, ev, q.join(quote, "query_id", "left").select("query_id", "n", text.alias("answer"))


@query("citation_repair", f"WITH {SQL_REPAIRED} SELECT n, answer FROM repaired")
def citation_repair(spark, sf):
    _q, ev, drafts = _drafts(spark, sf)
    return OA.attach_citations(drafts, ev).select("n", "answer")


@query("answer_outcomes")
def answer_outcomes(spark, sf):
    """Refusal and answer decisions for drafted answers; every state occurs. Checked in the tests."""
    q, ev, drafts = _drafts(spark, sf)
    n = F.col("n")
    raw = F.when(n % 11 == 1, F.lit(None).cast("string")).when(n % 11 == 2, "").otherwise(F.col("answer"))
    asked = q.withColumn("include_images", n % 2 == 0)
    blank = F.col("query_id").cast("bigint") % 13 == 3
    evidence = ev.withColumn("text", F.when(blank, "").otherwise(F.col("text")))
    evidence = evidence.withColumn("segments", F.when(blank, OA.evidence_segments(["name"])).otherwise(F.col("segments")))
    out = OA.finalize_answers(asked, evidence, drafts.select("query_id", raw.alias("raw_answer")))
    return out.groupBy("response_status", "refusal_reason").agg(F.count("*").alias("questions"))
