"""Queries over question classification, filter inference and routing."""

from pyspark.sql import functions as F

from wardstone import vocab as V
from wardstone.catalog import corpus as C
from wardstone.catalog.base import arr, collapse, has_any, lit, matches, query, starts_any, strip, tokens
from wardstone.functions import answers as AN
from wardstone.functions import filters as FL
from wardstone.functions import intent as IN
from wardstone.operators.skew import last_before

# --- SQL forms -----------------------------------------------------------------------------


def low(x):
    return f"lower({strip(x)})"


def words(x):
    return rf"(CASE WHEN {x} = '' THEN 0 ELSE len(string_split_regex({x}, '\s+')) END)"


def sql_followup(x):
    return (
        f"({x} <> '' AND (list_contains({arr(V.FOLLOWUP_SHORT_FORMS)}, {x}) OR ({words(x)} <= {V.FOLLOWUP_MAX_WORDS}"
        f" AND {has_any(f'(chr(32) || {x} || chr(32))', V.FOLLOWUP_REFERENCES)}) OR {starts_any(x, V.FOLLOWUP_PREFIXES)}))"
    )


def sql_smalltalk(x):
    shout = rf"trim(regexp_replace({x}, '!+$', ''))"
    return (
        f"({matches(x, V.SMALLTALK_PATTERNS)} OR {starts_any(x, V.SMALLTALK_PREFIXES)} OR ({x} LIKE '%!' AND {words(x)} <= 4"
        f" AND NOT contains({x}, '?') AND list_contains({arr(V.SMALLTALK_EXCLAMATIONS)}, {shout})))"
    )


def sql_knowledge(x):
    t = tokens(x)
    return (
        f"({matches(x, V.DOC_REFERENCE_PATTERNS)} OR list_has_any({t}, {arr(V.RAG_TRIGGERS)}) OR ({matches(x, V.RAG_QUESTION_PATTERNS)} AND len({t}) >= 4)"
        f" OR (contains({x}, '?') AND len({t}) >= 4 AND NOT {matches(x, V.GENERIC_CHAT_PATTERNS)}))"
    )


def sql_chat_task(x):
    t = tokens(x)
    ack = f"(len({t}) = 0 OR len(list_filter({t}, lambda k: list_contains({arr(V.ACK_TOKENS)}, k) OR {starts_any('k', V.ACK_PREFIXES)})) > 0)"
    return f"({matches(x, V.GENERIC_CHAT_PATTERNS)} OR {matches(x, V.CHAT_TASK_PATTERNS)} OR (len({t}) <= 6 AND {ack}))"


def sql_intent(x):
    """'mode/reason' of a normalised lower-cased question without history."""
    return (
        f"CASE WHEN {x} = '' THEN 'chat/empty_query' WHEN {sql_smalltalk(x)} THEN 'chat/smalltalk' WHEN {sql_knowledge(x)} THEN 'rag/knowledge_request'"
        f" WHEN {sql_chat_task(x)} THEN 'chat/general_assistance' ELSE 'chat/default_chat' END"
    )


def sql_blocked(x):
    branches = " ".join(f"WHEN {matches(x, [p])} THEN {lit(r)}" for p, r in V.SECURITY_PATTERNS)
    return f"CASE {branches} END"


SQL_BASE = f"""{C.SQL_QUESTIONS}, q AS (SELECT *, {low('query')} AS t, lower({collapse('query')}) AS c FROM questions),
  prev AS (SELECT n, conv_id, turn, last_value(CASE WHEN role = 'user' AND trim(query) <> '' THEN query END IGNORE NULLS)
    OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM questions)"""


def previous_questions(spark, sf):
    """Questions with the last user question asked before them in their conversation."""
    asked = F.when((F.col("role") == "user") & (F.trim("query") != ""), F.col("query"))
    return last_before(C.questions(spark, sf), ["conv_id"], "turn", asked, "previous")


@query(
    "previous_question",
    f"WITH {SQL_BASE} SELECT n, previous FROM prev",
)
def previous_question(spark, sf):
    return previous_questions(spark, sf).select("n", "previous")


@query(
    "followup_detection",
    f"WITH {SQL_BASE} SELECT n, {sql_followup('t')} AS followup FROM q",
)
def followup_detection(spark, sf):
    return C.questions(spark, sf).select("n", IN.is_followup("query").alias("followup"))


@query(
    "followup_rewrite",
    f"""WITH {SQL_BASE} SELECT q.n, CASE WHEN {sql_followup('q.t')} AND previous IS NOT NULL THEN previous || chr(10) || 'Follow-up: ' || {strip('q.query')} ELSE q.query END AS rewritten
    FROM q JOIN prev USING (n)""",
)
def followup_rewrite(spark, sf):
    return previous_questions(spark, sf).select("n", IN.rewrite_followup("query", "previous").alias("rewritten"))


@query(
    "history_latest_question",
    """WITH h AS (SELECT conv_id, list({'r': role, 't': trim(text), 'k': turn} ORDER BY turn) AS m FROM conversations GROUP BY conv_id),
    u AS (SELECT conv_id, list_filter(m, lambda x: x.r = 'user' AND x.t <> '') AS m FROM h),
    c AS (SELECT conv_id, m[-1].t AS current, m FROM u)
    SELECT conv_id, list_filter(m, lambda x: lower(x.t) <> lower(c.current))[-1].t AS latest FROM c""",
)
def history_latest_question(spark, sf):
    turns = C.table(spark, sf, "conversations")
    # a conversation is one request's history and travels in one row, as the request does
    hist = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("h")
    )
    rows = hist.withColumn("h", F.transform("h", lambda m: F.struct(F.upper(m["role"]).alias("role"), m["content"].alias("content"))))
    current = F.try_element_at(F.filter("h", lambda m: F.lower(m["role"]) == "user"), F.lit(-1))["content"]
    return rows.select("conv_id", IN.latest_user_question("h", current).alias("latest"))


@query(
    "intent",
    f"""WITH {SQL_BASE}, b AS (SELECT q.n, q.c, previous, {sql_intent('q.c')} AS own, {sql_intent(f"coalesce(lower({collapse('previous')}), '')")} AS before,
      q.c <> '' AND NOT {sql_smalltalk('q.c')} AND {sql_followup('q.c')} AND previous IS NOT NULL AS inherits FROM q JOIN prev USING (n))
    SELECT n, CASE WHEN inherits THEN split_part(before, '/', 1) ELSE split_part(own, '/', 1) END AS mode,
      CASE WHEN inherits THEN 'followup_' || split_part(before, '/', 1) ELSE split_part(own, '/', 2) END AS reason FROM b""",
)
def intent(spark, sf):
    q = previous_questions(spark, sf).withColumn("i", IN.intent("query", "previous"))
    return q.select("n", "i.mode", "i.reason")


@query(
    "knowledge_request",
    f"WITH {SQL_BASE} SELECT n, {sql_knowledge('c')} AS knowledge, {sql_chat_task('c')} AS chat_task, {sql_smalltalk('c')} AS smalltalk FROM q",
)
def knowledge_request(spark, sf):
    return C.questions(spark, sf).select(
        "n",
        IN.is_knowledge_request("query").alias("knowledge"),
        IN.is_chat_task("query").alias("chat_task"),
        IN.is_smalltalk("query").alias("smalltalk"),
    )


@query(
    "blocked_requests",
    f"WITH {SQL_BASE} SELECT n, {sql_blocked('c')} AS reason FROM q",
)
def blocked_requests(spark, sf):
    return C.questions(spark, sf).select("n", IN.disallowed_reason("query").alias("reason"))


@query(
    "summarize_mode",
    f"""WITH {SQL_BASE} SELECT n, CASE WHEN n % 11 = 0 OR {has_any('t', V.SUMMARIZE_HINTS)} THEN 'summarize' ELSE 'qa' END AS mode,
      CASE WHEN {has_any('t', V.SUMMARIZE_HINTS_UI)} THEN 'summarize' ELSE 'qa' END AS ui_mode FROM q""",
)
def summarize_mode(spark, sf):
    asked = F.when(F.col("n") % 11 == 0, "summarize").otherwise("qa")
    return C.questions(spark, sf).select("n", IN.effective_mode("query", asked).alias("mode"), IN.interface_mode("query").alias("ui_mode"))


SQL_CATEGORIES = (
    "array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN {has_any('t', h)} THEN {lit(c)} END" for c, h in V.INVENTORY_CATEGORY_HINTS)
    + "], lambda v: v IS NOT NULL), '|')"
)


@query(
    "inventory_requests",
    f"WITH {SQL_BASE} SELECT n, {matches('t', V.INVENTORY_PATTERNS)} AS inventory, {SQL_CATEGORIES} AS categories FROM q",
)
def inventory_requests(spark, sf):
    return C.questions(spark, sf).select(
        "n", IN.is_inventory_request("query").alias("inventory"), F.array_join(IN.requested_categories("query"), "|").alias("categories")
    )


@query(
    "single_document_requests",
    f"""WITH {SQL_BASE} SELECT n, NOT {matches('t', V.MULTI_DOC_PATTERNS)} AND ({matches('t', V.SINGLE_DOC_HINT_PATTERNS)} OR {matches('t', V.SINGLE_DOC_WORD_PATTERNS)}) AS single,
      {matches('t', V.PER_DOCUMENT_PATTERNS)} AS per_document FROM q""",
)
def single_document_requests(spark, sf):
    return C.questions(spark, sf).select(
        "n", IN.is_single_doc_request("query").alias("single"), IN.wants_per_document_summary("query").alias("per_document")
    )


@query(
    "mention_queries",
    f"WITH {SQL_BASE} SELECT n, {has_any('lower(query)', V.MENTION_TERMS)} AS mention FROM q",
)
def mention_queries(spark, sf):
    return C.questions(spark, sf).select("n", IN.is_mention_query("query").alias("mention"))


# --- filters -------------------------------------------------------------------------------

SQL_SOURCES = "list_filter([" + ", ".join(f"CASE WHEN {has_any('t', h)} THEN {lit(s)} END" for s, h in V.SOURCE_HINTS) + "], lambda v: v IS NOT NULL)"
SQL_MIMES = "list_concat(" + ", ".join(f"CASE WHEN {matches('t', [p])} THEN {arr(v)} ELSE [] END" for p, v in V.MIME_HINTS) + ")"
SQL_PATHS = rf"list_filter(list_transform(regexp_extract_all(query, {lit(V.PATH_TOKEN_PATTERN)}), lambda m: trim(m, {lit(V.PATH_TRIM_CHARS + '/')})), lambda m: contains(m, '/'))"
SQL_INFER = f"""{SQL_BASE}, inferred AS (SELECT n, query, {SQL_SOURCES} AS sources, {SQL_MIMES} AS mimes, {SQL_PATHS} AS paths FROM q),
  folders AS (SELECT *, list_transform(paths, lambda m: CASE WHEN regexp_matches(lower(m), '\\.(pdf|docx|txt|md|xlsx)$') THEN regexp_replace(m, '/[^/]*$', '') ELSE m END) AS folders FROM inferred)"""


def sql_with_lower(x):
    both = f"flatten(list_transform({x}, lambda m: [m, lower(m)]))"
    return f"array_to_string(list_filter({both}, lambda v, i: list_position({both}, v) = i), '|')"


@query(
    "filter_inference",
    f"""WITH {SQL_INFER} SELECT n, array_to_string(sources, '|') AS sources, array_to_string(mimes, '|') AS mimes, {sql_with_lower('folders')} AS folders,
      {sql_with_lower('paths')} AS paths FROM folders WHERE len(sources) + len(mimes) + len(paths) > 0""",
)
def filter_inference(spark, sf):
    q = C.questions(spark, sf).withColumn("f", FL.infer_filters("query")).filter("f IS NOT NULL")
    return q.select(
        "n",
        F.array_join("f.sources", "|").alias("sources"),
        F.array_join("f.mime_types", "|").alias("mimes"),
        F.array_join("f.folder_prefixes", "|").alias("folders"),
        F.array_join("f.path_prefixes", "|").alias("paths"),
    )


@query(
    "filter_merge",
    f"""WITH {SQL_INFER}, e AS (SELECT *, len(sources) + len(mimes) + len(paths) > 0 AS implied FROM folders)
    SELECT n, CASE WHEN n % 2 = 0 THEN array_to_string(list_concat(['local_folder'], list_filter(sources, lambda s: s <> 'local_folder')), '|') ELSE array_to_string(sources, '|') END AS sources,
      CASE WHEN n % 2 = 0 THEN 'doc' || n ELSE '' END AS doc_ids, CASE WHEN n % 2 = 0 THEN '2024-02-01' END AS modified_from
    FROM e WHERE implied OR n % 2 = 0""",
)
def filter_merge(spark, sf):
    n = F.col("n")
    empty = F.array().cast("array<string>")
    own = F.when(
        n % 2 == 0,
        F.struct(
            F.array(F.lit(" local_folder ")).alias("sources"), empty.alias("mime_types"),
            F.array(F.concat(F.lit("doc"), n.cast("string")), F.lit("")).alias("doc_ids"), empty.alias("tags"),
            empty.alias("folder_prefixes"), empty.alias("path_prefixes"),
            F.lit("2024-02-01").cast("timestamp").alias("modified_from"), F.lit(None).cast("timestamp").alias("modified_to"),
        ),
    )
    q = C.questions(spark, sf).withColumns({"own": own, "implied": FL.infer_filters("query")})
    q = q.withColumn("f", FL.merge_filters(F.col("own"), F.col("implied"))).filter("f IS NOT NULL")
    return q.select(
        "n",
        F.array_join("f.sources", "|").alias("sources"),
        F.array_join("f.doc_ids", "|").alias("doc_ids"),
        F.date_format("f.modified_from", "yyyy-MM-dd").alias("modified_from"),
    )


SQL_ROUTES = f"""{SQL_BASE}, b AS (SELECT q.n, q.c, q.t, {sql_blocked('q.c')} AS blocked, {sql_intent('q.c')} AS own, {sql_intent(f"coalesce(lower({collapse('previous')}), '')")} AS before,
      q.c <> '' AND NOT {sql_smalltalk('q.c')} AND {sql_followup('q.c')} AND previous IS NOT NULL AS inherits FROM q JOIN prev USING (n)),
    d AS (SELECT *, CASE WHEN inherits THEN split_part(before, '/', 1) ELSE split_part(own, '/', 1) END AS mode,
      CASE WHEN inherits THEN 'followup_' || split_part(before, '/', 1) ELSE split_part(own, '/', 2) END AS reason FROM b)"""


@query(
    "request_routing",
    f"""WITH {SQL_ROUTES}
    SELECT n, CASE WHEN blocked IS NOT NULL THEN 'blocked' WHEN n % 13 = 0 THEN 'chat' WHEN n % 7 <> 0 AND mode = 'chat' THEN 'chat'
        WHEN {matches('t', V.INVENTORY_PATTERNS)} THEN 'inventory' ELSE 'rag' END AS route,
      CASE WHEN blocked IS NOT NULL THEN 'blocked_' || blocked WHEN n % 13 = 0 THEN 'forced_chat_mode' WHEN n % 7 <> 0 AND mode = 'chat' THEN 'auto_' || reason
        WHEN {matches('t', V.INVENTORY_PATTERNS)} THEN 'inventory_request' ELSE reason END AS reason FROM d""",
)
def request_routing(spark, sf):
    asked = F.when(F.col("n") % 13 == 0, "chat").when(F.col("n") % 7 == 0, "rag").otherwise("auto")
    q = previous_questions(spark, sf).withColumn("d", IN.intent("query", "previous"))
    q = q.withColumn("r", IN.route("query", asked, F.col("d")))
    return q.select("n", "r.route", "r.reason")


SQL_CANNED = (
    "CASE "
    + " ".join(f"WHEN {has_any('t', w)} THEN {{{i}}}" for i, (w, _c, _d) in enumerate(V.CANNED_REPLIES))
    + " ELSE {default} END"
)


@query(
    "canned_replies",
    f"""WITH {SQL_BASE} SELECT n, {SQL_CANNED.format(*[lit(r[1]) for r in V.CANNED_REPLIES], default=f"CASE WHEN {has_any('t', V.CANNED_HELP_WORDS)} THEN {lit(V.CANNED_HELP_REPLY)} ELSE {lit(V.CANNED_CHAT_DEFAULT)} END")} AS chat_reply,
      {SQL_CANNED.format(*[lit(r[2]) for r in V.CANNED_REPLIES], default=lit(V.CANNED_DOC_DEFAULT))} AS doc_reply,
      CASE {sql_blocked('c')} WHEN 'auth_bypass' THEN {lit(V.SECURITY_REFUSALS['auth_bypass'])} WHEN 'data_exfiltration' THEN {lit(V.SECURITY_REFUSALS['data_exfiltration'])}
        ELSE {lit(V.SECURITY_REFUSAL_DEFAULT)} END AS refusal FROM q""",
)
def canned_replies(spark, sf):
    return C.questions(spark, sf).select(
        "n",
        AN.canned_reply("query").alias("chat_reply"),
        AN.canned_reply("query", chat_mode=False).alias("doc_reply"),
        AN.security_refusal(IN.disallowed_reason("query")).alias("refusal"),
    )


@query(
    "chat_messages",
    f"""WITH h AS (SELECT conv_id, list({{'r': role, 't': {strip('text')}}} ORDER BY turn) AS m FROM conversations GROUP BY conv_id),
    v AS (SELECT conv_id, list_filter(m[greatest(len(m) - 11, 1):len(m)], lambda x: x.t <> '') AS m FROM h)
    SELECT conv_id, CAST(len(m) + 2 AS BIGINT) AS messages, md5('system:' || {lit(V.CHAT_SYSTEM_PROMPT + AN.domain_instruction())} || chr(10) || array_to_string(list_transform(m, lambda x: x.r || ':' || x.t), chr(10))
      || chr(10) || 'user:ask ' || conv_id) AS digest FROM v""",
)
def chat_messages(spark, sf):
    turns = C.table(spark, sf, "conversations")
    hist = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", F.initcap("role").alias("role"), F.concat(F.lit(" "), "text").alias("content")))).alias("h")
    )
    plain = F.transform("h", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    msgs = hist.select("conv_id", AN.chat_messages(F.concat(F.lit(" ask "), F.col("conv_id").cast("string")), plain).alias("m"))
    flat = F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "\n")
    return msgs.select("conv_id", F.size("m").cast("bigint").alias("messages"), F.md5(flat).alias("digest"))
