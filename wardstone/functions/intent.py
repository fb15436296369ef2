"""Question classification: follow-ups, routing mode, blocked requests and request shape."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardstone import vocab as V
from wardstone.functions.text import (
    IGNORE_CASE,
    WS,
    collapse_ws,
    contains_any,
    lower_tokens,
    matches_any,
    starts_with_any,
    strip,
    text_or_empty,
    col,
    words,
)

MESSAGES = "array<struct<role:string,content:string>>"


def _lowered(query) -> Column:
    return F.lower(strip(text_or_empty(query)))


def word_count(c: Column) -> Column:
    return F.when(c == "", F.lit(0)).otherwise(F.size(F.split(c, WS + "+")))


def is_followup(query) -> Column:
    t = _lowered(query)
    padded = F.concat(F.lit(" "), t, F.lit(" "))
    refers = (word_count(t) <= V.FOLLOWUP_MAX_WORDS) & contains_any(padded, V.FOLLOWUP_REFERENCES)
    return (t != "") & (t.isin(V.FOLLOWUP_SHORT_FORMS) | refers | starts_with_any(t, V.FOLLOWUP_PREFIXES))


def valid_messages(history) -> Column:
    """History turns with a known role and some content, both trimmed."""
    arr = F.coalesce(col(history), F.array().cast(MESSAGES))
    tidy = F.transform(
        arr,
        lambda m: F.struct(
            F.lower(strip(text_or_empty(m["role"]))).alias("role"), strip(text_or_empty(m["content"])).alias("content")
        ),
    )
    return F.filter(tidy, lambda m: m["role"].isin(V.ROLES) & (m["content"] != ""))


def latest_user_question(history, exclude) -> Column:
    """Last user turn of the history that is not the current text itself."""
    own = _lowered(exclude)
    asked = F.filter(
        valid_messages(history), lambda m: (m["role"] == "user") & ((own == "") | (F.lower(m["content"]) != own))
    )
    return F.try_element_at(asked, F.lit(-1))["content"]


def rewrite_followup(query, previous) -> Column:
    """Question made standalone with the previous user turn, when it looks like a follow-up."""
    prev = F.nullif(col(previous), F.lit(""))
    joined = F.concat(prev, F.lit("\nFollow-up: "), strip(text_or_empty(query)))
    return F.when(is_followup(query) & prev.isNotNull(), joined).otherwise(col(query))


def is_smalltalk(query) -> Column:
    t = F.lower(collapse_ws(query))
    shout = F.btrim(F.regexp_replace(t, "!+$", ""))
    exclaimed = (
        t.endswith("!") & (word_count(t) <= 4) & ~t.contains("?") & shout.isin(V.SMALLTALK_EXCLAMATIONS)
    )
    return matches_any(t, V.SMALLTALK_PATTERNS) | starts_with_any(t, V.SMALLTALK_PREFIXES) | exclaimed


def is_knowledge_request(query) -> Column:
    t = F.lower(collapse_ws(query))
    tokens = lower_tokens(t)
    enough = F.size(tokens) >= 4
    return (
        matches_any(t, V.DOC_REFERENCE_PATTERNS)
        | F.arrays_overlap(tokens, words(V.RAG_TRIGGERS))
        | (matches_any(t, V.RAG_QUESTION_PATTERNS) & enough)
        | (t.contains("?") & enough & ~matches_any(t, V.GENERIC_CHAT_PATTERNS))
    )


def is_chat_task(query) -> Column:
    t = F.lower(collapse_ws(query))
    tokens = lower_tokens(t)
    acknowledges = (F.size(tokens) == 0) | F.exists(
        tokens, lambda k: k.isin(V.ACK_TOKENS) | starts_with_any(k, V.ACK_PREFIXES)
    )
    return (
        matches_any(t, V.GENERIC_CHAT_PATTERNS)
        | matches_any(t, V.CHAT_TASK_PATTERNS)
        | ((F.size(tokens) <= 6) & acknowledges)
    )


def _mode(mode: str, reason: str) -> Column:
    return F.struct(F.lit(mode).alias("mode"), F.lit(reason).alias("reason"))


def standalone_intent(query) -> Column:
    """(mode, reason) for a question judged without any history."""
    return (
        F.when(collapse_ws(query) == "", _mode("chat", "empty_query"))
        .when(is_smalltalk(query), _mode("chat", "smalltalk"))
        .when(is_knowledge_request(query), _mode("rag", "knowledge_request"))
        .when(is_chat_task(query), _mode("chat", "general_assistance"))
        .otherwise(_mode("chat", "default_chat"))
    )


def intent(query, previous) -> Column:
    """(mode, reason); a follow-up inherits the mode of the previous user question."""
    prev = F.nullif(col(previous), F.lit(""))
    inherited = standalone_intent(prev)["mode"]
    follow = F.struct(inherited.alias("mode"), F.concat(F.lit("followup_"), inherited).alias("reason"))
    open_turn = (collapse_ws(query) != "") & ~is_smalltalk(query)
    return F.when(open_turn & is_followup(collapse_ws(query)) & prev.isNotNull(), follow).otherwise(
        standalone_intent(query)
    )


def disallowed_reason(query) -> Column:
    """Reason of the first matching security pattern, in order; null for harmless questions."""
    t = collapse_ws(query)
    return F.coalesce(*[F.when(t.rlike(IGNORE_CASE + p), F.lit(r)) for p, r in V.SECURITY_PATTERNS])


def effective_mode(query, mode) -> Column:
    hinted = contains_any(_lowered(query), V.SUMMARIZE_HINTS)
    return F.when((col(mode) == "summarize") | hinted, F.lit("summarize")).otherwise(F.lit("qa"))


def interface_mode(query) -> Column:
    """The shorter hint list used by a chat front end before it sends the request."""
    return F.when(contains_any(_lowered(query), V.SUMMARIZE_HINTS_UI), F.lit("summarize")).otherwise(F.lit("qa"))


def is_inventory_request(query) -> Column:
    return matches_any(_lowered(query), V.INVENTORY_PATTERNS)


def requested_categories(query) -> Column:
    q = _lowered(query)
    hits = F.array(*[F.when(contains_any(q, hints), F.lit(label)) for label, hints in V.INVENTORY_CATEGORY_HINTS])
    return F.filter(hits, lambda v: v.isNotNull())


def is_single_doc_request(query) -> Column:
    q = _lowered(query)
    return ~matches_any(q, V.MULTI_DOC_PATTERNS) & (
        matches_any(q, V.SINGLE_DOC_HINT_PATTERNS) | matches_any(q, V.SINGLE_DOC_WORD_PATTERNS)
    )


def wants_per_document_summary(query) -> Column:
    return matches_any(_lowered(query), V.PER_DOCUMENT_PATTERNS)


def is_mention_query(query) -> Column:
    return contains_any(F.lower(text_or_empty(query)), V.MENTION_TERMS)


def route(query, retrieval_mode, decision: Column) -> Column:
    """blocked, chat, inventory or rag, in that order of precedence, with the reason."""
    blocked = disallowed_reason(query)
    mode = F.coalesce(col(retrieval_mode), F.lit("auto"))

    def step(name, reason):
        return F.struct(F.lit(name).alias("route"), reason.alias("reason"))

    return (
        F.when(blocked.isNotNull(), step("blocked", F.concat(F.lit("blocked_"), blocked)))
        .when(mode == "chat", step("chat", F.lit("forced_chat_mode")))
        .when((mode == "auto") & (decision["mode"] == "chat"), step("chat", F.concat(F.lit("auto_"), decision["reason"])))
        .when(is_inventory_request(query), step("inventory", F.lit("inventory_request")))
        .otherwise(step("rag", F.coalesce(decision["reason"], F.lit("rag"))))
    )
