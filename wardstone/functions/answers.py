"""Answer-side expressions: citations, model output, canned replies and request options."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardstone import vocab as V
from wardstone.functions.intent import valid_messages
from wardstone.functions.text import (
    IGNORE_CASE,
    WS,
    blank_to_null,
    col,
    contains_any,
    first_filled,
    lower_tokens,
    strip,
    text_or_empty,
    words,
)
from wardstone.functions.vectors import clamp
from wardstone.operators.skew import let

LOCATORS = ["page", "sheet_name", "cell_range", "row_start", "row_end", "tabular_node_type", "chunk_id"]


def citation(cols: dict) -> Column:
    """Citation struct from node columns; absent locators stay null."""

    def get(name):
        return col(cols[name]) if name in cols else F.lit(None).cast("string")

    return F.struct(
        F.coalesce(first_filled(get("doc_id"), get("file_id")), F.lit("unknown_doc")).alias("doc_id"),
        first_filled(get("name"), get("title")).alias("doc_name"),
        *[get(n).alias(n) for n in LOCATORS],
        get("node_id").alias("node_id"),
        F.coalesce(first_filled(get("modality")), F.lit("text")).alias("modality"),
        get("web_view_link").alias("web_view_link"),
    )


def citation_label(c: dict) -> Column:
    """Bold name with sheet, then rows, else range, else page, then node and chunk."""

    def s(name):
        return col(c[name]).cast("string")

    name = F.coalesce(first_filled(c["doc_name"], c["doc_id"]), F.lit("unknown_doc"))
    place = (
        F.when(s("row_start").isNotNull() & s("row_end").isNotNull(), F.concat(F.lit("rows="), s("row_start"), F.lit("-"), s("row_end")))
        .when(F.nullif(s("cell_range"), F.lit("")).isNotNull(), F.concat(F.lit("range="), s("cell_range")))
        .when(s("page").isNotNull(), F.concat(F.lit("page="), s("page")))
    )
    sheet = F.when(F.nullif(s("sheet_name"), F.lit("")).isNotNull(), F.concat(F.lit("sheet="), s("sheet_name")))
    shown = F.concat_ws(
        ", ",
        sheet,
        place,
        F.concat(F.lit("node="), F.coalesce(s("node_id"), F.lit("None"))),
        F.concat(F.lit("chunk="), F.coalesce(s("chunk_id"), F.lit("None"))),
    )
    return F.concat(F.lit("**"), name, F.lit("** ("), shown, F.lit(")"))


def generation_options(model, temperature, top_p, max_tokens, default_model) -> Column:
    """Requested sampling options clamped to their ranges, defaults where nothing was asked."""
    return F.struct(
        F.coalesce(blank_to_null(model), F.lit(default_model)).alias("model"),
        F.when(col(temperature).isNotNull(), clamp(temperature, *V.TEMPERATURE_RANGE))
        .otherwise(F.lit(V.DEFAULT_TEMPERATURE))
        .alias("temperature"),
        F.when(col(top_p).isNotNull(), clamp(top_p, *V.TOP_P_RANGE)).alias("top_p"),
        F.when(col(max_tokens).isNotNull(), clamp(max_tokens, *V.MAX_TOKENS_RANGE))
        .otherwise(F.lit(V.DEFAULT_MAX_TOKENS))
        .alias("max_tokens"),
    )


def strip_meta_language(answer) -> Column:
    out = strip(text_or_empty(answer))
    for p in V.META_PATTERNS:
        out = F.regexp_replace(out, IGNORE_CASE + p, "")
    out = F.regexp_replace(out, WS + "{2,}", " ")
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"^(?:[,;:\-]|" + WS + ")+", "")
    return strip(out)


def used_citations(answer, citation_count) -> Column:
    """Distinct [n] markers within range, in order of first use."""
    marks = F.transform(
        F.regexp_extract_all(text_or_empty(answer), F.lit(r"\[(\d{1,3})\]"), 1), lambda m: m.cast("int")
    )
    return F.array_distinct(F.filter(marks, lambda m: (m >= 1) & (m <= col(citation_count))))


def enough_citations(count, min_citations: int = V.MIN_CITATIONS) -> Column:
    return F.coalesce(col(count), F.lit(0)) >= min_citations


def segment_tokens(text) -> Column:
    found = F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit("([a-zA-Z0-9_]{3,})"), 1)
    return F.array_except(found, F.array(*[F.lit(t) for t in sorted(V.SEGMENT_STOPWORDS)]))  # each word once, in the order of the text


VERDICT_SCHEMA = "struct<answerable:string,reason:string,support_indices:string>"


def _object_text(raw) -> Column:
    """Text from the first opening to the last closing brace, if it is one JSON object."""
    found = F.nullif(F.regexp_extract(text_or_empty(raw), r"(?s)(\{.*\})", 1), F.lit(""))

    # wrapped in brackets, trailing text or a second object makes the whole value invalid or longer
    def single(block):
        wrapped = F.try_parse_json(F.concat(F.lit("["), block, F.lit("]")))
        return let(wrapped, lambda w: F.when(w.isNotNull() & F.try_variant_get(w, "$[1]", "variant").isNull(), block))

    return let(found, single)


def _truthy(json_text: Column) -> Column:
    falsy = ["false", "null", "0", "0.0", "", "[]", "{}"]
    return json_text.isNotNull() & ~json_text.isin(falsy)


def parse_verdict(raw, citation_count) -> Column:
    """Model verdict (answerable, reason, support); null when the text holds no JSON object."""
    return let(
        _object_text(raw),
        lambda block: F.when(block.isNotNull(), let(F.from_json(block, VERDICT_SCHEMA), lambda v: _verdict(v, col(citation_count)))),
    )


def _verdict(v: Column, n: Column) -> Column:
    listed = F.when(
        F.coalesce(v["support_indices"].startswith("["), F.lit(False)),
        F.from_json(v["support_indices"], "array<string>"),
    )
    as_int = F.transform(
        F.coalesce(listed, F.array().cast("array<string>")),
        lambda t: F.when(t == "true", F.lit(1))
        .when(t == "false", F.lit(0))
        .when(t.rlike(r"^\s*[+-]?\d+\s*$"), F.btrim(t).try_cast("int"))
        .when(t.rlike(r"^[+-]?\d+\.\d+$"), t.try_cast("double").cast("int")),
    )
    kept = F.array_distinct(F.filter(as_int, lambda i: i.isNotNull() & (i >= 1) & (i <= n)))

    def support(yes):
        named = let(kept, lambda k: F.when((F.size(k) == 0) & (n > 0), F.array(F.lit(1))).otherwise(k))
        return F.when(~yes, F.array().cast("array<int>")).otherwise(named)

    def reason(yes):
        default = F.when(yes, F.lit("supported")).otherwise(F.lit("insufficient_evidence"))
        return F.when(_truthy(v["reason"]), v["reason"]).otherwise(default)

    return let(
        _truthy(v["answerable"]),
        lambda yes: F.struct(yes.alias("answerable"), reason(yes).alias("reason"), support(yes).alias("support"), F.lit("llm").alias("source")),
    )


def parse_selector(raw, candidate_ids) -> Column:
    """Document id picked by a model, when it names one of the candidates."""
    v = F.from_json(_object_text(raw), "struct<scope:string,doc_id:string>")
    doc = strip(text_or_empty(v["doc_id"]))
    ok = (F.lower(strip(text_or_empty(v["scope"]))) == "single_document") & F.array_contains(col(candidate_ids), doc)
    return F.when(ok & (doc != ""), doc)


def canned_reply(query, chat_mode: bool = True) -> Column:
    t = F.lower(strip(text_or_empty(query)))
    pick = 1 if chat_mode else 2
    out = F.lit(V.CANNED_DOC_DEFAULT)
    if chat_mode:
        out = F.when(contains_any(t, V.CANNED_HELP_WORDS), F.lit(V.CANNED_HELP_REPLY)).otherwise(
            F.lit(V.CANNED_CHAT_DEFAULT)
        )
    for row in reversed(V.CANNED_REPLIES):
        out = F.when(contains_any(t, row[0]), F.lit(row[pick])).otherwise(out)
    return out


def security_refusal(reason) -> Column:
    out = F.lit(V.SECURITY_REFUSAL_DEFAULT)
    for key, text in V.SECURITY_REFUSALS.items():
        out = F.when(col(reason) == key, F.lit(text)).otherwise(out)
    return out


def domain_instruction(hint: str = V.DOMAIN_HINT) -> str:
    hint = (hint or "").strip()
    return V.DOMAIN_HINT_TEMPLATE.format(hint=hint) if hint else ""


def chat_messages(query, history, hint: str = V.DOMAIN_HINT, max_turns: int = V.CHAT_MAX_TURNS) -> Column:
    """System turn, then the valid ones among the last turns, then the question."""
    arr = F.coalesce(col(history), F.array().cast("array<struct<role:string,content:string>>"))
    n = F.size(arr)
    tail = F.slice(arr, F.greatest(n - max_turns + 1, F.lit(1)), F.lit(max_turns))

    def message(role, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    system = F.lit(V.CHAT_SYSTEM_PROMPT + domain_instruction(hint))
    return F.concat(
        F.array(message("system", system)), valid_messages(tail), F.array(message("user", strip(text_or_empty(query))))
    )


__all__ = [n for n in dir() if not n.startswith("_")]
