"""Metadata filters: building, inferring from question text, merging and applying."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardstone import vocab as V
from wardstone.functions.paths import normalize_path
from wardstone.functions.text import (
    IGNORE_CASE,
    blank_to_null,
    col,
    contains_any,
    ordered_union,
    strip,
    text_or_empty,
    words,
)

LISTS = ["sources", "mime_types", "doc_ids", "tags", "folder_prefixes", "path_prefixes"]
DATES = ["modified_from", "modified_to"]
FILTER_TYPE = (
    "struct<sources:array<string>,mime_types:array<string>,doc_ids:array<string>,tags:array<string>,"
    "folder_prefixes:array<string>,path_prefixes:array<string>,modified_from:timestamp,modified_to:timestamp>"
)
EMPTY = "array<string>"


def _tidy(arr: Column) -> Column:
    arr = F.coalesce(arr, F.array().cast(EMPTY))
    return F.filter(F.transform(arr, blank_to_null), lambda v: v.isNotNull())


def _tidy_paths(arr: Column) -> Column:
    arr = F.coalesce(arr, F.array().cast(EMPTY))
    clean = F.filter(F.transform(arr, normalize_path), lambda v: v != "")
    return F.array_distinct(F.concat(clean, F.transform(clean, F.lower)))


def prepare(flt: Column) -> Column:
    """The filter with its lists trimmed and its paths normalised, so that checks per node stay plain."""
    tidy = {n: _tidy(flt[n]) for n in ("sources", "mime_types", "doc_ids", "tags")}
    paths = {n: _tidy_paths(flt[n]) for n in ("folder_prefixes", "path_prefixes")}
    parts = {**tidy, **paths, **{n: flt[n] for n in DATES}}
    return F.when(flt.isNotNull(), F.struct(*[c.alias(n) for n, c in parts.items()]))


def admits(flt: Column, node: dict) -> Column:
    """AND over a prepared filter's parts, OR inside each; a null filter or an empty part admits every node.

    ``node`` maps source, mime_type, doc_id, tags, folder_path, folder_ancestors, drive_path,
    path_ancestors, source_path and modified_time to columns; absent ones never match.
    """
    no = F.lit(False)

    def member(part, name):
        return F.array_contains(flt[part], col(node[name])) if name in node else no

    def overlap(part, name):
        return F.arrays_overlap(flt[part], col(node[name])) if name in node else no

    tests = {
        "sources": member("sources", "source"),
        "mime_types": member("mime_types", "mime_type"),
        "doc_ids": member("doc_ids", "doc_id"),
        "tags": overlap("tags", "tags"),
        "folder_prefixes": overlap("folder_prefixes", "folder_ancestors") | member("folder_prefixes", "folder_path"),
        "path_prefixes": overlap("path_prefixes", "path_ancestors")
        | member("path_prefixes", "drive_path")
        | member("path_prefixes", "source_path"),
    }
    out = F.lit(True)
    for part, test in tests.items():
        out = out & ((F.size(flt[part]) == 0) | test)
    if "modified_time" in node:
        m = col(node["modified_time"])
        out = out & (flt["modified_from"].isNull() | (m >= flt["modified_from"]))
        out = out & (flt["modified_to"].isNull() | (m <= flt["modified_to"]))
    return flt.isNull() | F.coalesce(out, no)


def metadata_filter(flt: Column, node: dict) -> Column:
    """``admits`` for a filter as the request wrote it."""
    return admits(prepare(flt), node)


def literal_filter(node: dict, **parts) -> Column:
    """The same conjunction for one known filter, as plain IN / range terms that reach the scan."""
    terms = []
    if parts.get("sources"):
        terms.append(col(node["source"]).isin(parts["sources"]))
    if parts.get("mime_types"):
        terms.append(col(node["mime_type"]).isin(parts["mime_types"]))
    if parts.get("doc_ids"):
        terms.append(col(node["doc_id"]).isin(parts["doc_ids"]))
    if parts.get("tags"):
        terms.append(F.arrays_overlap(col(node["tags"]), words(parts["tags"])))
    if parts.get("folder_prefixes"):
        values = parts["folder_prefixes"]
        terms.append(
            F.arrays_overlap(col(node["folder_ancestors"]), words(sorted({v.lower() for v in values})))
            | col(node["folder_path"]).isin(values)
        )
    if parts.get("path_prefixes"):
        values = parts["path_prefixes"]
        terms.append(
            F.arrays_overlap(col(node["path_ancestors"]), words(sorted({v.lower() for v in values})))
            | col(node["drive_path"]).isin(values)
        )
    if parts.get("modified_from"):
        terms.append(col(node["modified_time"]) >= F.lit(parts["modified_from"]).cast("timestamp"))
    if parts.get("modified_to"):
        terms.append(col(node["modified_time"]) <= F.lit(parts["modified_to"]).cast("timestamp"))
    out = F.lit(True)
    for t in terms:
        out = out & t
    return out


def path_prefixes(query) -> Column:
    """Slash-joined path tokens of the question, as written and lower-cased, in order."""
    found = F.regexp_extract_all(text_or_empty(query), F.lit(f"({V.PATH_TOKEN_PATTERN})"), 1)
    clean = F.transform(found, lambda m: normalize_path(F.btrim(strip(m), F.lit(V.PATH_TRIM_CHARS))))
    return F.filter(clean, lambda m: m.contains("/"))


def _with_lower(arr: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(arr, lambda m: F.array(m, F.lower(m)))))


def infer_filters(query) -> Column:
    """Filter struct implied by the question's wording, or null when nothing is implied."""
    q = F.lower(strip(text_or_empty(query)))
    empty = F.array().cast(EMPTY)
    sources = F.filter(
        F.array(*[F.when(contains_any(q, hints), F.lit(s)) for s, hints in V.SOURCE_HINTS]), lambda v: v.isNotNull()
    )
    mimes = F.array_distinct(
        F.concat(*[F.when(q.rlike(IGNORE_CASE + p), words(vals)).otherwise(empty) for p, vals in V.MIME_HINTS])
    )
    paths = path_prefixes(query)
    is_file = lambda m: F.lower(m).rlike("(?:" + "|".join(s.replace(".", r"\.") for s in V.PATH_DOC_SUFFIXES) + ")$")
    folders = F.transform(paths, lambda m: F.when(is_file(m), F.regexp_replace(m, "/[^/]*$", "")).otherwise(m))
    none = F.lit(None).cast("timestamp")
    built = F.struct(
        sources.alias("sources"),
        mimes.alias("mime_types"),
        empty.alias("doc_ids"),
        empty.alias("tags"),
        _with_lower(folders).alias("folder_prefixes"),
        _with_lower(paths).alias("path_prefixes"),
        none.alias("modified_from"),
        none.alias("modified_to"),
    )
    return F.when((F.size(sources) > 0) | (F.size(mimes) > 0) | (F.size(paths) > 0), built)


def merge_filters(explicit: Column, inferred: Column) -> Column:
    """Ordered union of every list, explicit dates first; null when nothing is left."""
    lists = {n: ordered_union(explicit[n], inferred[n]) for n in LISTS}
    dates = {n: F.coalesce(explicit[n], inferred[n]) for n in DATES}
    keep = None
    for test in [F.size(c) > 0 for c in lists.values()] + [c.isNotNull() for c in dates.values()]:
        keep = test if keep is None else keep | test
    return F.when(keep, F.struct(*[c.alias(n) for n, c in {**lists, **dates}.items()]))


def with_doc_ids(flt: Column, doc_ids: Column) -> Column:
    """The filter narrowed to targeted documents (null ids leave it unchanged)."""
    only = F.struct(
        *[(doc_ids if n == "doc_ids" else F.array().cast(EMPTY)).alias(n) for n in LISTS],
        *[F.lit(None).cast("timestamp").alias(n) for n in DATES],
    )
    return F.when(F.size(doc_ids) > 0, merge_filters(flt, only)).otherwise(flt)
