"""Text normalisation, tokens and query terms as native column expressions."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardstone import vocab as V

# Every character that counts as white space, so trimming matches Unicode text, not only ASCII.
SPACES = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
IGNORE_CASE = "(?iuU)"
TOKEN = "[a-zA-Z0-9_]+"


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def strip(c) -> Column:
    return F.btrim(col(c), F.lit(SPACES))


def text_or_empty(c) -> Column:
    return F.coalesce(col(c), F.lit(""))


def blank_to_null(c) -> Column:
    """Trimmed text, or null when nothing is left (the reference tests truthiness)."""
    return F.nullif(strip(c), F.lit(""))


def first_filled(*cols) -> Column:
    """First candidate that is neither null nor empty, kept as written."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cols])


def matches_any(c, patterns) -> Column:
    """True when any pattern is found. One alternation, so the text is scanned once."""
    joined = "|".join(f"(?:{p})" for p in patterns)
    return F.coalesce(col(c).rlike(IGNORE_CASE + joined), F.lit(False))


def contains_any(c, needles) -> Column:
    c = text_or_empty(c)
    return reduce(lambda a, b: a | b, [c.contains(n) for n in needles])


def starts_with_any(c, prefixes) -> Column:
    c = text_or_empty(c)
    return reduce(lambda a, b: a | b, [c.startswith(p) for p in prefixes])


def normalize_text(c) -> Column:
    return F.regexp_replace(strip(text_or_empty(c)), "\n{3,}", "\n\n")


def collapse_ws(c, max_chars: int | None = None) -> Column:
    flat = strip(F.regexp_replace(text_or_empty(c), WS + "+", " "))
    if max_chars is None:
        return flat
    return F.when(F.length(flat) > max_chars, F.rtrim(F.left(flat, F.lit(max_chars)))).otherwise(flat)


def space_tokens(c) -> Column:
    """Number of blank-separated words in already collapsed text."""
    return F.when(col(c) == "", F.lit(0)).otherwise(F.size(F.split(col(c), " ")))


def has_useful_text(c) -> Column:
    flat = collapse_ws(c)
    return (F.length(flat) >= V.USEFUL_TEXT_MIN_CHARS) & (space_tokens(flat) >= V.USEFUL_TEXT_MIN_TOKENS)


def _scrub(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return F.replace(c, F.lit("\x00"), F.lit(""))
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: _scrub(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        entries = F.transform(
            F.map_entries(c),
            lambda e: F.struct(
                _scrub(e["key"], dtype.keyType).alias("key"), _scrub(e["value"], dtype.valueType).alias("value")
            ),
        )
        return F.map_from_entries(entries)
    if isinstance(dtype, T.StructType):
        rebuilt = F.struct(*[_scrub(c[f.name], f.dataType).alias(f.name) for f in dtype.fields])
        return F.when(c.isNotNull(), rebuilt)
    return c


def strip_nul(df: DataFrame, *names: str) -> DataFrame:
    """Remove U+0000 from strings at any depth, keys included; only string-bearing columns change."""
    names = names or tuple(df.columns)
    return df.withColumns({n: _scrub(F.col(n), df.schema[n].dataType) for n in names})


def tokenize(c) -> Column:
    """ASCII word tokens in order, lower-cased after matching so accents split words."""
    return F.transform(F.regexp_extract_all(text_or_empty(c), F.lit(f"({TOKEN})"), 1), F.lower)


def token_set(c) -> Column:
    return F.array_distinct(tokenize(c))


def lower_tokens(c) -> Column:
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(f"({TOKEN})"), 1)


def _expand_term(t: Column) -> Column:
    # keys below the length floor (a two-letter key) can never be reached
    reachable = {k: v for k, v in V.TERM_EXPANSIONS.items() if len(k) >= 3}
    out = F.array(t)
    for key, values in reachable.items():
        out = F.when(t == key, words([key, *values])).otherwise(out)
    return out


def meaningful_terms(query) -> Column:
    kept = F.filter(lower_tokens(query), lambda t: (F.length(t) >= 3) & ~t.isin(V.ANSWERABILITY_STOPWORDS))
    return F.array_distinct(F.flatten(F.transform(kept, _expand_term)))


def raw_markers(query) -> Column:
    long_enough = F.array_distinct(F.filter(lower_tokens(query), lambda t: F.length(t) >= 2))
    with_singular = F.transform(
        long_enough,
        lambda t: F.when(
            t.endswith("s") & (F.length(t) > 3), F.array(t, F.left(t, F.length(t) - 1))
        ).otherwise(F.array(t)),
    )
    return F.array_distinct(F.flatten(with_singular))


def normalize_query_term(t) -> Column:
    v = F.lower(strip(t))
    n = F.length(v)
    return (
        F.when((n > 4) & v.endswith("ies"), F.concat(F.left(v, n - 3), F.lit("y")))
        .when((n > 4) & v.endswith("s"), F.left(v, n - 1))
        .otherwise(v)
    )


def expanded_query_terms(query) -> Column:
    """Sorted distinct query terms plus their fixed expansions."""
    base = F.filter(
        F.transform(lower_tokens(query), normalize_query_term),
        lambda t: (F.length(t) > 2) & ~t.isin(V.QUERY_STOPWORDS),
    )
    table = F.create_map(*[x for k, v in V.QUERY_TERM_EXPANSIONS.items() for x in (F.lit(k), words(v))])
    extra = F.flatten(F.transform(base, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>"))))
    phrase = F.when(contains_any(F.lower(text_or_empty(query)), V.PHRASE_TRIGGERS), words(V.PHRASE_EXPANSION)).otherwise(
        F.array().cast("array<string>")
    )
    return F.array_sort(F.array_distinct(F.concat(base, extra, phrase)))


def normalize_doc_ref(c) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text_or_empty(c)), "[^a-zA-Z0-9]+", " "))


def extension_stem(c) -> Column:
    """The name without a known document extension, or null when it has none."""
    value = strip(text_or_empty(c))
    lowered = F.lower(value)
    out = F.lit(None).cast("string")
    for ext in reversed(V.DOC_EXTENSIONS):
        out = F.when(lowered.endswith(ext), F.left(value, F.length(value) - len(ext))).otherwise(out)
    return out


def doc_aliases(*names) -> Column:
    """Normalised names and extension-free stems under which a question may mention a document."""
    raw = F.array(*[text_or_empty(n) for n in names])
    both = F.flatten(
        F.transform(raw, lambda v: F.array(normalize_doc_ref(v), normalize_doc_ref(extension_stem(v))))
    )
    return F.array_distinct(F.filter(both, lambda a: a != ""))


def doc_tokens(c) -> Column:
    """Distinct title or query tokens longer than one character, stop words removed."""
    return F.array_distinct(
        F.filter(lower_tokens(c), lambda t: (F.length(t) > 1) & ~t.isin(V.QUERY_STOPWORDS))
    )


def lexical_overlap(query_tokens, candidate_tokens) -> Column:
    """Share of distinct query tokens present in the candidate."""
    q, t = col(query_tokens), col(candidate_tokens)
    return F.when(
        (F.size(q) > 0) & (F.size(t) > 0), F.size(F.array_intersect(q, t)) / F.size(q).cast("double")
    ).otherwise(F.lit(0.0))


def ordered_union(*arrays) -> Column:
    """Distinct trimmed non-blank values in first-seen order."""
    empty = F.array().cast("array<string>")
    joined = F.concat(*[F.coalesce(col(a), empty) for a in arrays])
    return F.array_distinct(F.filter(F.transform(joined, blank_to_null), lambda v: v.isNotNull()))


def content_hash(c) -> Column:
    return F.sha2(col(c), 256)


def safe_doc_id(c) -> Column:
    return F.translate(col(c), "\\/:", "___")
