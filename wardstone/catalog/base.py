"""Registry of runnable queries and the SQL that checks them."""

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame query, with the SQL that gives the same rows."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


# --- SQL fragments -----------------------------------------------------------------------


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def arr(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def collapse(x: str) -> str:
    return strip(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def matches(x: str, patterns) -> str:
    return f"regexp_matches({x}, {lit('(?i)' + '|'.join(f'(?:{p})' for p in patterns))})"


def has_any(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(n)})" for n in needles) + ")"


def starts_any(x: str, prefixes) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {lit(p)})" for p in prefixes) + ")"


def tokens(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '[a-zA-Z0-9_]+'), lambda t: lower(t))"


def ordered_distinct(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"
