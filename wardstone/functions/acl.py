"""Access-control expressions: list extraction, token form, row checks and policy decisions."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardstone import vocab as V
from wardstone.functions.identity import lowered
from wardstone.functions.text import col, text_or_empty

LISTS = ["allowed_emails", "allowed_domains", "allowed_users", "allowed_groups"]
PUBLIC_TOKEN = "*"


def _nested(schema: T.StructType, path: list[str]) -> Column | None:
    node, cur = None, schema
    for part in path:
        if not isinstance(cur, T.StructType) or part not in cur.fieldNames():
            return None
        node = F.col(part) if node is None else node[part]
        cur = cur[part].dataType
    return node


def extract_acl(schema: T.StructType) -> Column:
    """ACL struct from flat columns, else permissions_summary, else metadata.permissions_summary."""
    roots = [[], ["permissions_summary"], ["metadata", "permissions_summary"]]

    def pick(name, default):
        found = [c for c in (_nested(schema, r + [name]) for r in roots) if c is not None]
        return F.coalesce(*found, default)

    empty = F.array().cast("array<string>")
    return F.struct(
        *[lowered(pick(n, empty)).alias(n) for n in LISTS],
        pick("is_public", F.lit(False)).alias("is_public"),
    )


def acl_tokens(acl: Column) -> Column:
    """Sorted distinct tokens that open a document. A public one needs just the public token, so all
    public documents share one signature and stay out of the per-member joins."""

    def tagged(tag, name):
        return F.transform(lowered(acl[name]), lambda v: F.concat(F.lit(tag), v))

    private = F.array_sort(
        F.array_distinct(
            F.concat(
                tagged("e:", "allowed_emails"),
                tagged("d:", "allowed_domains"),
                tagged("u:", "allowed_users"),
                tagged("g:", "allowed_groups"),
            )
        )
    )
    return F.when(F.coalesce(acl["is_public"], F.lit(False)), F.array(F.lit(PUBLIC_TOKEN))).otherwise(private)


def principal_tokens(user_id, email, domain, groups) -> Column:
    """Every token the principal holds; always includes the public one."""

    def one(tag, c):
        c = F.lower(text_or_empty(c))
        return F.when(c != "", F.array(F.concat(F.lit(tag), c))).otherwise(F.array().cast("array<string>"))

    return F.array_sort(
        F.array_distinct(
            F.concat(
                F.array(F.lit(PUBLIC_TOKEN)),
                one("e:", email),
                one("d:", domain),
                one("u:", user_id),
                F.transform(F.filter(lowered(groups), lambda g: g.isNotNull()), lambda g: F.concat(F.lit("g:"), g)),
            )
        )
    )


def access_allowed(acl: Column, user_id, email, domain, groups) -> Column:
    """Row check with both sides lower-cased; public rows pass for anyone."""

    def listed(name, c):
        v = F.lower(text_or_empty(c))
        return (v != "") & F.array_contains(lowered(acl[name]), v)

    return F.coalesce(
        F.coalesce(acl["is_public"], F.lit(False))
        | listed("allowed_emails", email)
        | listed("allowed_domains", domain)
        | listed("allowed_users", user_id)
        | F.arrays_overlap(lowered(acl["allowed_groups"]), lowered(groups)),
        F.lit(False),
    )


def _decision(allow: bool, reason: str) -> Column:
    return F.struct(
        F.lit(allow).alias("allow"), F.lit(reason).alias("reason"), F.lit(V.POLICY_VERSION).alias("policy_version")
    )


def policy_decision(acl: Column, authenticated, user_id, email, domain, groups, transitional=True) -> Column:
    """First matching rule: public, user, group, then e-mail and domain while those are still honoured."""
    signed_in = F.coalesce(col(authenticated), F.lit(False))

    def listed(name, c):
        v = F.lower(text_or_empty(c))
        return signed_in & (v != "") & F.coalesce(F.array_contains(lowered(acl[name]), v), F.lit(False))

    old_lists = F.lit(transitional) if isinstance(transitional, bool) else col(transitional)
    shared_group = F.coalesce(F.arrays_overlap(lowered(acl["allowed_groups"]), lowered(groups)), F.lit(False))
    return (
        F.when(signed_in & F.coalesce(acl["is_public"], F.lit(False)), _decision(True, "public_document"))
        .when(listed("allowed_users", user_id), _decision(True, "allowed_user_match"))
        .when(signed_in & shared_group, _decision(True, "allowed_group_match"))
        .when(old_lists & listed("allowed_emails", email), _decision(True, "transitional_allowed_email"))
        .when(old_lists & listed("allowed_domains", domain), _decision(True, "transitional_allowed_domain"))
        .otherwise(_decision(False, "default_deny"))
    )


def decision_or_default(decision: Column, fail_closed: bool = True) -> Column:
    """A missing decision denies (or, by choice, allows) with a reason that names the outage."""
    reason = "opa_unavailable_fail_closed" if fail_closed else "opa_unavailable_fail_open"
    return F.coalesce(decision, _decision(not fail_closed, reason))


def empty_acl_decision() -> Column:
    """Decision for a resource that names nobody."""
    return _decision(False, "default_deny")
