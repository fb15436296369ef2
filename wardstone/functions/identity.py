"""Principals: groups, emails, claims and group maps."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardstone.functions.text import col, first_filled, strip, text_or_empty

CLAIMS_SCHEMA = (
    "struct<email:string,upn:string,emailAddress:string,preferred_username:string,sub:string,iss:string,"
    "groups:array<string>,realm_access:struct<roles:array<string>>,"
    "resource_access:map<string,struct<roles:array<string>>>>"
)
EMPTY = "array<string>"


def normalize_group(c) -> Column:
    return F.ltrim(F.lower(strip(text_or_empty(c))), F.lit("/"))


def normalized_groups(arr) -> Column:
    """Sorted distinct normalised names, blanks dropped."""
    arr = F.coalesce(col(arr), F.array().cast(EMPTY))
    return F.array_sort(F.array_distinct(F.filter(F.transform(arr, normalize_group), lambda g: g != "")))


def lowered(arr) -> Column:
    return F.transform(F.coalesce(col(arr), F.array().cast(EMPTY)), F.lower)


def first_email_like(*candidates) -> Column:
    tidy = [F.lower(strip(text_or_empty(c))) for c in candidates]
    return F.coalesce(*[F.when(t.contains("@"), t) for t in tidy])


def email_domain(email) -> Column:
    e = col(email)
    return F.when(e.contains("@"), F.regexp_extract(e, "^[^@]*@(.*)$", 1))


def pseudonymize(user_id, email) -> Column:
    who = F.lower(strip(text_or_empty(first_filled(user_id, email))))
    return F.when(who != "", F.sha2(who, 256))


def _present(arr) -> Column:
    return F.filter(F.coalesce(arr, F.array().cast(EMPTY)), lambda g: g.isNotNull() & (g != ""))


def claim_groups(claims: Column) -> Column:
    """groups, else realm roles, else the roles of every client; first non-empty list wins."""
    own = _present(claims["groups"])
    realm = _present(claims["realm_access"]["roles"])
    client = F.flatten(
        F.transform(
            F.coalesce(F.map_values(claims["resource_access"]), F.array().cast("array<struct<roles:array<string>>>")),
            lambda c: _present(c["roles"]),
        )
    )
    return normalized_groups(F.when(F.size(own) > 0, own).when(F.size(realm) > 0, realm).otherwise(client))


def entitlements_from_claims(claims: Column) -> Column:
    email = first_email_like(
        claims["email"], claims["upn"], claims["emailAddress"], claims["preferred_username"]
    )
    return F.struct(
        F.lit(True).alias("authenticated"),
        first_filled(claims["sub"], claims["preferred_username"]).alias("user_id"),
        email.alias("email"),
        email_domain(email).alias("domain"),
        claim_groups(claims).alias("groups"),
    )


def entitlements_from_context(user_id, email, domain, groups) -> Column:
    mail = F.nullif(F.lower(text_or_empty(email)), F.lit(""))
    dom = F.coalesce(F.nullif(col(domain), F.lit("")), email_domain(mail))
    return F.struct(
        (mail.isNotNull() | F.nullif(col(user_id), F.lit("")).isNotNull()).alias("authenticated"),
        col(user_id).alias("user_id"),
        mail.alias("email"),
        F.lower(dom).alias("domain"),
        lowered(groups).alias("groups"),
    )


def merge_userinfo(claims: Column, info: Column) -> Column:
    """Fill email, username, subject and groups from user info, only where the claims lack them."""

    def text_or(name):
        return F.coalesce(F.nullif(claims[name], F.lit("")), F.nullif(info[name], F.lit("")), claims[name])

    has_email = F.coalesce(claims["email"] != "", F.lit(False))
    has_groups = (F.size(F.coalesce(claims["groups"], F.array().cast(EMPTY))) > 0) | (
        F.size(F.coalesce(claims["realm_access"]["roles"], F.array().cast(EMPTY))) > 0
    )
    enrich = (~has_email | ~has_groups) & info.isNotNull()
    groups = F.when(F.size(F.coalesce(claims["groups"], F.array().cast(EMPTY))) > 0, claims["groups"]).otherwise(
        info["groups"]
    )
    merged = claims
    for name in ("email", "preferred_username", "sub"):
        merged = merged.withField(name, text_or(name))
    return F.when(enrich, merged.withField("groups", groups)).otherwise(claims)


def normalize_group_map(raw_json) -> Column:
    """JSON text of group -> name or list of names, as a map of sorted lists; bad input gives an empty map."""
    empty = F.create_map().cast("map<string,array<string>>")
    parsed = F.try_parse_json(text_or_empty(raw_json))
    obj = F.from_json(
        F.when(parsed.isNotNull() & (F.schema_of_variant(parsed).startswith("OBJECT")), F.to_json(parsed)),
        "map<string,variant>",
    )

    def names(v):
        kind = F.schema_of_variant(v)
        return (
            F.when(kind == "STRING", normalized_groups(F.array(v.cast("string"))))
            .when(kind.startswith("ARRAY"), normalized_groups(F.from_json(F.to_json(v), "array<string>")))
            .otherwise(F.array().cast(EMPTY))
        )

    entries = F.transform(
        F.map_entries(obj),
        lambda e: F.struct(normalize_group(e["key"]).alias("key"), names(e["value"]).alias("value")),
    )
    kept = F.filter(entries, lambda e: (e["key"] != "") & (F.size(e["value"]) > 0))
    # later spellings of the same key win, as with repeated assignment
    last = F.filter(
        F.transform(kept, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), i.alias("i"))),
        lambda e: ~F.exists(F.slice(kept, e["i"] + 2, F.size(kept)), lambda o: o["key"] == e["key"]),
    )
    as_map = F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
    return F.coalesce(as_map, empty)


def has_admin_role(groups, admin_groups) -> Column:
    return F.arrays_overlap(normalized_groups(groups), normalized_groups(admin_groups))


def issuer_allowed(issuer, allowed) -> Column:
    def tidy(c):
        return F.rtrim(F.lower(strip(text_or_empty(c))), F.lit("/"))

    allow = F.filter(F.transform(col(allowed), tidy), lambda v: v != "")
    return F.array_contains(allow, tidy(issuer))


def audience_allowed(audiences, expected) -> Column:
    """An empty expectation admits every audience."""
    want = F.filter(F.transform(col(expected), strip), lambda v: v != "")
    have = F.coalesce(col(audiences), F.array().cast(EMPTY))
    return (F.size(want) == 0) | F.arrays_overlap(have, want)
