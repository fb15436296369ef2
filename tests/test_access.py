from pyspark.sql import functions as F

from wardstone.functions import acl as A
from wardstone.functions import identity as ID
from wardstone.operators import access as AC

PEOPLE = [
    ("hr", True, "u1", "hr@example.com", "example.com", ["HR"]),
    ("finance", True, "u2", "fin@example.com", "example.com", ["finance"]),
    ("anon", False, None, None, None, []),
    ("mail", True, None, "Solo@Else.org", None, []),
    ("domain", True, None, None, "Else.org", []),
]
P = "principal_id string, authenticated boolean, user_id string, email string, domain string, groups array<string>"
ACL = "struct<allowed_emails:array<string>,allowed_domains:array<string>,allowed_users:array<string>,allowed_groups:array<string>,is_public:boolean>"
DOCS = [
    ("public", ([], [], [], [], True)),
    ("fin_only", ([], [], [], ["Finance"], False)),
    ("hr_only", ([], [], [], ["hr"], False)),
    ("by_mail", (["solo@else.org"], [], [], [], False)),
    ("by_domain", ([], ["else.org"], [], [], False)),
    ("by_user", ([], [], ["U1"], [], False)),
]
WANT = {
    "hr": {"public", "hr_only", "by_user"}, "finance": {"public", "fin_only"}, "anon": {"public"}, "mail": {"public", "by_mail"},
    "domain": {"public", "by_domain"},
}


def test_matrix_same_in_all_forms(spark):
    people, docs = spark.createDataFrame(PEOPLE, P), spark.createDataFrame(DOCS, f"doc_id string, acl {ACL}")
    got = {}
    for p, d in AC.authorize_pairs(docs, people).collect():
        got.setdefault(p, set()).add(d)
    assert got == WANT
    rows = AC.authorize_classes(docs.unionByName(docs.withColumn("doc_id", F.concat("doc_id", F.lit("_copy")))), people.unionByName(people.withColumn("principal_id", F.concat("principal_id", F.lit("_too"))))).collect()
    pairs, who = {(p, d) for k, p, d in rows if k == "pair"}, {p: c for k, p, c in rows if k == "principal"}
    what = {d: c for k, c, d in rows if k == "document"}
    assert len(who) == 2 * len(PEOPLE) and len(what) == 2 * len(DOCS) and len([r for r in rows if r[0] == "pair"]) == sum(map(len, WANT.values()))
    for p, c in who.items():
        assert {d for d, k in what.items() if (c, k) in pairs} == {x + e for x in WANT[p.removesuffix("_too")] for e in ("", "_copy")}
    counts = {r.principal_id: r.visible_docs for r in AC.visible_counts(docs, people).collect()}
    assert counts == {k: len(v) for k, v in WANT.items()}
    both = docs.join(people, F.lit(True))
    seen = both.filter(A.access_allowed(F.col("acl"), "user_id", "email", "domain", "groups")).select("principal_id", "doc_id")
    rows = {}
    for p, d in seen.collect():
        rows.setdefault(p, set()).add(d)
    assert rows == WANT
    allow = both.withColumn("d", A.policy_decision(F.col("acl"), "authenticated", "user_id", "email", "domain", "groups"))
    allowed = {(r.principal_id, r.doc_id): r.d.reason for r in allow.collect() if r.d.allow}
    assert ("anon", "public") not in allowed and allowed[("hr", "public")] == "public_document"
    assert allowed[("hr", "by_user")] == "allowed_user_match" and allowed[("domain", "by_domain")] == "transitional_allowed_domain"


def test_run_decision_is_last_allowed(spark):
    people, docs = spark.createDataFrame(PEOPLE, P), spark.createDataFrame(DOCS, f"doc_id string, acl {ACL}")
    ranked = docs.withColumn("rank", F.row_number().over(__import__("pyspark.sql.window", fromlist=["Window"]).Window.orderBy(F.monotonically_increasing_id())))
    ranked = ranked.withColumns({"query_id": F.lit("q"), "principal_id": F.lit("hr")}).unionByName(
        ranked.withColumns({"query_id": F.lit("z"), "principal_id": F.lit("anon")})
    )
    allowed, runs = AC.authorize_ranked(ranked, people)
    assert {r.doc_id for r in allowed.collect()} == WANT["hr"]
    by_query = {r.query_id: r.decision.reason for r in runs.collect()}
    assert by_query == {"q": "allowed_user_match", "z": "default_deny"}


def test_nested_lists(spark):
    df = spark.createDataFrame([(None, (["A"], True), None)], "allowed_groups array<string>, permissions_summary struct<allowed_groups:array<string>,is_public:boolean>, x int")
    a = df.select(A.extract_acl(df.schema).alias("a")).first().a
    assert a.allowed_groups == ["a"] and a.is_public


def test_group_map(spark):
    people = spark.createDataFrame([("p", ["/HR"])], "principal_id string, groups array<string>")
    gm = spark.createDataFrame([("hr", ["b@x.org", "a@x.org"])], "group_name string, mapped array<string>")
    assert AC.expand_groups(people, gm).first().groups == ["a@x.org", "b@x.org", "hr"]
    assert AC.expand_groups(people, gm.limit(0)).first().groups == ["/HR"]
    assert spark.range(1).select(ID.normalize_group_map(F.lit("{bad")).alias("m")).first().m == {}


def test_claims(spark):
    c = F.from_json(F.lit('{"sub":"s","upn":"A@B.org","groups":["/Z","a","z"]}'), ID.CLAIMS_SCHEMA)
    p = spark.range(1).select(ID.entitlements_from_claims(c).alias("p")).first().p
    assert (p.user_id, p.email, p.domain, p.groups) == ("s", "a@b.org", "b.org", ["a", "z"])


def test_visibility_never_leaks(spark):
    people, docs = spark.createDataFrame(PEOPLE, P), spark.createDataFrame(DOCS, f"doc_id string, acl {ACL}")
    asked = AC.make_pools(AC.with_principal_tokens(people).withColumn("query_id", F.col("principal_id")))
    seen = AC.visible_nodes(AC.with_signature(docs), asked).pairs("doc_id")
    pool = {r.pool_id: r.query_id for r in asked.collect()}
    got = {}
    for d, p in seen.collect():
        got.setdefault(pool[p], set()).add(d)
    assert got == WANT


def test_all_pairs_are_listed(spark):
    from wardstone.catalog import corpus as C
    from wardstone.catalog.access_queries import _suppliers, authorized_pairs

    sf = "/root/testdata/sf0.001"
    got = authorized_pairs(spark, sf)
    assert sorted(got.columns) == ["doc_id", "principal_id"]
    both = C.docs(spark, sf).select("doc_id", "acl").join(_suppliers(spark, sf), F.lit(True))
    want = both.filter(A.access_allowed(F.col("acl"), "user_id", "email", "domain", "groups")).select("principal_id", "doc_id")
    names = ("principal_id", "doc_id")
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(map(tuple, want.collect()))
