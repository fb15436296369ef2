"""Audit rows for answered questions and their read-back."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstone import vocab as V
from wardstone.functions.answers import LOCATORS
from wardstone.functions.identity import pseudonymize
from wardstone.functions.ids import stable_point_id


def row_id(*parts) -> "F.Column":
    """Deterministic row identifier, so a retried write produces the same rows."""
    return stable_point_id(F.concat_ws("|", *parts))


def audit_rows(
    runs: DataFrame, evidence: DataFrame, citations: DataFrame, at, keep_raw_query: bool = False
) -> dict[str, DataFrame]:
    """Rows for the audit tables. The user and the question are stored as hashes; the raw question only on request.

    ``runs``: run_id, query, mode, response_status, refusal_reason, user_id, email, groups, decision,
    model_id, model_version.
    """
    user_hash = pseudonymize("user_id", "email")
    decision_id = row_id("run_id", F.lit("decision"))
    policy = runs.select(
        decision_id.alias("decision_id"), "run_id", at.alias("timestamp"), user_hash.alias("user_id_hash"),
        F.col("groups").alias("user_groups"), F.to_json(F.struct(F.lit(True).alias("query_hash_only"))).alias("policy_input"),
        F.to_json("decision").alias("policy_result"), F.col("decision.policy_version").alias("policy_version"),
    )
    queries = runs.select(
        "run_id", at.alias("timestamp"), user_hash.alias("user_id_hash"), F.col("groups").alias("user_groups"),
        F.sha2("query", 256).alias("query_hash"),
        (F.col("query") if keep_raw_query else F.lit(None).cast("string")).alias("raw_query"),
        "mode", "response_status", "refusal_reason", "model_id", "model_version",
        F.lit(V.CONFIG_VERSION).alias("config_version"), decision_id.alias("policy_decision_id"),
    )
    locators = [c for c in LOCATORS if c in evidence.columns and c not in ("page", "chunk_id")]
    rows = evidence.select(
        row_id("run_id", "node_id", F.lit("evidence")).alias("id"), "run_id", "node_id", "doc_id", "page", "chunk_id",
        "modality", "score", *locators,
    )
    cited = citations.select(
        row_id("run_id", "node_id", F.lit("citation")).alias("id"), "run_id", "node_id", "doc_id", "page", "chunk_id",
        "modality", "citation_label",
    )
    return {"policy_decisions": policy, "query_runs": queries, "query_run_evidence": rows, "query_run_citations": cited}


def run_detail(runs: DataFrame, evidence: DataFrame, citations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evidence rows of the runs, citation rows with locators taken from the evidence of the same node)."""
    head = runs.select("run_id", "response_status", "refusal_reason")
    ev = head.join(evidence, "run_id", "left")
    locators = [c for c in ("sheet_name", "cell_range", "row_start", "row_end", "tabular_node_type") if c in evidence.columns]
    places = evidence.select("run_id", "node_id", *locators).dropDuplicates(["run_id", "node_id"])
    ci = head.join(citations, "run_id", "left").join(places, ["run_id", "node_id"], "left")
    return ev, ci
