"""Counters, load summaries, feedback, access preview and evaluation checks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstone import vocab as V
from wardstone.functions import acl as A
from wardstone.functions.text import strip, text_or_empty
from wardstone.operators.access import visible_counts
from wardstone.operators.ranking import recent_documents
from wardstone.operators.skew import nearest_rank_percentiles, topk_per_key


def run_counters(docs: DataFrame, skipped: DataFrame, errors: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: added, skipped, errors, text and image nodes."""
    tagged = (
        docs.select(F.lit("added").alias("k"))
        .unionByName(skipped.select(F.lit("skipped").alias("k")))
        .unionByName(errors.select(F.lit("errors").alias("k")))
        .unionByName(nodes.select(F.concat(F.col("modality"), F.lit("_nodes")).alias("k")))
    )
    names = ["added", "skipped", "errors", "text_nodes", "image_nodes"]
    return tagged.agg(*[F.count_if(F.col("k") == n).alias(n) for n in names])


def registry_diff(old: DataFrame, new: DataFrame, hashes: tuple[str, ...] = ("content_hash",)) -> DataFrame:
    """added / updated / unchanged / deleted per document by the hashes given; a hash the old rows lack counts as changed."""
    values = [F.coalesce(F.col(h), F.lit("")) for h in hashes]
    before = [F.coalesce(F.col(h), F.lit("")) if h in old.columns else F.lit("") for h in hashes]
    o = old.select("doc_id", F.struct(*[v.alias(h) for v, h in zip(before, hashes)]).alias("_old"))
    n = new.select("doc_id", F.struct(*[v.alias(h) for v, h in zip(values, hashes)]).alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "deleted")
        .when(F.col("_old") != F.col("_new"), "updated")
        .otherwise("unchanged")
    )
    return o.join(n, "doc_id", "full_outer").select("doc_id", change.alias("change"))


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change").agg(F.count("*").alias("docs"))


def preview_access(registry: DataFrame, principals: DataFrame, limit: int, sources: list[str] | None = None) -> DataFrame:
    """Per principal: documents scanned and allowed among the most recent ones (limit first, then access).

    Only ever scans at most 500 registry rows, so the pair check stays small; it still runs on token
    classes, and counts rather than lists the pairs.
    """
    recent = recent_documents(registry, limit, sources)
    scanned = recent.agg(F.count("*")).scalar()
    return visible_counts(recent, principals).select(
        "principal_id", scanned.alias("total_scanned"), F.col("visible_docs").alias("allowed_count")
    )


def request_metrics(log: DataFrame, buckets: list[float] = V.LATENCY_BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(request counts by method, path, status; cumulative latency histogram by method and path)."""
    counts = log.groupBy("method", "path", "status").agg(F.count("*").alias("requests"))
    cells = [F.count_if(F.col("latency") <= b).alias(f"le_{i}") for i, b in enumerate(buckets)]
    hist = log.groupBy("method", "path").agg(
        *cells, F.count("*").alias("le_inf"), F.sum("latency").alias("latency_sum")
    )
    bounds = F.map_from_arrays(
        F.array(*[F.lit(str(b)) for b in buckets], F.lit("+Inf")),
        F.array(*[F.col(f"le_{i}") for i in range(len(buckets))], F.col("le_inf")),
    )
    wide = hist.select("method", "path", "latency_sum", F.explode(bounds).alias("le", "requests"))
    return counts, wide


def load_summary(
    log: DataFrame, keys: list[str], elapsed: float | Column, max_failure_rate: float = 0.05, exact: bool = True
) -> DataFrame:
    """Totals, failure rate, throughput, nearest-rank p50 / p95 and mean of successes, and the gate."""
    span = F.lit(elapsed) if isinstance(elapsed, (int, float)) else elapsed
    good = F.when(F.col("ok"), F.col("latency"))
    base = log.groupBy(*keys).agg(
        F.count("*").alias("total_requests"),
        F.count_if("ok").alias("success_requests"),
        F.count_if(~F.col("ok")).alias("failed_requests"),
        F.coalesce(F.avg(good), F.lit(0.0)).alias("avg_latency"),
        span.alias("elapsed"),
    )
    rate = F.col("failed_requests") / F.col("total_requests")
    base = base.withColumns(
        {
            "failure_rate": rate,
            "throughput": F.when(F.col("elapsed") > 0, F.col("total_requests") / F.col("elapsed")).otherwise(F.lit(0.0)),
            "passed": rate <= max_failure_rate,
        }
    )
    if exact:
        pct = nearest_rank_percentiles(log.filter("ok"), keys, "latency", [50, 95])
        wide = pct.groupBy(*keys).agg(
            F.max(F.when(F.col("percent") == 50, F.col("value"))).alias("p50_latency"),
            F.max(F.when(F.col("percent") == 95, F.col("value"))).alias("p95_latency"),
        )
    else:
        wide = log.filter("ok").groupBy(*keys).agg(
            F.percentile_approx("latency", 0.5, 10000).alias("p50_latency"),
            F.percentile_approx("latency", 0.95, 10000).alias("p95_latency"),
        )
    joined = base.join(wide, keys, "left") if keys else base.withColumn("_k", F.lit(1)).join(wide.withColumn("_k", F.lit(1)), "_k", "left").drop("_k")
    return joined.withColumns(
        {c: F.coalesce(c, F.lit(0.0)) for c in ("p50_latency", "p95_latency")}
    )


def failure_samples(log: DataFrame, keys: list[str], order: str, n: int = 5) -> DataFrame:
    """First n failures per group with status and error."""
    return topk_per_key(log.filter(~F.col("ok")), keys, [F.col(order).asc()], n, rank_col="sample")


def stage_counts(stages: DataFrame) -> DataFrame:
    """One row per question with the number of nodes that reached each stage.

    ``stages``: query_id, stage, from a union of the pipeline's outputs; one aggregation for all of them.
    """
    names = ["evidence", "allowed", "usable", "scoped", "generation", "citation"]
    return stages.groupBy("query_id").agg(*[F.count_if(F.col("stage") == n).alias(f"{n}_count") for n in names])


def feedback_summary(feedback: DataFrame, runs: DataFrame) -> DataFrame:
    """Up and down counts per run, runs without feedback included."""
    votes = feedback.groupBy("run_id").agg(
        F.count_if(F.col("thumb") == "up").alias("up"), F.count_if(F.col("thumb") == "down").alias("down")
    )
    return runs.select("run_id").join(votes, "run_id", "left").select(
        "run_id", F.coalesce("up", F.lit(0)).alias("up"), F.coalesce("down", F.lit(0)).alias("down")
    )


def compare_modes(results: DataFrame) -> DataFrame:
    """Text-only and multimodal results of the same question side by side."""
    cols = ["question", "citations", "refusal_reason"]
    text = results.filter(~F.col("include_images")).select(*cols)
    both = results.filter("include_images").select(*cols)
    return text.alias("t").join(both.alias("m"), "question").select(
        "question",
        F.col("t.citations").alias("text_only_citations"),
        F.col("m.citations").alias("multimodal_citations"),
        F.col("t.refusal_reason").alias("text_only_refusal"),
        F.col("m.refusal_reason").alias("multimodal_refusal"),
    )


def check_cases(cases: DataFrame, responses: DataFrame) -> DataFrame:
    """Expected against actual outcome per case: PASS or FAIL with the first reason that applies.

    cases: id, expect, expect_status, min_citations, must_contain, must_not_contain;
    responses: id, status_code, answer, refusal_reason, citations.
    """
    empty = F.array().cast("array<string>")
    j = cases.join(responses, "id", "left")
    answer = F.lower(text_or_empty("answer"))
    expect = F.lower(strip(F.coalesce("expect", F.lit("refuse"))))
    want_status = F.coalesce("expect_status", F.lit(200))
    refused = F.coalesce(F.col("refusal_reason") != "", F.lit(False))
    met = (
        F.when(expect.isin("refuse", "deny"), refused)
        .when(
            expect == "answer_with_citation",
            ~refused & (F.coalesce("citations", F.lit(0)) >= F.coalesce("min_citations", F.lit(1))),
        )
        .when(expect == "answer", ~refused & (strip(answer) != ""))
    )
    need = F.transform(F.coalesce("must_contain", empty), F.lower)
    avoid = F.transform(F.coalesce("must_not_contain", empty), F.lower)
    reason = (
        F.when(F.col("status_code").isNull(), F.lit("no_response"))
        .when(
            F.col("status_code") != want_status,
            F.concat(F.lit("unexpected_status:"), F.col("status_code").cast("string"), F.lit("!= "), want_status.cast("string")),
        )
        .when(met.isNull(), F.concat(F.lit("unknown_expectation:"), expect))
        .when(~met, F.concat(F.lit("expectation_failed:"), expect))
        .when(~F.forall(need, lambda t: answer.contains(t)), F.lit("missing_required_terms"))
        .when(F.exists(avoid, lambda t: answer.contains(t)), F.lit("forbidden_terms_present"))
        .otherwise(F.lit("ok"))
    )
    return j.select(
        "id",
        F.when(reason == "ok", "PASS").otherwise("FAIL").alias("status"),
        "status_code",
        reason.alias("reason"),
        "refusal_reason",
        F.coalesce("citations", F.lit(0)).alias("citations"),
        F.left(answer, F.lit(120)).alias("answer_preview"),
    )


def case_summary(checked: DataFrame) -> DataFrame:
    return checked.groupBy("status").agg(F.count("*").alias("cases"))


def allowed_documents(registry: DataFrame, principal: dict) -> DataFrame:
    """Registry rows one principal may open."""
    groups = F.array(*[F.lit(g) for g in principal.get("groups", [])]).cast("array<string>")
    ok = A.access_allowed(
        F.col("acl"),
        F.lit(principal.get("user_id")).cast("string"),
        F.lit(principal.get("email")).cast("string"),
        F.lit(principal.get("domain")).cast("string"),
        groups,
    )
    return registry.filter(ok)


