"""Rank fusion, diversification, caps, budgets and reranking over ranked DataFrames.

A ranked DataFrame holds one row per (query_id, node_id) with ``rank`` counted from 1. Rank lists are
top-k results, so per-query windows are bounded by k; anything read before a cut is cut in parallel first.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardstone import vocab as V
from wardstone.functions.text import col, lexical_overlap, strip, text_or_empty
from wardstone.functions.vectors import cosine
from wardstone.operators.skew import topk_per_key


def candidate_sizes(queries: DataFrame, requested: str = "top_k") -> DataFrame:
    """Final, candidate and lexical-pool sizes derived from each request's top_k."""
    asked = F.when(F.col(requested) > 0, F.col(requested)).otherwise(F.lit(V.TOP_K_FUSED))
    final = F.greatest(F.lit(1), F.least(asked, F.lit(V.TOP_K_FUSED)))
    cand = F.greatest(final, F.least(final * V.CANDIDATE_MULTIPLIER, F.lit(V.CANDIDATE_MAX)))
    pool = F.greatest(F.lit(V.BM25_POOL_MIN), F.least(cand * 10, F.lit(V.BM25_POOL_MAX)))
    return queries.withColumns({"final_k": final, "candidate_k": cand, "pool_k": pool})


def rrf_fuse(rankings: DataFrame, k: int = V.RRF_K, limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of channels (query_id, channel, rank, node_id).

    Contributions are added in channel order so that equal sums stay equal; ties keep first appearance.
    """
    pairs = F.array_sort(F.collect_list(F.struct("channel", "rank")))
    fused = rankings.groupBy("query_id", "node_id").agg(pairs.alias("_at")).select(
        "query_id",
        "node_id",
        F.aggregate("_at", F.lit(0.0), lambda s, x: s + F.lit(1.0) / (F.lit(k) + x["rank"])).alias("score"),
        F.col("_at")[0].alias("_first"),
    )
    order = [F.col("score").desc(), F.col("_first").asc()]
    if limit is not None:
        return topk_per_key(fused, ["query_id"], order, limit).drop("_first")
    w = Window.partitionBy("query_id").orderBy(*order)
    return fused.withColumn("rank", F.row_number().over(w)).drop("_first")


def diversify_by_doc(
    ranked: DataFrame, per_doc_max: int, final_k, query: str = "query_id", doc: str = "doc_id", rank: str = "rank"
) -> DataFrame:
    """Round-robin over documents in first-appearance order, capped per document and in total.

    The r-th node of each document belongs to round r; rounds are emitted in document order.
    """
    turn = Window.partitionBy(query, doc).orderBy(rank)
    picked = ranked.withColumn("_round", F.row_number().over(turn)).filter(F.col("_round") <= per_doc_max)
    lead = Window.partitionBy(query, doc)
    picked = picked.withColumn("_lead", F.min(rank).over(lead))
    bound = F.lit(final_k) if isinstance(final_k, int) else F.col(final_k)
    out = Window.partitionBy(query).orderBy("_round", "_lead")
    return (
        picked.withColumn("_new", F.row_number().over(out))
        .filter(F.col("_new") <= bound)
        .drop(rank, "_round", "_lead")
        .withColumnRenamed("_new", rank)
    )


def cap_row_blocks(ranked: DataFrame, n: int = V.GENERATION_MAX_BLOCKS_PER_SHEET) -> DataFrame:
    """First n row blocks per (query, document, sheet); every other node passes untouched."""
    is_block = F.coalesce((F.col("source_kind") == "tabular") & (F.col("tabular_node_type") == "row_block"), F.lit(False))
    if n <= 0:
        return ranked
    w = Window.partitionBy("query_id", "doc_id", F.coalesce("sheet_name", F.lit(""))).orderBy("rank")
    blocks = ranked.filter(is_block).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
    return ranked.filter(~is_block).unionByName(blocks)


def minmax(score, by: str = "query_id") -> Column:
    """Scores scaled to [0, 1] within a query; a flat list maps to one half."""
    w = Window.partitionBy(by)
    lo, hi = F.min(col(score)).over(w), F.max(col(score)).over(w)
    return F.when(hi > lo, (col(score) - lo) / (hi - lo)).otherwise(F.lit(0.5))


def rerank(candidates: DataFrame, head: int | None = None, weights=V.RERANK_WEIGHTS) -> DataFrame:
    """Blend of cosine, token overlap and scaled prior score over the head; the tail keeps its order.

    Needs query_id, node_id, rank, score, tokens, embedding, query_tokens, query_embedding.
    """
    in_head = F.lit(True) if head is None else F.col("rank") <= head
    top = candidates.filter(in_head)
    a, b, c = weights
    blended = top.withColumn(
        "score",
        F.round(
            a * cosine("query_embedding", "embedding")
            + b * lexical_overlap("query_tokens", "tokens")
            + c * minmax("score"),
            12,
        ),
    ).withColumn("_tail", F.lit(0))
    if head is not None:
        blended = blended.unionByName(candidates.filter(~in_head).withColumn("_tail", F.lit(1)))
    w = Window.partitionBy("query_id").orderBy(
        "_tail", F.when(F.col("_tail") == 0, F.col("score")).desc_nulls_last(), "rank"
    )
    return blended.withColumn("_new", F.row_number().over(w)).drop("rank", "_tail").withColumnRenamed("_new", "rank")


def context_block() -> Column:
    """A row of evidence as it stands in the context."""
    return F.concat(F.lit("[E"), F.col("rank").cast("string"), F.lit("] "), strip(text_or_empty("text")), F.lit("\n"))


def context(ranked: DataFrame, max_chars: int = V.CONTEXT_MAX_CHARS) -> DataFrame:
    """Evidence blocks ``[En] text`` per query, stopping at the first one that would overflow.

    Blocks that no longer fit come after one that did not, so a running length finds the cut.
    """
    text = strip(text_or_empty("text"))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = (
        ranked.filter(text != "")
        .withColumn("_block", context_block())
        .withColumn("_upto", F.sum(F.length("_block")).over(w))
        .filter(F.col("_upto") <= max_chars)
    )
    parts = F.array_sort(F.collect_list(F.struct("rank", "_block")))
    return fits.groupBy("query_id").agg(
        F.array_join(F.transform(parts, lambda p: p["_block"]), "\n").alias("context"),
        F.count("*").alias("blocks"),
    )


def doc_snippets(ranked: DataFrame, max_chars: int = V.SUMMARY_CHARS_PER_DOC) -> DataFrame:
    """Texts of a document joined under a character budget; the last piece is cut to fit."""
    text = strip(text_or_empty("text"))
    before = (
        Window.partitionBy("query_id", "doc_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    )
    pieces = (
        ranked.filter(text != "")
        .withColumn("_t", text)
        .withColumn("_used", F.coalesce(F.sum(F.length("_t")).over(before), F.lit(0)))
        .filter(F.col("_used") < max_chars)
        .withColumn("_t", F.left("_t", max_chars - F.col("_used")))
    )
    parts = F.array_sort(F.collect_list(F.struct("rank", "_t")))
    return pieces.groupBy("query_id", "doc_id").agg(
        F.array_join(F.transform(parts, lambda p: p["_t"]), "\n").alias("snippet")
    )


def image_paths(ranked: DataFrame, n: int = V.VLM_MAX_IMAGES) -> DataFrame:
    """First n distinct image paths per query in rank order."""
    path = strip(text_or_empty("image_path"))
    first = (
        ranked.filter((F.coalesce("modality", F.lit("text")) == "image") & (path != ""))
        .groupBy("query_id", path.alias("image_path"))
        .agg(F.min("rank").alias("rank"))
    )
    return topk_per_key(first, ["query_id"], [F.col("rank").asc()], max(1, n), rank_col="position")


def best_node_per_doc(nodes: DataFrame, pos: str = "node_id", keys: list[str] | None = None) -> DataFrame:
    """Most document-like node of each document: text over image, summaries first, page one preferred."""
    weight = (
        F.when(F.coalesce(F.col("modality"), F.lit("text")) == "text", 10).otherwise(0)
        + F.when(F.col("tabular_node_type") == "workbook_summary", 5)
        .when(F.col("tabular_node_type") == "sheet_summary", 3)
        .otherwise(0)
        + F.when(F.col("page") == 1, 1).otherwise(0)
    )
    docs = nodes.filter(F.coalesce(strip("doc_id"), F.lit("")) != "").withColumn("node_weight", weight)
    order = [F.col("node_weight").desc(), F.col(pos).asc()]
    return topk_per_key(docs, [*(keys or []), "doc_id"], order, 1, rank_col="_one").drop("_one")


def keep_indices(ranked: DataFrame, indices: str) -> DataFrame:
    """Rows whose position is listed in an index array, renumbered from 1."""
    kept = ranked.filter(F.array_contains(indices, F.col("rank")))
    w = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(w))


def number_citations(ranked: DataFrame) -> DataFrame:
    """Marker number of every cited node in its query."""
    w = Window.partitionBy("query_id").orderBy("rank")
    return ranked.withColumn("marker", F.row_number().over(w))


def recent_documents(registry: DataFrame, limit: int, sources: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Most recently updated registry rows, source filter first; ``most`` bounds what a caller may ask for."""
    rows = registry.filter(F.col("source").isin(sources)) if sources else registry
    n = max(1, int(limit) if most is None else min(int(limit), most))
    return rows.orderBy(F.col("updated_at").desc(), F.col("doc_id").asc()).limit(n)
