"""Documents to stored nodes, registry and run log."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstone.functions.text import content_hash
from wardstone.operators.chunking import prose_nodes
from wardstone.operators.images import embed
from wardstone.operators.metrics import registry_diff
from wardstone.operators.skew import broadcast_measured, settle
from wardstone.sources.tables import NodeStore, read_or_none, run_event, upsert_registry


def ingest(
    spark: SparkSession,
    docs: DataFrame,
    state_dir: str,
    run_id: str,
    keep: list[str],
    skipped: DataFrame | None = None,
    extra_nodes: DataFrame | None = None,
    embed_udf=None,
    dim: int = 64,
    dry_run: bool = False,
    sync_deletes: bool = False,
) -> DataFrame:
    """Chunk, embed and store documents; returns one row of counts and logs the run.

    Only new and changed documents are chunked and written; a change of text, access list or any other column
    counts, so a revoked access list reaches the stored nodes at once. A document that yields no nodes any more
    loses its old ones. A dry run computes counts and writes nothing
    but its log. ``sync_deletes`` also removes stored documents missing from ``docs``.
    """
    log = f"{state_dir}/runs"
    run_event(spark, run_id, 0, "running", source=None).write.mode("append").parquet(log)
    try:
        docs = with_hashes(docs)
        new = docs.select("doc_id", *HASHES)
        version = _version(spark, f"{state_dir}/registry")
        old = None if version is None else spark.read.parquet(version)
        base = old if old is not None else spark.createDataFrame([], "doc_id string, content_hash string, facts_hash string")
        diff = settle(registry_diff(base, new, HASHES))
        counts = {r.change: r["count"] for r in diff.groupBy("change").count().collect()}
        if not sync_deletes:
            counts["deleted"] = 0
        n_skipped = 0 if skipped is None else skipped.count()
        text_nodes = image_nodes = 0
        if not dry_run:
            dirty = diff.filter(F.col("change").isin("added", "updated")).select("doc_id")
            if counts.get("unchanged"):
                todo = docs.join(broadcast_measured(dirty), "doc_id", "left_semi")
            else:  # every document is new or changed, so none is sought
                todo = docs.filter(F.col("doc_id").isNotNull())
            nodes = prose_nodes(todo, keep)
            if extra_nodes is not None:
                more = extra_nodes.join(dirty, "doc_id", "left_semi")
                nodes = nodes.unionByName(more, allowMissingColumns=True)
            store = NodeStore(spark, f"{state_dir}/nodes")
            store.replace_documents(embed(nodes, embed_udf, dim), todo)
            if sync_deletes and counts.get("deleted"):
                store.delete_documents(diff.filter("change = 'deleted'").select("doc_id"))
            stored = store.read()
            if stored is not None:
                by = stored.join(dirty, "doc_id", "left_semi").groupBy("modality").count().collect()
                sizes = {r.modality: r["count"] for r in by}
                text_nodes, image_nodes = sizes.get("text", 0), sizes.get("image", 0)
            _save_registry(spark, state_dir, old, todo, diff if sync_deletes else None)
        errors = [f"skipped:{n_skipped}"] if n_skipped else []
        facts = {c: counts.get(c, 0) for c in ("added", "updated", "deleted")}
        run_event(
            spark, run_id, 1, "completed_with_errors" if errors else "completed", skipped=n_skipped, errors=errors,
            metadata={"text_nodes_indexed": text_nodes, "image_nodes_indexed": image_nodes}, **facts,
        ).write.mode("append").parquet(log)
    except Exception as exc:
        run_event(spark, run_id, 1, "failed", errors=[str(exc)[:500]]).write.mode("append").parquet(log)
        raise
    row = (facts["added"], facts["updated"], facts["deleted"], n_skipped, text_nodes, image_nodes)
    return spark.createDataFrame(
        [row], "added long, updated long, deleted long, skipped long, text_nodes long, image_nodes long"
    )


HASHES = ("content_hash", "facts_hash")


def with_hashes(docs: DataFrame) -> DataFrame:
    """Documents with a hash of their text and one of everything else that is stored of them: access, paths, times."""
    facts = sorted(c for c in docs.columns if c not in ("doc_id", "text", *HASHES))
    return docs.withColumns({"content_hash": content_hash("text"), "facts_hash": F.sha2(F.to_json(F.struct(*facts), {"ignoreNullFields": "false"}), 256) if facts else F.lit("")})


def _version(spark: SparkSession, root: str) -> str | None:
    log = read_or_none(spark, f"{root}/manifest")
    return None if log is None else f"{root}/v{log.agg(F.max('version')).first()[0]}"


def _save_registry(spark, state_dir, old, docs, diff) -> None:
    root = f"{state_dir}/registry"
    facts = [c for c in docs.columns if c not in ("text", "page_map")]
    now = F.current_timestamp()
    rows = docs.select(*facts)
    if old is None:
        merged = rows.withColumns({"created_at": now, "updated_at": now})
    else:
        merged = upsert_registry(old, rows, now)
        if diff is not None:
            merged = merged.join(diff.filter("change = 'deleted'").select("doc_id"), "doc_id", "left_anti")
    log = read_or_none(spark, f"{root}/manifest")
    version = 1 if log is None else log.agg(F.max("version")).first()[0] + 1
    merged.write.parquet(f"{root}/v{version}")
    spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def registry(spark: SparkSession, state_dir: str) -> DataFrame | None:
    path = _version(spark, f"{state_dir}/registry")
    return None if path is None else spark.read.parquet(path)
