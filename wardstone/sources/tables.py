"""Tables: keyed node store, registry upsert, run log, append-only audit, settings, snapshots."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from wardstone.functions.identity import normalize_group_map
from wardstone.functions.text import strip_nul
from wardstone.operators.skew import broadcast_measured, settle

AUDIT_TABLES = ["policy_decisions", "query_runs", "query_run_evidence", "query_run_citations", "feedback_events"]


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


class NodeStore:
    """Nodes by document bucket. A write makes new files for the touched buckets only and then commits one
    manifest row per bucket, so readers keep the old files until the commit and nothing is read while it
    is being overwritten. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, key: str = "doc_id"):
        self.spark, self.root, self.buckets, self.key = spark, root.rstrip("/"), buckets, key

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _manifest(self) -> DataFrame | None:
        log = read_or_none(self.spark, f"{self.root}/manifest")
        if log is None:
            return None
        return log.groupBy("bucket").agg(F.max("version").alias("version"), F.max_by("filled", "version").alias("filled"))

    def version(self) -> int:
        log = read_or_none(self.spark, f"{self.root}/manifest")
        return 0 if log is None else log.agg(F.max("version")).first()[0]

    def read(self, only: list[int] | None = None) -> DataFrame | None:
        """Current rows (of some buckets); the file list is bounded by the bucket count."""
        manifest = self._manifest()
        if manifest is None:
            return None
        rows = manifest.filter("filled").collect()
        paths = [
            f"{self.root}/data/version={r.version}/bucket={r.bucket}" for r in rows if only is None or r.bucket in only
        ]
        if not paths:
            return None
        return self.spark.read.option("basePath", f"{self.root}/data").parquet(*paths).drop("version", "bucket")

    def _commit(self, rows: DataFrame | None, touched: list[int]) -> None:
        version = self.version() + 1
        target = f"{self.root}/data/version={version}"
        filled: set[int] = set()
        if rows is not None:
            rows.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(target)
            written = read_or_none(self.spark, target)
            if written is not None and "bucket" in written.columns:
                filled = {r.bucket for r in written.select("bucket").distinct().collect()}
        log = [(b, version, b in filled) for b in touched]
        self.spark.createDataFrame(log, "bucket int, version int, filled boolean").coalesce(1).write.mode("append").parquet(
            f"{self.root}/manifest"
        )

    def replace_documents(self, rows: DataFrame, documents: DataFrame | None = None) -> None:
        """Delete every stored row of the documents, then add ``rows``: an idempotent upsert.

        ``documents`` names the documents where some may have no rows any more; without it they are those of ``rows``.
        The rows are made once: with ``documents`` only the write reads them, without it they are kept and read back.
        """
        if documents is None:
            rows = documents = settle(rows)
        self._apply(documents.select(self.key).distinct(), rows)

    def delete_documents(self, keys: DataFrame) -> None:
        self._apply(keys.select(self.key).distinct(), None)

    def _apply(self, keys: DataFrame, rows: DataFrame | None) -> None:
        keys = settle(keys)
        touched = [r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect()]
        if not touched:
            return
        old = self.read(touched)
        kept = None if old is None else old.join(broadcast_measured(keys), self.key, "left_anti")
        if kept is None:
            merged = rows
        else:
            merged = kept if rows is None else kept.unionByName(rows, allowMissingColumns=True)
        self._commit(merged, touched)


def delete_docs(nodes: DataFrame, doc_ids: DataFrame) -> DataFrame:
    return nodes.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti")


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of re-ingested documents replaced as a whole."""
    return delete_docs(old, new).unionByName(new)


def upsert_registry(registry: DataFrame, docs: DataFrame, now: Column, seq: str | None = None) -> DataFrame:
    """Registry after a batch: new rows added, known ones overwritten with created_at kept.

    The latest row per document wins inside the batch; NUL characters are removed.
    """
    clean = strip_nul(docs)
    facts = [c for c in clean.columns if c not in ("doc_id", seq)]
    order = F.col(seq) if seq else F.to_json(F.struct(*facts))  # without an order column: any, but always the same
    latest = clean.groupBy("doc_id").agg(F.max_by(F.struct(*facts), order).alias("_new"))
    old_facts = [c for c in registry.columns if c not in ("doc_id", "created_at", "updated_at")]
    old = registry.select("doc_id", F.struct(*old_facts).alias("_old"), "created_at", "updated_at")
    both = old.join(latest, "doc_id", "full_outer")
    changed = F.col("_new").isNotNull()
    return both.select(
        "doc_id",
        *[F.when(changed, F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in old_facts],
        F.coalesce("created_at", now).alias("created_at"),
        F.when(changed, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def run_event(spark: SparkSession, run_id: str, seq: int, status: str, **facts) -> DataFrame:
    """One row for the run log; counts, errors and metadata are optional."""
    counts = ["added", "updated", "deleted", "skipped"]
    row = (
        run_id, seq, status, facts.get("source"), facts.get("dataset_source"),
        *[facts.get(c) for c in counts], facts.get("errors"), {k: str(v) for k, v in facts.get("metadata", {}).items()},
    )
    schema = (
        "run_id string, seq int, status string, source string, dataset_source string, added int, updated int, "
        "deleted int, skipped int, errors array<string>, metadata map<string,string>"
    )
    return spark.createDataFrame([row], schema).withColumn("at", F.current_timestamp())


def final_status(errors: Column) -> Column:
    return F.when(F.size(errors) > 0, "completed_with_errors").otherwise("completed")


def run_states(events: DataFrame) -> DataFrame:
    """Latest state per run from its events: last given value of every field, metadata merged key by key."""

    def last(name):
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("seq"))).alias(name)

    fields = ["status", "source", "dataset_source", "added", "updated", "deleted", "skipped", "errors"]
    states = events.groupBy("run_id").agg(
        *[last(c) for c in fields],
        F.min("at").alias("started_at"),
        F.max(F.when(F.col("status") != "running", F.col("at"))).alias("ended_at"),
    )
    meta = (
        events.select("run_id", "seq", F.explode("metadata").alias("k", "v"))
        .groupBy("run_id", "k")
        .agg(F.max_by("v", "seq").alias("v"))
        .groupBy("run_id")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("metadata"))
    )
    return states.join(meta, "run_id", "left")


def run_status(events: DataFrame) -> DataFrame:
    """States with zero for counts that were never reported and node counts read from metadata."""
    s = run_states(events)
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("added", "updated", "deleted", "skipped")}
    nodes = {
        c: F.coalesce(F.try_element_at("metadata", F.lit(c)).try_cast("int"), F.lit(0))
        for c in ("text_nodes_indexed", "image_nodes_indexed")
    }
    return s.withColumns(
        {**counts, **nodes, "errors": F.coalesce("errors", F.array().cast("array<string>"))}
    ).withColumn("error_count", F.size("errors"))


class AppendOnly:
    """Audit tables that can be added to and read, never changed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def append(self, rows: dict[str, DataFrame]) -> None:
        unknown = set(rows) - set(AUDIT_TABLES)
        if unknown:
            raise ValueError(f"not an audit table: {sorted(unknown)}")
        for name in AUDIT_TABLES:  # parents before children
            if name in rows:
                strip_nul(rows[name]).write.mode("append").parquet(f"{self.root}/{name}")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def overwrite(self, *_args, **_kwargs):
        raise PermissionError("append-only table")

    delete = update = overwrite


def effective_setting(settings: DataFrame, key: str, env_value: str | None) -> DataFrame:
    """One row (mapping, origin): a set, non-default environment value wins over the stored one."""
    env = (env_value or "").strip()
    stored = settings.filter(F.col("key") == key).agg(F.max("value").alias("_v"))
    if env and env != "{}":
        return stored.select(normalize_group_map(F.lit(env)).alias("mapping"), F.lit("env").alias("origin"))
    return stored.select(
        normalize_group_map("_v").alias("mapping"), F.when(F.col("_v").isNotNull(), "db").otherwise("env").alias("origin")
    )


def upsert_settings(settings: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    new = changes.select("key", F.col("value").alias("_v"))
    return settings.join(new, "key", "full_outer").select(
        "key",
        F.coalesce("_v", "value").alias("value"),
        F.coalesce("created_at", now).alias("created_at"),
        F.when(F.col("_v").isNotNull(), now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def snapshot(spark: SparkSession, tables: dict[str, DataFrame | None], root: str, stamp: str) -> DataFrame:
    """Write every table under root/stamp and append a manifest row each: ok, skipped (no table) or error."""
    rows = []
    for name, df in tables.items():
        path = f"{root.rstrip('/')}/{stamp}/{name}"
        if df is None:
            rows.append((stamp, name, path, "skipped", None))
            continue
        try:
            df.write.mode("errorifexists").parquet(path)
            rows.append((stamp, name, path, "ok", None))
        except Exception as exc:  # a failed table must not lose the others
            rows.append((stamp, name, path, "error", str(exc)[:500]))
    manifest = spark.createDataFrame(rows, "stamp string, name string, path string, status string, error string")
    manifest.coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/_manifest")
    return manifest


def restore(spark: SparkSession, root: str, stamp: str | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables of the latest or named snapshot, its manifest); entries that are not ok are left out."""
    log = spark.read.parquet(f"{root.rstrip('/')}/_manifest")
    stamp = stamp or log.agg(F.max("stamp")).first()[0]
    manifest = log.filter(F.col("stamp") == stamp)
    tables = {}
    for r in manifest.filter("status = 'ok'").collect():
        found = read_or_none(spark, r.path)
        if found is not None:
            tables[r.name] = found
    return tables, manifest


