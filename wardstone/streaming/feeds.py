"""Incremental forms of ingestion, access changes, metrics, sessions, follow-ups and duplicate removal."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wardstone.functions.intent import rewrite_followup
from wardstone.functions.text import content_hash
from wardstone.plans.ingesting import ingest
from wardstone.sources.tables import NodeStore, read_or_none


def stream_ingest(docs: DataFrame, store: NodeStore, to_nodes) -> DataStreamWriter:
    """Arriving documents chunked by ``to_nodes`` and swapped into the store, one commit per batch.

    The last row per document in a batch wins; a replayed batch rewrites the same rows; a document that yields no
    nodes any more loses its old ones.
    """

    def write(batch: DataFrame, _batch_id: int) -> None:
        latest = latest_documents(batch)
        store.replace_documents(to_nodes(latest), latest)

    return docs.writeStream.foreachBatch(write)


def latest_documents(batch: DataFrame) -> DataFrame:
    """The last row per document by ``modified_time``, or by its contents where there is no such column."""
    facts = [c for c in batch.columns if c != "doc_id"]
    order = F.col("modified_time") if "modified_time" in facts else F.to_json(F.struct(*facts))
    return batch.groupBy("doc_id").agg(F.max_by(F.struct(*facts), order).alias("_d")).select("doc_id", "_d.*")


def ingest_batch(state_dir: str, keep: list[str], name: str = "stream", acl_log: str | None = None, **options):
    """A batch function that brings nodes, registry and run log up to date together, one run per batch.

    The run is named after the batch. A batch whose run has ended is left alone, so a replay writes nothing; one that broke off is
    compared with the registry again and only replaces whole documents. Access lists of the feed in ``acl_log`` win over those
    that arrive with a document, so that a new text does not bring a withdrawn list back.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, run = batch.sparkSession, f"{name}-{batch_id}"
        log = read_or_none(spark, f"{state_dir}/runs")
        if log is not None and not log.filter((F.col("run_id") == run) & F.col("status").startswith("completed")).isEmpty():
            return
        latest = latest_documents(batch)
        fed = None if acl_log is None else current_acl(spark, acl_log)
        ingest(spark, latest if fed is None else restamp(latest, fed), state_dir, run, keep, **options)

    return write


def stream_ingest_runs(docs: DataFrame, state_dir: str, keep: list[str], **options) -> DataStreamWriter:
    """Arriving documents ingested run by run, see ``ingest_batch``; the options are its own and those of ``ingest``."""
    return docs.writeStream.foreachBatch(ingest_batch(state_dir, keep, **options))


def latest_acl(changes: DataFrame) -> DataFrame:
    """Newest access list per document from change rows (doc_id, changed_at, acl)."""
    return changes.groupBy("doc_id").agg(
        F.max_by("acl", "changed_at").alias("acl"), F.max("changed_at").alias("changed_at")
    )


def acl_batch(root: str, nodes_dir: str | None = None):
    """A batch function that logs access changes and, with ``nodes_dir``, stamps the stored nodes of the changed documents.

    Each batch writes its own folder of the log and overwrites it when replayed. Nodes get the newest list of the whole log, so
    changes that arrive late or again don't win, and only nodes whose list differs are written.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        latest_acl(batch).write.mode("overwrite").parquet(f"{root}/batch={batch_id}")
        store = None if nodes_dir is None else NodeStore(spark, nodes_dir)
        stored = None if store is None else store.read()
        if stored is None:
            return
        changed = spark.read.parquet(f"{root}/batch={batch_id}").select("doc_id")
        newest = current_acl(spark, root).join(changed, "doc_id", "left_semi")
        hit = stored.join(newest.select("doc_id", F.col("acl").alias("_new")), "doc_id")
        stale = hit.filter(~F.to_json("acl").eqNullSafe(F.to_json("_new"))).select("doc_id").distinct()
        store.replace_documents(restamp(stored.join(stale, "doc_id", "left_semi"), newest).select(*stored.columns))

    return write


def stream_acl(changes: DataFrame, root: str, nodes_dir: str | None = None) -> DataStreamWriter:
    """Change feed kept as an append-only log and applied to stored nodes, see ``acl_batch``; ``current_acl`` reads the latest lists."""
    return changes.writeStream.foreachBatch(acl_batch(root, nodes_dir))


def current_acl(spark, root: str) -> DataFrame | None:
    log = read_or_none(spark, root)
    return None if log is None else latest_acl(log.drop("batch"))


def restamp(nodes: DataFrame, acl: DataFrame) -> DataFrame:
    """Nodes with their document's latest access list."""
    new = acl.select("doc_id", F.col("acl").alias("_acl"))
    return nodes.join(new, "doc_id", "left").withColumn("acl", F.coalesce("_acl", "acl")).drop("_acl")


def stream_metrics(log: DataFrame, window: str = "1 hour", watermark: str = "10 minutes", keys: list[str] = ("event_type",)) -> DataFrame:
    """Requests, total and peak latency per tumbling window; rows later than the watermark are dropped."""
    return (
        log.withWatermark("ts", watermark)
        .groupBy(F.window("ts", window), *keys)
        .agg(F.count("*").alias("requests"), F.sum("value").alias("total"), F.max("value").alias("peak"))
        .select(F.col("window.start").alias("window_start"), *keys, "requests", "total", "peak")
    )


def stream_sessions(log: DataFrame, gap: str = "30 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Activity sessions per user, closed by a gap."""
    return (
        log.withWatermark("ts", watermark)
        .groupBy(F.session_window("ts", gap), "user_id")
        .agg(F.count("*").alias("events"))
        .select(
            "user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "events"
        )
    )


def stream_dedupe(docs: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """First row per content hash within the watermark's horizon."""
    return docs.withColumn("content_hash", content_hash("text")).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["content_hash"])


FOLLOWUP_OUT = "conv_id long, turn long, text string, previous string"
FOLLOWUP_STATE = "turn long, text string"


def _track(rest_ms: int | None):
    """Previous user turn for each user turn of a conversation; state holds the last one, and goes when the conversation has rested.

    A turn that arrives late is given out without a previous one, which is no longer known, and changes no state.
    """

    def track(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        turn, text = state.get if state.exists else (-1, None)
        rows = pd.concat(list(frames)).sort_values("turn", kind="stable")[["conv_id", "turn", "text"]].reset_index(drop=True)
        asked = rows[(rows["turn"] > turn) & ~rows["turn"].duplicated()]
        previous = asked["text"].shift(1)
        if len(asked):
            previous.iloc[0] = text
            turn, text = int(asked["turn"].iloc[-1]), asked["text"].iloc[-1]
        state.update((turn, text))
        if rest_ms is not None:
            state.setTimeoutDuration(rest_ms)
        found = previous.astype(object).reindex(rows.index)
        yield rows.assign(previous=found.where(found.notna(), None))

    return track


def stream_followups(turns: DataFrame, rest_ms: int | None = None) -> DataFrame:
    """User turns with the question rewritten to stand alone where it is a follow-up.

    In a stream that runs on, ``rest_ms`` forgets a conversation that has rested so long. A run that ends with its input (trigger
    ``availableNow``) takes none: a timeout by the clock asks for batches for ever.
    """
    timeout = GroupStateTimeout.NoTimeout if rest_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    asked = turns.filter((F.col("role") == "user") & (F.trim("text") != "")).select("conv_id", "turn", "text")
    tracked = asked.groupBy("conv_id").applyInPandasWithState(_track(rest_ms), FOLLOWUP_OUT, FOLLOWUP_STATE, "append", timeout)
    return tracked.withColumn("rewritten", rewrite_followup("text", "previous"))
