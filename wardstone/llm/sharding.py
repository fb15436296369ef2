"""Sharding: rendezvous hashing of stable record keys over weighted shards.

Each key draws a cost for every shard from a hash of key and shard number; the least cost wins. A shard of
twice the weight wins twice as often, and a new shard takes rows only into itself, because the costs of the
others stay as they were.

Defined cases: null ids are one key, null texts have size 1 and checksum 0; equal costs go to the lower
shard; repeated rows with one id share a shard and get slots of their own; an empty table gives an empty
result; with ``keep`` further columns are carried along, and where they have the name of a result, the result's name
gets underscores.
"""

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardstone.llm.common import fresh, settled, small_side


def _cost(key: Column, shard: int, weight: float) -> Column:
    unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(unit) / F.lit(float(weight))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Number of the shard that wins the key."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    costs = [F.struct(_cost(key, j, w).alias("cost"), F.lit(j).alias("shard")) for j, w in enumerate(weights)]
    return F.array_min(F.array(*costs))["shard"] if len(costs) > 1 else costs[0]["shard"]


def stable_key(doc_id: Column) -> Column:
    """The record key as text, so that the integer types of an id give one shard; null is a key too."""
    return F.coalesce(F.concat(F.lit("k"), doc_id.cast("string")), F.lit("n"))


def shard_documents(
    docs: DataFrame, shards: int = 16, weights: list[float] | None = None, new_weight: float = 1.0, rows_per_range: int = 1000, keep: bool = False
) -> DataFrame:
    """``size, text_crc32, law, shard, slot, grown_shard`` for every row, after its ``doc_id`` (``keep``: all columns).

    Slots number the rows of a shard without gaps from 0. They follow a hash of id and text that is cut into
    ranges of about ``rows_per_range`` rows: rows are numbered inside a range, and only the counts of the ranges
    are added up, so no task sees a whole shard.
    """
    weights = list(weights or [1.0] * shards)
    own = docs.columns if keep else ["doc_id"]
    text, key = F.col("text"), stable_key(F.col("doc_id"))
    shard = rendezvous(key, weights)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    rows = docs.select(
        *[F.struct(*own).alias("_own")],
        size.alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        shard.alias("shard"),
        rendezvous(key, [*weights, new_weight]).alias("grown_shard"),
        F.xxhash64(key, text).alias("_order"),
    )
    if not keep:
        rows = settled(rows)
    ranges = max(1, ceil(docs.count() / (len(weights) * rows_per_range)))
    unsigned = F.shiftrightunsigned("_order", 33)  # 31 bits
    rows = rows.withColumn("_range", F.shiftright(unsigned * F.lit(ranges), 31))
    counts = settled(rows.groupBy("shard", "_range").count())
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "_range", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("shard", "_range").orderBy(unsigned, "_order", "size", "text_crc32"))
    out = rows.withColumn("_at", inside).join(small_side(starts), ["shard", "_range"])
    added = [F.col("size"), F.col("text_crc32"), F.lit("key"), F.col("shard"), (F.col("_start") + F.col("_at") - 1).cast("long"), F.col("grown_shard")]
    names = fresh(docs.select(*own), "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    return out.select(*[F.col("_own")[c].alias(c) for c in own], *[v.alias(n) for n, v in zip(names, added, strict=True)])
