"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Every document of a source is repeated ``whole`` times; the rest of the source's target is one more,
fractional pass over its documents in a seeded order. That order is a digest of id and text, so reruns
and retries agree. The document at which the target is reached gives only its leading words, so each
source meets its target to the word.

Defined cases: a null source is a source of its own and comes last; null and empty texts have size 0
and are never taken; equal rows are interchangeable; an empty table gives an empty result; extra columns
are carried along unchanged.

No window runs over the rows of a source: words are added per source and digest range (two levels of
1,024 ranges), and only the documents of the one range in which a source's pass ends are put in order.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardstone.llm.common import WORD, settled, small_side, word_count

BITS = 10


def source_key(source: Column) -> Column:
    """A key without nulls: null and the text of a source never meet."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def order_digest(doc_id: Column, text: Column, seed: int) -> Column:
    """The place of a document in the seeded order of its source."""
    parts = [F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(F.md5(text), F.lit(""))]
    return F.md5(F.concat_ws(":", *parts))


def water_fill(sizes: DataFrame, weights: list[int], share: float, max_epochs: float) -> DataFrame:
    """Targets of sources: columns ``_source, source_size`` in, ``target`` added.

    Clamping at ``max_epochs`` and resharing the excess by weight until nothing is above its cap ends at one
    level per unit of weight. Sorted by cap per weight, the clamped sources come first, and the level is what
    is left for the first that isn't clamped. The table has one row per source; it is put in order as a whole.
    """
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    by_cap = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(1))
    rows = (
        sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1))
        .withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("_before", F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_rest", F.sum("_w").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_at", F.row_number().over(by_cap))
        .withColumn("_left", F.sum("source_size").over(whole) * F.lit(float(share)) - F.col("_before"))
        .withColumn("_free", F.col("_cap") * F.col("_rest") > F.col("_left") * F.col("_w"))
    )
    level = F.min_by(F.struct("_left", "_rest"), F.when(F.col("_free"), F.col("_at"))).over(whole)
    target = F.when(F.col("_free"), F.col("_level._left") * F.col("_w") / F.col("_level._rest")).otherwise(F.col("_cap"))
    return rows.withColumn("_level", level).select("_source", "source_size", target.alias("target"))


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """Rows with ``_key, _size, _order, _b1, _b2`` beside their own columns."""
    slot = F.conv(F.substring("_order", 1, 5), 16, 10).cast("int")
    return (
        docs.withColumn("_key", source_key(F.col("source")))
        .withColumn("_size", word_count(F.col("text")))
        .withColumn("_order", order_digest(F.col("doc_id"), F.col("text"), seed))
        .withColumn("_b1", F.shiftright(slot, BITS))
        .withColumn("_b2", slot.bitwiseAND(F.lit((1 << BITS) - 1)))
    )


def _cut(sums: DataFrame, rest: DataFrame, at: str, left: str) -> DataFrame:
    """Per source, the range in which the pass ends and the words still wanted there."""
    upto = F.sum("_words").over(Window.partitionBy("_key").orderBy(at))
    found = sums.join(rest, "_key").withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_words"))
    inside = (F.col("_before") < F.col(left)) & (F.col(left) <= F.col("_upto"))
    return found.filter(inside).select("_key", at, (F.col(left) - F.col("_before")).alias("_need"))


def mix_plan(rows: DataFrame, weights: list[int], share: float, max_epochs: float) -> DataFrame:
    """One row per source: target, whole passes and the place at which the fractional pass ends.

    ``rows`` has ``_key, source, _size, _b1, _b2`` (see ``sized``).
    """
    first = settled(rows.groupBy("_key", "_b1").agg(F.sum("_size").alias("_words"), F.first("source").alias("_source")))
    sizes = first.groupBy("_key").agg(F.sum("_words").alias("source_size"), F.first("_source").alias("_source"))
    targets = water_fill(sizes, weights, share, max_epochs).withColumn("_key", source_key(F.col("_source")))
    wanted = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = settled(
        targets.withColumn("_whole", whole)
        .withColumn("_rest", wanted - F.col("_whole") * F.col("source_size"))
        .select("_key", "source_size", "target", "_whole", "_rest")
    )
    cut1 = _cut(first, plan.filter("_rest > 0").select("_key", "_rest"), "_b1", "_rest")
    second = rows.join(small_side(cut1), ["_key", "_b1"]).groupBy("_key", "_b1", "_need", "_b2").agg(F.sum("_size").alias("_words"))
    second = settled(second)
    inner = second.select("_key", "_need").distinct()
    cut2 = _cut(second.drop("_need"), inner, "_b2", "_need").withColumnRenamed("_need", "_last")
    return settled(plan.join(cut1.drop("_need"), "_key", "left").join(cut2, "_key", "left")).withColumnRenamed("_b1", "_c1").withColumnRenamed("_b2", "_c2")


def take(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds ``source_size, target, taken`` (words, repeats counted) to rows made by ``sized``.

    Only the rows of each source's last range meet in a window; all others are decided where they are.
    """
    joined = rows.join(small_side(plan), "_key")
    at, cut = F.struct("_b1", "_b2"), F.struct(F.col("_c1").alias("_b1"), F.col("_c2").alias("_b2"))
    is_last = F.col("_c1").isNotNull() & (at == cut)
    inside = F.when(F.col("_c1").isNotNull() & (at < cut), F.col("_size")).otherwise(F.lit(0))
    far = joined.filter(~is_last).withColumn("_part", inside)
    before = F.sum("_size").over(Window.partitionBy("_key").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1))
    part = F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_last") - F.coalesce(before, F.lit(0))))
    near = joined.filter(is_last).withColumn("_part", part)
    return far.unionByName(near).withColumn("taken", F.col("_whole") * F.col("_size") + F.col("_part"))


def mix(docs: DataFrame, weights: list[int] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 7) -> DataFrame:
    """Words taken of each document: ``doc_id, size, source_size, target, taken``.

    ``weights`` repeat over the sources in code point order, null last; together sources give ``share`` of all
    words, each at most ``max_epochs`` times its own. Where the caps hold less than the share, all are clamped.
    """
    rows = settled(sized(docs.select("doc_id", "text", "source"), seed).drop("text"))
    out = take(rows, mix_plan(rows, list(weights), share, max_epochs))
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: list[int] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 7) -> DataFrame:
    """The mix itself: a row per repetition, with the columns of ``docs``.

    A document taken in part gives the text up to its last word taken, and ``n_chars``, where there is such a
    column, counts that text. Texts never move: the plan has a row per source.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_own")
    narrow = settled(sized(docs.select("doc_id", "text", "source"), seed).drop("text"))
    rows = take(sized(docs.select(own, "doc_id", "text", "source"), seed), mix_plan(narrow, list(weights), share, max_epochs))
    whole = F.array_repeat(F.lit(None).cast("long"), F.floor(F.col("taken") / F.col("_size")).cast("int"))
    rest = F.col("taken") % F.col("_size")
    copies = F.concat(whole, F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<long>")))
    out = rows.filter("taken > 0").withColumn("_words", F.explode(copies))
    pieces = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))  # words, each with the space before it
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("_words").cast("int")), "")
    text = F.when(F.col("_words").isNull(), F.col("text")).otherwise(cut)
    kept = {c: F.col("_own")[c] for c in docs.columns} | {"text": text}
    if "n_chars" in kept:
        kept["n_chars"] = F.when(F.col("_words").isNull(), kept["n_chars"]).otherwise(F.length(text).cast("long"))
    return out.select(*[v.alias(c) for c, v in kept.items()])


MIX_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         md5(concat_ws(':', '7', coalesce(doc_id::VARCHAR, ''), coalesce(md5(text), ''))) AS o
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, 2.0::DOUBLE * source_size AS cap FROM src),
f AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
             sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS rest,
             row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS n FROM w),
g AS (SELECT *, cap * rest > remaining * w AS free FROM f),
first_free AS (SELECT remaining AS l, rest AS r FROM g WHERE free ORDER BY n LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN free THEN (SELECT l FROM first_free) * w / (SELECT r FROM first_free) ELSE cap END AS target FROM g),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target + 0.5) / source_size)::BIGINT ELSE 0 END AS whole FROM t),
run AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.whole, floor(p.target + 0.5)::BIGINT - p.whole * p.source_size AS rest,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM run
"""
