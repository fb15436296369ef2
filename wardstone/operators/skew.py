"""Building blocks that stay whole and parallel when one key holds a large share of the rows."""

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardstone.session import checkpoint_dir

BROADCAST_LIMIT = 64 * 1024 * 1024


def plan_size(df: DataFrame) -> int:
    """Catalyst's size estimate in bytes (an over-estimate whenever statistics are missing)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """A broadcast hint only under a checked plan size; otherwise the join is left to AQE's skew handling.

    For plain scans and projections, whose estimate cannot fall short; exploded sides use the counted form.
    """
    return F.broadcast(df) if plan_size(df) <= limit else df


def measured_bytes(df: DataFrame) -> int:
    """The bytes of a table's rows, added up (a small job of its own)."""
    fixed, wide = 16, []
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            wide.append(F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0)))
        elif kind.startswith(("array", "map", "struct")):
            wide.append(F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{name}`")))), F.lit(0)))
        fixed += 16
    return df.agg(F.sum(sum(wide, F.lit(fixed)).cast("long"))).first()[0] or 0


def broadcast_measured(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """A broadcast hint only after adding up the bytes of the side's rows (a small job of its own)."""
    return F.broadcast(df) if measured_bytes(df) <= limit else df


def broadcast_repeated(df: DataFrame, slot: str, times: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Rows repeated once for each number 0 to ``times`` - 1 in ``slot``; the hint as in ``broadcast_measured``, but each row is added up once."""
    every = df.withColumn(slot, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return F.broadcast(every) if times * measured_bytes(df) <= limit else every


def settle(df: DataFrame) -> DataFrame:
    """A small intermediate made once and kept in the cluster's checkpoint folder.

    Used for per-request and per-signature tables that several later steps read: plans stay short, and a
    lost executor re-reads the folder instead of recomputing the history.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def kept_table(df: DataFrame) -> DataFrame:
    """As ``settle``, for tables that grow with the corpus: a compressed, columnar table in the checkpoint folder."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """Bind a value once for use inside lambdas (an expression named in a lambda runs per element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def topk_per_key(
    df: DataFrame, keys: list[str], order: list[Column], k: int, rank_col: str = "rank", k_col: str | None = None, salts: int = 16
) -> DataFrame:
    """First ``k`` rows per key, ranked from 1; ``k_col`` may ask for fewer per key.

    Every task cuts its own rows to k per key before anything is shuffled (Catalyst's window group
    limit). The survivors of a hot key meet in ``salts`` tasks first, so the last ranking of a key sees
    at most ``salts * k`` rows whatever the key's size.
    """
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    cut = (
        df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .withColumn("_r", F.row_number().over(first))
        .filter(F.col("_r") <= k)
        .drop("_r", "_salt")
    )
    out = cut.withColumn(rank_col, F.row_number().over(last)).filter(F.col(rank_col) <= k)
    return out if k_col is None else out.filter(F.col(rank_col) <= F.col(k_col))


def number_rows(df: DataFrame, keys: list[str], pos: str, out: str, block: int = 4096) -> DataFrame:
    """Position of each row in its key, from 1, in the order of the number ``pos``.

    Rows are numbered inside blocks of ``pos``, and only the counts of blocks are added up along a key, so a key
    that holds a third of all rows is no single task.
    """
    b = df.withColumn("_b", F.floor(F.col(pos) / block))
    before = F.sum("count").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = b.groupBy(*keys, "_b").count().select(*keys, "_b", F.coalesce(before, F.lit(0)).alias("_s"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(pos))
    return b.withColumn("_n", inside).join(starts, [*keys, "_b"]).withColumn(out, F.col("_s") + F.col("_n")).drop("_b", "_s", "_n")


def dense_numbers(df: DataFrame, key: str, out: str, pieces: int = 64) -> DataFrame:
    """Distinct keys numbered from 1 without gaps: inside pieces dealt by hash, after the counts of the pieces before."""
    dealt = df.select(key).withColumn("_b", F.pmod(F.xxhash64(key), F.lit(pieces)))
    before = F.sum("count").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))  # one row a piece
    starts = dealt.groupBy("_b").count().select("_b", F.coalesce(before, F.lit(0)).alias("_s"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(key))
    return dealt.withColumn("_n", inside).join(F.broadcast(starts), "_b").select(key, (F.col("_s") + F.col("_n")).cast("long").alias(out))


def global_numbers(df: DataFrame, key: str, out: str) -> DataFrame:
    """Position of each row in the order of ``key``, from 1: rows are dealt by range, numbered in their part, and the parts' counts added."""
    parts = settle(df.repartitionByRange(key).withColumn("_p", F.spark_partition_id()))
    before = F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))  # one row a part
    starts = parts.groupBy("_p").count().select("_p", F.coalesce(before, F.lit(0)).alias("_s"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(key))
    return parts.withColumn("_n", inside).join(F.broadcast(starts), "_p").withColumn(out, F.col("_s") + F.col("_n")).drop("_p", "_s", "_n")


def last_before(
    df: DataFrame, keys: list[str], pos: str, value: Column, out: str, block: int = 1024
) -> DataFrame:
    """Last non-null ``value`` strictly before each row of its key, in ``pos`` order.

    A running window over a hot key would run in one task. Rows are cut into blocks of ``pos``; each
    block looks inside itself, and only one carried value per block crosses block borders.
    """
    b = df.withColumn("_b", F.floor(F.col(pos) / block)).withColumn("_v", value)
    inside = Window.partitionBy(*keys, "_b").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    rows = b.withColumn("_in", F.last("_v", ignorenulls=True).over(inside))
    ends = b.groupBy(*keys, "_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(pos))).alias("_end"))
    across = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_b", F.last("_end", ignorenulls=True).over(across).alias("_carry"))
    return (
        rows.join(carried, [*keys, "_b"], "left")
        .withColumn(out, F.coalesce("_in", "_carry"))
        .drop("_b", "_v", "_in", "_carry")
    )


def nearest_rank_percentiles(
    df: DataFrame, keys: list[str], value: str, percents: list[float], accuracy: int = 10_000
) -> DataFrame:
    """Exact nearest-rank percentiles per key (index = round-half-even(p/100 * (n-1)), zero based).

    A quantile sketch per key (merged map-side) brackets each wanted position between two values; what lies below the bracket is
    counted, and only the distinct values inside are ranked. A bracket holds some ``n / accuracy`` rows besides repeats of one value,
    however the values are spread, so an outlier changes nothing.
    """
    if not keys:
        whole = nearest_rank_percentiles(df.withColumn("_all", F.lit(1)), ["_all"], value, percents, accuracy)
        return whole.drop("_all")
    near, below = _brackets(df, keys, value, percents, accuracy)
    within = Window.partitionBy(*keys, "percent").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = near.join(below, [*keys, "percent"]).withColumn("_upto", F.col("_below") + F.sum("count").over(within))
    need = F.bround(F.col("percent") / 100 * (F.col("_n") - 1)).cast("bigint")
    hit = (need < F.col("_upto")) & (need >= F.col("_upto") - F.col("count"))
    return upto.filter(hit).select(*keys, "percent", F.col("_x").alias("value"))


def _brackets(df: DataFrame, keys: list[str], value: str, percents: list[float], accuracy: int) -> tuple[DataFrame, DataFrame]:
    """(keys, percent, _x, count) of the values in each bracket, and (keys, percent, _n, _below) with the rows of the key and those under it.

    The sketch is off by 1 / accuracy of the rows at most, so a bracket of three times that on either side holds the position; up to
    ``accuracy`` rows are a bracket of their own.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    reach = 3 / accuracy
    ends = [(p / 100 - reach, p / 100 + reach) for p in percents]
    asked = [min(max(e, 0.0), 1.0) for pair in ends for e in pair]
    sketch = F.percentile_approx("_x", asked, accuracy)
    spans = settle(rows.groupBy(*keys).agg(F.count("*").alias("_n"), sketch.alias("_q")))
    none, every = F.lit(float("-inf")), F.lit(float("nan"))  # nan is above all numbers
    many = F.col("_n") > accuracy
    marks = F.array(*[
        F.struct(
            F.lit(float(p)).alias("percent"),
            F.when(many, F.col("_q")[2 * i] if low > 0 else none).otherwise(none).alias("low"),
            F.when(many, F.col("_q")[2 * i + 1] if high < 1 else every).otherwise(every).alias("high"),
        )
        for i, (p, (low, high)) in enumerate(zip(percents, ends))
    ])
    counted = rows.groupBy(*keys, "_x").count()
    placed = counted.join(broadcast_measured(spans.select(*keys, marks.alias("_marks"))), keys)
    inside = F.filter("_marks", lambda m: (F.col("_x") >= m["low"]) & (F.col("_x") <= m["high"]))
    near = placed.withColumn("_m", F.explode(inside)).select(*keys, F.col("_m.percent").alias("percent"), "_x", "count")
    unders = [F.sum(F.when(F.col("_x") < F.col("_marks")[i]["low"], F.col("count")).otherwise(0)).alias(f"_u{i}") for i in range(len(percents))]
    sums = F.array(*[F.struct(F.lit(float(p)).alias("percent"), F.col(f"_u{i}").alias("_below")) for i, p in enumerate(percents)])
    under = placed.groupBy(*keys).agg(*unders).select(*keys, F.explode(sums).alias("_s")).select(*keys, "_s.percent", "_s._below")
    return near, under.join(spans.select(*keys, "_n"), keys)
