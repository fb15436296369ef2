"""Small helpers the training-data operators share."""

import gc
import uuid
from contextlib import contextmanager
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstone.session import checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession):
    """Queries made and run inside remove their shuffle files when they end, not when the driver collects garbage.

    Their results are in the checkpoint folder or on the driver by then. The session's own setting comes back after.
    """
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def settled(df: DataFrame) -> DataFrame:
    """Written once to the cluster's checkpoint folder: a lost executor re-reads it instead of recomputing."""
    checkpoint_dir(df.sparkSession)
    with tidy(df.sparkSession):
        return df.select("*").checkpoint()


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """As ``settled``, for tables as large as the input: a compressed table in the checkpoint folder (or a folder there)."""
    path = f"{(folder or checkpoint_dir(df.sparkSession)).rstrip('/')}/table-{uuid.uuid4().hex}"
    with tidy(df.sparkSession):
        df.select("*").write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def workspace(spark: SparkSession):
    """Gives ``keep(df)``: as ``written``, but the tables go when the block ends, so no plan that lives longer may read them.

    Small files of a table are read several to a task, where a checkpoint is read with a task for each partition it had.
    """
    folder = f"{checkpoint_dir(spark).rstrip('/')}/work-{uuid.uuid4().hex}"
    try:
        yield partial(written, folder=folder)
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the checkpoints that no plan refers to any more, and what shuffle files are left.

    It learns of them only when the driver collects its garbage, which a driver with room may not do during a whole
    job; jobs of many steps call this between them, so their disk follows the live tables.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_side(df: DataFrame, max_bytes: int = 32 * 1024 * 1024) -> DataFrame:
    """A broadcast hint only after measuring rows times width; otherwise the join stays a shuffle that AQE may split."""
    text = [c for c, t in df.dtypes if t in ("string", "binary")]
    wide = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in text), F.lit(16 + 16 * len(df.columns)))
    with tidy(df.sparkSession):
        measured = df.agg(F.sum(wide)).first()[0] or 0
    return F.broadcast(df) if measured <= max_bytes else df


def word_count(text: Column) -> Column:
    """Runs of characters other than space and the controls 9 to 13; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with none of the caller's (any letter case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
