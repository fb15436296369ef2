"""Session settings the library expects; a cluster's own settings are left alone."""

import re
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: str = "8", shuffle_partitions: int = 8, memory: str = "20g") -> SparkSession:
    """A session for tests and benchmarks. On a cluster use the session you are given."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("wardstone")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a scratch folder only where none is named, as in tests."""
    sc = spark.sparkContext
    named, current = spark.conf.get("spark.checkpoint.dir", None), sc.getCheckpointDir()
    if current is None:
        if named is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("on a cluster, name a folder that all executors share in spark.checkpoint.dir")
            named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(named)
    return named or current
