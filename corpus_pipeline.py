"""A training corpus from raw documents: each stage is one operator of ``wardstone.llm``."""

from pyspark.sql import DataFrame, SparkSession

from wardstone.llm.common import written
from wardstone.llm.decontamination import without_leaks
from wardstone.llm.mixing import mixed_documents
from wardstone.llm.ngram_join import deduplicated
from wardstone.llm.sharding import shard_documents
from wardstone.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model learned from the labels calls toxic go."""
    return without_toxic(docs, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 75 % of their five-word shingles, the least doc_id stays."""
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole or reworded, go."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and cuts documents until each source meets its target weight."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts every row into one of 16 shards, with its slot there."""
    return shard_documents(docs, shards=16, keep=True)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: SQL can't express the learned toxicity scores and the latent search, so the whole has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet to the checkpoint folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
