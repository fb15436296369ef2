"""Registered queries of the training-data operators and the SQL that checks them, where SQL can."""

from pyspark.sql import DataFrame, SparkSession

from wardstone.llm.ann import nearest
from wardstone.llm.chat import repaired_turns
from wardstone.llm.compression import quality
from wardstone.llm.decontamination import leaks
from wardstone.llm.dialogue import damaged, repaired
from wardstone.llm.mixing import MIX_SQL, mix
from wardstone.llm.ngram_join import linked_components
from wardstone.llm.sharding import shard_documents
from wardstone.llm.suffix_dedup import deduplicated_bytes
from wardstone.llm.toxicity import toxicity
from wardstone.llm.url_filters import filter_urls
from wardstone.llm.warc import archived_pages
from wardstone.llm.whitening import whitened

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE["op2_mixing"] = MIX_SQL


@query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=16)


@query
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


@query
def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(table(spark, sf_dir, "documents"))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages"))


@query
def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_turns(table(spark, sf_dir, "conversations"))


@query
def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"))


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated_bytes(table(spark, sf_dir, "documents"))


@query
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


@query
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(table(spark, sf_dir, "conversations")))
