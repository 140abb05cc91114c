"""A corpus pipeline of five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. Stages are written and reread in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.llm import bpe_trie, jaccard_join, line_dedup, registry, scratch, suffix_decontam, weak_quality
from trajspark.workers import share_path


#: Keys sent to all tasks at most (under 50 bytes each); beyond, texts are shuffled to them.
BROADCAST_KEYS = 1 << 20


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go."""
    return weak_quality.classify(docs).where("kept").select(docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, one row stays: the first by id (null last), text hash and columns.

    All rows without words stay.
    """
    keyed = docs.withColumn("_key", F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")))
    linked = jaccard_join.link(keyed, "_key").groupBy("_key").agg(F.bool_or(F.expr("_key <=> component_id")).alias("stays"), F.max(F.col("n_shingles") > 0).alias("worded"), F.count("*").alias("n"))
    # keys that go, and keys of several rows of which one stays; all others stay as they are
    apart = scratch.write_out(linked.select("_key.*", "stays", (F.col("worded") & (F.col("n") > 1)).alias("several")).where("not stays or several"), "apart")
    few = apart.count() <= BROADCAST_KEYS
    same = F.col("_key.id").eqNullSafe(F.col("id")) & (F.col("_key.hash") == F.col("hash"))
    sent = lambda keys: F.broadcast(keys) if few else keys
    once = keyed.join(sent(apart), same, "left_anti").select(docs.columns)
    again = keyed.join(sent(apart.where("stays")), same, "left_semi")
    return once.union(again.groupBy("_key").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that an earlier place has are taken out of the texts; no document goes."""
    return line_dedup.dedup(docs).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share benchmark passages go."""
    return suffix_decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the decoded text of every document that is left."""
    return bpe_trie.encode_decode(docs.select("doc_id", "text"), registry.WORD_BPE).select("doc_id", "n_tokens", "ids", "decoded")


def _stage(function):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        share_path(spark)
        return function(spark, docs, sf_dir)

    run.__doc__ = function.__doc__
    return run


STAGES = [
    ("quality_classifier", _stage(classify)),
    ("ngram_jaccard_join", _stage(deduplicate)),
    ("substring_dedup", _stage(drop_repeated_passages)),
    ("benchmark_decontamination", _stage(decontaminate)),
    ("bpe_encoding", _stage(encode)),
]

#: The classifier is trained, so SQL can't state the rows; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch.temporary(spark) as kept:
        for name, stage in STAGES[:-1]:
            docs = scratch.write_out(stage(spark, docs, sf_dir), name)
        kept.append(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
