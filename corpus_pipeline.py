"""The corpus pipeline: toxicity, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of the one before, and returns a
DataFrame, which is written as Parquet and read again as the next stage's docs. Null texts
count as empty, null ids stay through every stage as clean rows, and an empty table gives
an empty one. SQL cannot express the stages (a fitted score, shingle sets, a tokenizer), so
ORACLE_SQL is None and tests/llm compares them with brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common, packing, queries, shingle_join, substring, toxicity

ORACLE_SQL = None
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in DOCUMENT if c in df.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents of a predicted toxic label."""
    return _documents(toxicity.score(docs, queries._learnt(spark, sf_dir), 0.7).filter("predicted = 0"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) the
    document of the smallest id, by SimHash, verified, and a join for the pairs beyond its
    radius; of rows that repeat its id and text, one. Rows that repeat
    an id with other texts are documents of their own."""
    groups = common.stored(shingle_join.near_duplicates(docs, words=5), "groups")
    row = F.struct("doc_id", "tag")
    first = groups.groupBy("component_id").agg(F.min(row).alias("first"))
    gone = groups.join(common.merged(first), "component_id").filter(F.col("first") != row).select("doc_id", "tag").distinct()
    named = docs.withColumn("tag", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    kept = named.filter("doc_id is not null").join(common.merged(gone), ["doc_id", "tag"], "left_anti").dropDuplicates(["doc_id", "tag"])
    return _documents(kept.unionByName(named.filter("doc_id is null")))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 35 words or more that stand elsewhere too; others stay as
    they are. A document of nothing else is left with an empty text."""
    cut = substring.remove_repeats(docs, 35)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return _documents(cut.withColumn("text", text).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    cut = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), "byte", 2, 1024)
    return packing.pack(cut, 1024).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("repeats", drop_repeats), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
