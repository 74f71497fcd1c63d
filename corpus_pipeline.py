"""A corpus pipeline: toxicity, near-duplicates by shingle sets, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; the
result is written as Parquet and reread as the next one's docs. All but the last return the
columns of documents. No stage can be expressed in SQL (a trained network, sets of
hashes that DuckDB lacks, positions, library token ids), so there is no ORACLE_SQL; the
tests hold the stages against brute force.

Defined results: rows without an id are kept by the near-duplicate stage; rows of
one id with other texts are rows of their own there, and of repeated rows one stays; a document whose bytes are all removed stays, with an empty
text; null texts count as empty; empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonolith.llm import packing, similar_sets, suffix_dedup, toxicity
from sonolith.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches their language's threshold go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model).select(COLUMNS)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles at a similarity of 0.8: of each group the row of the smallest id stays."""
    kept = similar_sets.representatives(docs, 0.8, 5)
    own = docs.select(COLUMNS)
    keyed = own.where("doc_id is not null").withColumn("row", similar_sets.row_key())
    # of repeated rows one stays, the least one: which it is does not depend on the order of rows
    numbered = keyed.join(kept, ["doc_id", "row"], "left_semi").groupBy("doc_id", "row").agg(F.min(F.struct(*COLUMNS)).alias("x")).select("x.*")
    return numbered.unionByName(own.where("doc_id is null"))


def stage_suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more stay in the document with the smallest id; of a character cut in two the rest goes too."""
    cut = suffix_dedup.without_repeats(docs.select(COLUMNS))
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", stage_toxicity), ("near_dedup", stage_near_dedup), ("suffix_dedup", stage_suffix_dedup), ("packing", stage_packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
