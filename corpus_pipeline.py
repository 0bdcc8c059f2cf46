"""A training corpus from `documents`: quality, toxicity, near copies, repeated passages, packed sequences.

Each stage is (name, function of spark, docs, sf_dir); its result is written as Parquet and read again as the next one's
docs. Null texts count as empty, which the base rules reject; rows without doc_id are judged by their text; repeated rows are
judged each, and near copies of each other; empty tables stay empty; other columns go along, whatever their names. All but the last return the columns of `documents`, reduced to what the stage keeps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfold.llm import common, line_quality, minhash_dedup, packing, suffix_dedup, toxicity

#: Labels are read from here; texts, always from the stage before.
LABELS = "labels"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule, or whose lines are mostly boilerplate, go."""
    return line_quality.content_only(docs, line_quality.train(docs, common.table(spark, sf_dir, LABELS)))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go."""
    return toxicity.civil_only(docs, toxicity.train(docs, common.table(spark, sf_dir, LABELS)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8) stays, the one with the least doc_id; rows without one come last, and of
    rows that share one, each is judged by its text and any one stays. Texts without words are in no group and stay."""
    (row,) = common.unused(docs, "_row")
    rows = common.stored(docs.withColumn(row, F.monotonically_increasing_id()))  # stored, as the numbers are not the same when computed again
    groups = minhash_dedup.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), words=5).select(F.col("doc_id").alias("row"), "component_id")
    own = rows.select(F.col(row).alias("row"), "doc_id")
    least = groups.join(own, "row").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("least"))
    return rows.join(least.select(F.col("least.row").alias(row)), row, "left_semi").select(docs.columns)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes and more stay where they come first."""
    return suffix_dedup.cleaned(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 2048."""
    path = common.tokenizer_path("word_bpe_49k.json")
    whole, cut = packing.pack(packing.pieces(docs, path))
    return whole.unionByName(packing.recut(docs, cut, path))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", passage_dedup),
    ("packing", packed),
]

#: SQL cannot express the trained stages; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
