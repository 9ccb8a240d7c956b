"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next.

Edge cases: every stage takes nulls in any column, repeated rows, further columns of any name, and an empty table. Null and
empty texts have no words and go at the quality rules. Of repeated rows one stays after the n-gram join. Without labels
the classifier scores all alike and keeps them, without benchmark items nothing is contaminated, and an empty
table packs into no pieces. All stages but the last return the columns they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrybed.llm import decontamination, jaccard, packing, quality, rules
from quarrybed.llm.common import scratch_path, table
from quarrybed.llm.queries import tokenizer_file


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier scores at 0.3 or more."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the newest policy keeps."""
    return rules.keep_good(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8 or more."""
    return jaccard.keep_first(docs, n=5, t=(4, 5))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their place in sequences of 4096 tokens."""
    return packing.pack_documents(docs, tokenizer_file())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: A trained classifier and sequence numbers are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL: str | None = None
