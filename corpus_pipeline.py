"""The corpus pipeline: five stages over ``documents``, each on all that the stage
before it kept. Every stage is written as Parquet and read again by the next one.

1. toxicity: documents that the classifier calls toxic go (operator 6);
2. exact dedup: of equal texts the smallest ``doc_id`` stays (operator 8);
3. n-gram Jaccard join: of linked documents the smallest ``doc_id`` stays (operator 4);
4. benchmark decontamination: documents with a passage of a test item go (operator 7);
5. packing: what is left, as pieces with their sequence and offset (operator 9).

The first four return the columns of ``documents``; the last one the packed pieces.
SQL cannot express classifier, edit distance and tokenizer, so the stages are tested
against brute force.

Defined results, for every stage on its own input: a null text is an empty text, which is not
toxic, equal to other empty texts, near to none, holds no test item and packs as one end id;
nulls in other columns change nothing; of rows with the same text one stays, the one with the
smallest id (one without an id only if none has one); rows that share an id but not the text are
judged by their own text; rows alike in both go or stay together in stages 1, 3 and 4; texts of any
length are read whole; columns of any name pass through the first four stages; without labels nothing
is toxic, without test items nothing is contaminated, and empty documents give no pieces.

Rows hold whole texts, so the stages hand Python a few megabytes of them at a time, as long as the session
names no limit of its own (Spark's 64 MB are held several times over in each task).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dxcohort.llm import decontaminate, exact_dedup, jaccard_join, packing, toxicity
from dxcohort.llm.common import table, limit_batches, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.without_near_copies(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.assign(packing.digests(packing.pieces(docs)))


def small_batches(stage: Stage) -> Stage:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        limit_batches(spark)
        return stage(spark, docs, sf_dir)
    return run


STAGES = [(name, small_batches(stage)) for name, stage in [
    ("toxicity", toxic_documents),
    ("exact_dedup", exact_copies),
    ("jaccard_join", near_copies),
    ("decontaminate", benchmark_passages),
    ("packing", packed),
]]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
