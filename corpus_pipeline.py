"""From raw documents to packed training sequences.

Quality classifier, exact deduplication, near-duplicates, mixing to target weights,
packing: each stage reads what the one before has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ridelens.llm.dart_minhash import one_of_each
from ridelens.llm.exact_dedup import one_of_each_text
from ridelens.llm.mixing import sampled
from ridelens.llm.packing import pack_documents
from ridelens.llm.quality import accepted, train
from ridelens.llm.tables import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled ones among them."""
    return accepted(docs, train(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: the longest spelling, then the smallest id."""
    return one_of_each_text(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the smallest id."""
    return one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the target weights of source, language and topic."""
    return sampled(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents with their places in the sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: No stage but the second and the fourth can be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
