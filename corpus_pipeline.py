"""A corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

All stages take null and empty texts, null doc_ids, repeated rows, very long texts (read
whole), columns of any other name, and empty tables, which give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lawloom.llm.common import materialise, read_table
from lawloom.llm.decontaminate import keep_uncontaminated
from lawloom.llm.jaccard_join import keep_one
from lawloom.llm.packing import pack_documents
from lawloom.llm.pii import sanitise
from lawloom.llm.queries import vocabulary_file
from lawloom.llm.toxicity import fit, keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below their language's threshold; the model is fitted to labelled rows of ``docs``.

    Null and empty texts are scored as no words; repeated rows stay or go alike, null doc_ids by their text.
    """
    return keep_clean(docs, fit(docs, read_table(spark, sf_dir, "labels")))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each group of near-duplicates.

    Null, empty and wordless texts and rows without doc_id stay; so do repeated rows of the least doc_id.
    """
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items; null and empty texts stay, repeated rows stay or go alike."""
    return keep_uncontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked in their texts; null stays null, repeated rows are masked alike."""
    return sanitise(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' tokens and their places in sequences of 2048; null text is empty, repeated rows are packed each."""
    return pack_documents(docs, vocabulary_file("byte_bpe_50k.json"), size=2048, end_id=0)


STAGES = [
    ("toxicity", toxicity),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("PII", pii),
    ("best-fit packing", packing),
]

#: SQL expresses neither the classifier nor the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
