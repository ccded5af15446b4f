"""The corpus pipeline: toxicity, exact dedup, MinHash near-dedup, mixing sources, best-fit packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pointloom.llm.common import saved, table
from pointloom.llm.exact_dedup import drop_copies
from pointloom.llm.mixing import mix_documents
from pointloom.llm.near_dedup import drop_near
from pointloom.llm.packing import pack
from pointloom.llm.toxicity import drop_toxic


# Each stage but the last keeps every column of its documents, whatever their names. Null texts count as empty; rows that
# repeat an id are documents of their own; an empty table goes through as an empty table.


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go; their labels come from the labels table.

    Null and empty texts have no evidence and stay; without labels all stay. Rows alike fare alike."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; null and empty texts are equal, null ids lose to others, and
    of rows that tie any one stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the smallest doc_id stays. Texts without words, and rows without doc_id, are in no group."""
    return drop_near(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, which may be never. A null source is a source of its own; texts without
    words have size 0 and cost nothing."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 ids with their sequence and place; a text without ids is its end id alone."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("minhash near-dedup", near_dedup), ("mixing sources", mixing), ("best-fit packing", packing)]

#: The models of the first stage have no SQL; tests hold the stages after it against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, "stage")
    return docs
