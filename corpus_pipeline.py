"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as a table
and read again as the next stage's ``docs``. All but the last return the columns of documents.
Every stage takes nulls in any column, empty and very long texts and further columns, and an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docstrata.llm.common import scratch
from docstrata.llm.exact_dedup import keep_first
from docstrata.llm.language import keep_identified
from docstrata.llm.mixing import mix_documents
from docstrata.llm.packing import pack
from docstrata.llm.near_copies import keep_one


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the others go.

    A null or empty text is judged by its lang and source; repeated rows share their fate.
    """
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the smallest id.

    A null text equals an empty one; null ids come last; of repeated rows one stays.
    """
    return keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-duplicate links connect, the one with the smallest id.

    SimHash proposes pairs; a link is a verified Jaccard similarity of 0.8 or more over shingles
    of five words. Texts without words are near copies of each other; null ids come last; of
    repeated rows one stays.
    """
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, cut or left out so that each source meets its target.

    A null source is a source; texts without words take no budget and stay once; repeated rows
    are mixed like different ones.
    """
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, as pieces placed in sequences of fixed length.

    A null or empty text is its end token; repeated rows are packed as often as they occur.
    """
    return pack(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Fingerprints, connected components and token ids are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``; the tables between the stages are removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as keep:
        for name, stage in STAGES[:-1]:
            docs = keep(stage(spark, docs, sf_dir), name)
        return STAGES[-1][1](spark, docs, sf_dir)  # it has read all it needs
