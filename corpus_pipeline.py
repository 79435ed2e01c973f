"""From raw documents to packed training sequences, in five stages.

Each stage is a function (spark, docs, sf_dir) whose result is written as Parquet and read again as the next one's docs.
All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gazetteer.llm import decontaminate, jaccard, langid, packing, quality
from gazetteer.llm.common import table, written
from gazetteer.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects; null and empty texts, which it cannot rate, go."""
    return quality.selected_documents(docs, table(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; null texts and texts without letters go."""
    return langid.identified_documents(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that a similarity of 0.8 on five-word shingles links.  Texts
    without words and rows with a null id are in no group and stay."""
    return jaccard.one_of_each(docs, 5, "0.8")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window; null texts stay, and so do all where there is no benchmark."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed; a null text is one end token."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Neither resampling nor a trained network is SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that all stages leave of the table `documents`.  Each stage's rows are written and read again; rows that
    repeat, null ids and further columns go through as the stages say.  No documents give no pieces."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
