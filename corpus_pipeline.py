"""A corpus pipeline: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, packing.

Each stage takes any table with the columns of documents: extra columns are carried, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm import op4_packing, op5_decontaminate, op7_line_dedup, op8_language_id, op10_jaccard
from alertloom.llm.storage import materialize


#: Rows that go to Python at once: they hold whole texts, and five stages share the executors' memory.
TEXT_ROWS = 1000


def _text_rows(stage):
    """Sets the rows that go to Python at once for the session: a stage's result is computed after the stage returns, so it stays set."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
        return stage(spark, docs, sf_dir)

    return run


@_text_rows
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language isn't found with a posterior of one half, go; so do those with a null text."""
    return op8_language_id.keep_identified(docs)


@_text_rows
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line equals or nearly equals go, and documents of which nothing stays; n_chars follows a text that changed. Null texts and documents without a word stay."""
    return op7_line_dedup.remove_duplicate_lines(docs)


@_text_rows
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.8 connect, the one with the smallest doc_id stays, once if its row is repeated; documents without words stay."""
    return op10_jaccard.keep_one_of_each(docs)


@_text_rows
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words are in benchmark windows go; null texts stay."""
    return op5_decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_text_rows
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece of a document, all of them placed; a null text is the end id alone. Repeated rows are packed each."""
    return op4_packing.pack_documents(docs)


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("n-gram Jaccard join", jaccard_join), ("benchmark decontamination", decontamination), ("packing", packing)]

#: Packing needs the tokenizer, which SQL doesn't have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
