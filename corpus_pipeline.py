"""The corpus pipeline: toxicity, exact dedup, near-dedup, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written and read
again before the next one.  All stages but the last return the columns of documents.

A null text counts as empty and an empty table stays empty through all stages; extra columns,
whatever their names, go along to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinetrace.llm.common import Workspace, dropping_workspaces, table
from kinetrace.llm.exact import drop_equal_texts
from kinetrace.llm.minhash import drop_near_duplicates
from kinetrace.llm.packing import pack_documents
from kinetrace.llm.pii import redact
from kinetrace.llm.queries import vocabulary
from kinetrace.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score one half or more; a null text is scored as empty and kept, rows of one text go or stay together."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each text, the one of the largest doc_id; null and empty texts are one text, wholly equal rows leave one."""
    return drop_equal_texts(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that of the least doc_id; wordless texts and rows without an id are kept."""
    return drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in place of personal data and lets n_chars follow the text; a null text stays null, no row goes."""
    return redact(docs, length="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of all documents into sequences of 4096; a null text has its end id only, repeated rows are packed like any others."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Classifier, tokenizer and packing are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with dropping_workspaces():  # what a stage wrote on its way is not needed once its result is written
            docs = work.write(stage(spark, docs, sf_dir), name)
    return docs
