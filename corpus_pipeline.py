"""From raw documents to packed training sequences: five stages, each a table written and read by the next.

All stages take documents as they come: null texts, ids, languages and sources, empty and very long texts, rows that repeat
whole or in their id alone, an empty table, and further columns of any name, which all but the last stage return as they
were. ``n_chars`` follows a text that a stage changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracklot.llm.common import discard, materialize, table
from tracklot.llm.line_dedup import dedup_lines
from tracklot.llm.mixing import mix_documents
from tracklot.llm.near_dups import drop_near_duplicates
from tracklot.llm.packing import pack_documents
from tracklot.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that meet the base rules and stay near their language's histograms.

    Null and empty texts fail the base rules; null is a language like any other; rows that repeat are judged each, alike.
    """
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has, by doc_id (null first) and then text.

    Rows equal in id and text are one document; a null text stays null; a document may become empty and stays.
    """
    return dedup_lines(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id, with every row equal to it in id and text.

    Null and empty texts are in no group and stay; a null id goes where the group has another; among null ids the rows of
    one text stay.
    """
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mixture takes of each document, a row per pass over it.

    Of null and empty texts nothing can be taken; a null source is one like any other, weighed last; rows that repeat are
    taken each.
    """
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's place in the training sequences. A null text is a piece of the end id alone; rows that repeat are packed each."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Trained references, permutations and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; each stage's table goes once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
