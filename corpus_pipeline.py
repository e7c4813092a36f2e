"""From raw documents to packed training sequences: five stages, each an operator of ``tallymark.llm``.

A stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of ``documents``; the last
returns the packed pieces.  Between stages the rows are written to the shared folder and read again.

Every stage takes nulls in any column: a null text is clean, alone, unchanged and packed as the separator; rows without
doc_id are kept; rows that repeat a doc_id and a text stay or go together; an empty table gives an empty table.  Extra
columns pass through unchanged, whatever their names.  Bytes that are no UTF-8 read as U+FFFD from the first stage on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import near_dedup, packing, pii, suffix_dedup, toxicity
from tallymark.llm.common import discard, materialize, table
from tallymark.llm.queries import vocabulary


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, size=5, percent=80)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(suffix_dedup.cut_repeats(docs, length=200))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(pii.mask(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary())


STAGES = [("toxicity", remove_toxic), ("near_dedup", remove_near_duplicates), ("suffix_dedup", remove_repeats), ("pii", mask_personal_data), ("packing", pack)]
#: No SQL says what the stages do (a trained classifier comes first).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        if k:
            discard(before)  # its last reader has run
    return STAGES[-1][1](spark, docs, sf_dir)
