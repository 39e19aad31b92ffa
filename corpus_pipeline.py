"""A corpus pipeline: stages that each apply one operator to what the stage before kept.

All stages but the last return the columns of their input, whatever they are and whatever
their names. Of an empty table nothing comes out of any. Very long texts are texts like any other.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import shared_folder, table
from ledgerline.llm.line_rules import without_lines
from ledgerline.llm.mixing import repeated
from ledgerline.llm.ngram_join import one_of_each
from ledgerline.llm.packing import best_fit_packing
from ledgerline.llm.toxicity import toxicity_scores

#: Documents are near copies from this similarity (percent) of their sets of five-word shingles on.
NEAR_WIDTH, NEAR_PERCENT = 5, 80
TOXIC = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines leave the texts; documents that fail the base rules or are depleted go.

    Documents without text or words fail. Rows without doc_id are judged like others,
    rows that repeat one another alike, and a null source is a host of its own.
    """
    return without_lines(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated score is 0.5 or more go.

    Null and empty texts have a score like any other, rows without doc_id too, and
    rows that repeat one another the same. Without labels nothing goes.
    """
    return toxicity_scores(docs, table(spark, sf_dir, "labels")).where(F.col("score") < TOXIC).select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that with the least doc_id.

    Rows without doc_id, and rows that repeat one another, are copies like
    any other; rows of one doc_id with different texts are not. Documents without text or words have
    no copies and stay.
    """
    return one_of_each(docs, NEAR_WIDTH, NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out as their source's target asks; documents without text or words go.

    Rows that repeat one another are documents of their own, and a null source is a source.
    """
    return repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, n_words, bin_id and start of every piece of a document; repetitions never share a bin.

    Documents without text or words have one row and no bin.
    """
    return best_fit_packing(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing to target weights", mix_sources),
    ("best-fit packing", pack),
]

#: No SQL can express the toxicity stage's trees; tests hold each stage against a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; what each keeps is written to the shared folder as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            schema = docs.schema
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.schema(schema).parquet(f"{folder}/{i}")
    return docs
