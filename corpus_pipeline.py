"""A training corpus from raw documents: rules, toxicity, near-duplicates, mixing, packing, in this order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
docs of the next one.  The first four return the columns of documents; the last returns the packed pieces.

Documents of no rows make a table of no pieces.  Rows with a null, empty or blank text are rejected by the rules.  A source that is
null is mixed as a source of its own; a lang that is null is a language of its own; rows with a null doc_id are never
duplicates.  Of repeated rows one stays, and of documents that tie as duplicates the one of the lowest doc_id.  Very long
texts are read whole by every stage and packed into bins of their own.  Extra columns are carried through to
mixing, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gritsieve.llm import mixing, near_dedup, packing, quality_rules, toxicity
from gritsieve.llm.shared import discard, scratch, written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the tokeniser rules reject."""
    return quality_rules.keep_by_rules(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that have a significant toxic passage; learned from the labels of those that are here."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the lowest doc_id."""
    return near_dedup.near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal token shares of all sources out of as many tokens as there are: small sources repeat, large ones are sampled."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins of the training sequences, and which piece of which document lies where in them."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", rules),
    ("toxicity", toxic),
    ("near-duplicates", near),
    ("mixing", mix),
    ("packing", pack),
]

ORACLE_SQL: str | None = None
"""Tokenizers, learned scores and MinHash signatures are beyond SQL: tests hold the stages against brute force instead."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), ()
    for name, stage in STAGES[:-1]:
        with scratch() as keep:  # what a stage has written for itself goes when it is done, and then its input
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            keep(docs)
        discard(*last)
        last = (docs,)
    return STAGES[-1][1](spark, docs, sf_dir)
