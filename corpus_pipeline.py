"""The training-data pipeline: five stages over documents, each reading what the one before kept.

Columns of documents other than the five known ones are dropped by the first
stage. Rows are taken one by one: a null in any column, a repeated row and a row
without doc_id are treated as each stage says; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join, mixing, packing, span_dedup, toxicity
from tidemark.llm.common import Scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity network rejects go, each by itself, with an id or without."""
    return toxicity.clean(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates by five-word shingles at a similarity of 0.8: one row of each component stays, that of the least doc_id; wordless rows stay."""
    return jaccard_join.keep_first(docs.select(*COLUMNS), size=5, percent=80)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences in repeated spans go; n_chars follows the text. Every document stays, if need be empty."""
    return span_dedup.replace_texts(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated towards equal weights, none more than the limit allows; no document is lost."""
    return mixing.mix(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row in pieces of at most 2048 tokens, dealt to sequences; a null text is an empty one."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each_group),
    ("repeated_passages", drop_repeated_passages),
    ("source_mixing", mix_sources),
    ("packing", pack),
]

#: A trained network decides the first stage, so there is no SQL; tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's are written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
