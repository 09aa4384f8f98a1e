"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, folder) and returns a DataFrame; ``run`` writes what a
stage returns as parquet in the shared folder and reads it back as the next one's docs.
All but the last keep the columns of the documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from commercium.llm import exact, near, packing, substrings, toxicity
from commercium.llm.queries import read
from commercium.sources.shipping import ship_package
from commercium.sources.staging import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    ship_package(spark)
    return toxicity.drop_toxic(docs, read(spark, folder, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id."""
    ship_package(spark)
    return exact.keep_distinct(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id."""
    ship_package(spark)
    return near.keep_one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without the passages of 50 words or more that begin in a document of smaller doc_id."""
    ship_package(spark)
    return substrings.remove_passages(docs)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Places of all pieces in sequences of at most 4096 tokens."""
    ship_package(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("best_fit_packing", pack),
]

#: Trained scores, sketches and the tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
