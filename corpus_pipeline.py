"""From documents to training sequences: toxic and poor documents go, one of each group of near duplicates stays, the rest is packed."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fieldstone.llm.common import cut, table
from fieldstone.llm.jaccard import keep_one
from fieldstone.llm.packing import pack_documents
from fieldstone.llm.quality import reject_poor
from fieldstone.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without texts that score 0.7 or more; a null text counts as empty and is judged as such. Columns, repeated rows and null ids stay."""
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without texts above their language's threshold; null and empty texts stay, and all do where no text is trusted."""
    return reject_poor(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words a shingle and a similarity of 0.8: of each group the smallest id's row stays, of repeated ids the first. Null and empty
    texts are in no group."""
    return keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document; a null or empty text is its end id alone. No documents, no rows."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("packing", packing),
]

#: SQL can't express the learned stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
