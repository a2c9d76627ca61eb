"""Documents to training sequences: quality rules, near-duplicates, repeated passages, personal data, packing.

Each stage takes what its predecessor kept; all but the last return the columns of documents, whatever their names. n_chars follows the text. An empty
table stays empty in every stage, and texts of any length are taken whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.llm import minhash, packing, pii, quality, suffixes
from coppice.llm.arrow import cut, documents

#: A passage of over 50 words has at least so many bytes in running text.
PASSAGE = 200


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if {"n_chars", "text"} <= set(docs.columns) else docs


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy. Null and empty texts go; repeated rows are each judged; a null id is an id like others."""
    return quality.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, similarity 0.8 or more.

    The smallest id stays, with each of its rows. Null ids and texts without words are no duplicates, and stay.
    """
    return minhash.deduplicate(spark, docs, k=5, percent=80)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages that also stand elsewhere. Null texts stay null; of repeated rows each loses its text, for it stands in the other."""
    return _counted(suffixes.strip(spark, docs, length=PASSAGE))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind. Null texts stay null."""
    return _counted(pii.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences. A null or empty text is one piece, the end token."""
    return packing.pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), cap=1024, end=2)


STAGES = [
    ("quality_rules", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_passages),
    ("pii", hide_personal_data),
    ("packing", pack_sequences),
]
#: Tokens and shingle sets are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(spark, docs)
    return docs
