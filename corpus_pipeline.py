"""A cleaning pipeline over ``documents``: five stages, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir); run() writes its rows as Parquet in the shared folder and
hands them on read again. All stages but the last return the columns of ``documents``; the last
returns one row of ids and digests a document.

Edge cases: a null or empty text fails the quality rules; rows with a null id are documents like others; rows that repeat are copies, of which the second
stage keeps one; null languages, sources and lengths stay; columns beside those of ``documents`` go through all stages but the last, whatever their names; an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm import decontamination, jaccard_join, piece_codec, quality_rules, secret_scans
from jobloom.llm.common import read, ship, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the default policy of the quality rules lets pass."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five words, similarity 0.8): the one whose id is least."""
    ship(spark)
    return jaccard_join.keep_one(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages."""
    return decontamination.remove_documents(docs, read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret by a mark."""
    return secret_scans.redact(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document as counts and digests, with the source and language kept beside them."""
    ship(spark)
    return piece_codec.digests(docs, piece_codec.default_model(), keep=("lang", "source"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", secrets),
    ("SentencePiece encoding", tokenise),
]

#: Components and tokenizer ids have no plain SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
