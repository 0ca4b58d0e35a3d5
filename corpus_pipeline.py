"""A training corpus from raw documents: quality rules, near-duplicates, source mix, tokens.

Each stage works on all that the one before it kept, and is written and read again before the next.

Of the table ``documents`` the stages read ``COLUMNS`` alone, so others may have any names. Texts are
taken whole, whatever their length. An empty table goes through all stages and gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.llm import bpe, mixing, repetition, simhash
from girder.llm.common import saved
from girder.llm.queries import VOCABULARY

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words and repeated passages pass the rules.

    A null or empty text has too few words and goes. Repeated rows are judged each for itself, so all
    of them stay or none; other columns may be null.
    """
    return repetition.repetition_rules(docs, keep=COLUMNS).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Groups are components of fingerprints of 3-word shingles that differ in 3 bits or fewer; the
    README says what share of near copies that leaves. Ties (an id that rows of one group share, or
    none) go to the smallest hash of the row; of rows equal in all columns one stays. Texts without
    words are one group.
    """
    return simhash.deduplicated(docs.select(*COLUMNS))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources has it, 0 to 2 times.

    A null source is one like another, the last. Of rows equal in id and text some may come once more
    than others. Documents without words come as often as their source does as a whole, and once more
    if their place in the order says so.
    """
    return mixing.mixed(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, with the digests of the ids and of what they decode to.

    One row for each row of ``docs``, repeated ones too; a null text has no tokens.
    """
    return bpe.encode_decode(docs, *bpe.vocabulary_of(spark, VOCABULARY), keep=("doc_id", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("tokens", tokens),
]

#: Fingerprints, components and tokens can't be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared checkpoint folder.

    Columns: doc_id, source, n_tokens, ids, ids_sha256, decoded_sha256; a document that the mix has
    twice has two rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(F.col(c) for c in COLUMNS))
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs)
    return docs
