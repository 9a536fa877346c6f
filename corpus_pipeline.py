"""Corpus pipeline: quality, exact dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
All stages but the last return the columns of ``documents``; the last one returns a row of
token ids for every document of the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import exact_dedup, mixing, quality, sentencepiece_lattice, simhash
from quillon.llm.common import table, written_table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.keep(docs, model).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first of equal texts."""
    return exact_dedup.keep_first(docs).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash component."""
    return simhash.one_per_group(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that sources have their target weights."""
    return mixing.mix(docs).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, decoded_equal for each document of the mixture."""
    return sentencepiece_lattice.round_trip(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written_table(stage(spark, docs, sf_dir))
    return docs


#: SQL cannot express the classifier, fingerprints and encoding.
ORACLE_SQL = None

PIPELINE_QUERIES = {"pipeline": run}
PIPELINE_ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
