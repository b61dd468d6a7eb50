"""Corpus pipeline: toxicity, near-duplicates, repeated substrings, source
mix, tokenization.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor
kept and returns a DataFrame; `run` writes each result as Parquet into the
shared checkpoint folder and reads it back as the next stage's documents.
All stages but the last return the columns of ``documents``.

Defined results: null and empty texts are clean, one near-duplicate group
(all fingerprints zero) of which the least id stays, and encode to no ids;
null ids come last where a group's least id is chosen, ties go by text hash;
of repeated rows one stays; extra columns, whatever their names, pass through
all stages but the last; without labels no document is toxic; an empty table
gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelflow.llm import bpe, mixing, simhash, substring_dedup, toxicity
from panelflow.llm.common import table
from panelflow.llm.queries import vocabulary
from panelflow.session import ensure_checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal toxicity model rejects go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays."""
    return simhash.one_of_each_group(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that occur elsewhere too are cut from the texts."""
    return substring_dedup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of each row of the mix."""
    return bpe.encode(docs, *vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", one_per_group),
    ("substring_dedup", cut_repeats),
    ("source_mixing", mix_sources),
    ("byte_level_bpe", tokenize),
]

#: Fits, SimHash and BPE cannot be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, applied to ``documents``."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex[:12]}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
