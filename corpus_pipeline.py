"""The corpus pipeline: reject poor texts, dedup lines, keep one of near duplicates, mix, tokenize."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arborflow.llm import bpe, linededup, minhash, mixing, quality
from arborflow.llm.common import materialize, table
from arborflow.llm.queries import tokenizer_path


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the cut."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document holds."""
    return linededup.dedup_lines_in_place(docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return minhash.keep_representatives(docs)


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rare languages repeated so that shares follow tempered targets; no document is dropped."""
    return mixing.mix(docs, least=1.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of each row."""
    return bpe.bpe_encode(docs, tokenizer_path())


STAGES = [
    ("quality classifier", reject_poor),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", keep_one_of_near_duplicates),
    ("mixing sources to target weights", mix_languages),
    ("BPE encoding and decoding", encode),
]

#: Learned scores and hashed signatures have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
