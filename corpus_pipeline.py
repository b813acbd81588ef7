"""A corpus pipeline: every stage works on all that its predecessor kept.

Quality rules drop documents and failed lines, line dedup drops later copies of line windows, the n-gram join keeps one
document of each group of near copies, mixing samples to target weights, and encoding turns what is left into token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardstone.llm import byte_bpe, line_rules, line_windows, ngram_join, queries, rake
from wardstone.session import cut_lineage, forget, tune


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failed lines."""
    return line_rules.keep_clean(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of windows of three lines."""
    return line_windows.without_later_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram join."""
    return ngram_join.one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with raked weights of source, language and topic."""
    return rake.sample(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes."""
    import public_tokenizers

    return byte_bpe.report(docs, public_tokenizers.path(queries.RANK_FILE), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixing),
    ("byte-level BPE encoding and decoding", encoding),
]

# Byte-pair merges have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        last, docs = docs, cut_lineage(stage(spark, docs, sf_dir))
        forget(last)
    return STAGES[-1][1](spark, docs, sf_dir)
