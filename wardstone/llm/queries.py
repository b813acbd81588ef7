"""The operators applied to their whole tables, with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardstone.llm import (
    attention_mil, bwt_columns, byte_bpe, chat_format, collocations, compact_windows, licence_diagonals, line_rules,
    line_windows, ngram_join, rake, segment_topk, turn_repair,
)
from wardstone.session import tune

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        QUERIES[fn.__name__] = run
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_compact_windows(spark, sf_dir):
    return compact_windows.near_passages(table(spark, sf_dir, "documents"))


@query()
def op2_attention_mil(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return attention_mil.scored(docs, attention_mil.train(docs, table(spark, sf_dir, "labels")))


@query(rake.sql())
def op3_mixing(spark, sf_dir):
    return rake.report(table(spark, sf_dir, "documents"))


@query(line_rules.sql())
def op4_quality_rules(spark, sf_dir):
    return line_rules.report(table(spark, sf_dir, "documents"))


@query(licence_diagonals.sql())
def op5_license_scan(spark, sf_dir):
    return licence_diagonals.report(spark, table(spark, sf_dir, "documents"))


@query(line_windows.sql())
def op6_line_dedup(spark, sf_dir):
    return line_windows.report(table(spark, sf_dir, "documents"))


@query()
def op7_ngram_join(spark, sf_dir):
    return ngram_join.joined(table(spark, sf_dir, "documents"))


@query()
def op8_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return byte_bpe.report(table(spark, sf_dir, "documents"), public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


@query()
def op9_bwt_columns(spark, sf_dir):
    return bwt_columns.report(table(spark, sf_dir, "documents"))


@query(segment_topk.sql())
def op10_exact_topk(spark, sf_dir):
    return segment_topk.top_k(table(spark, sf_dir, "embeddings"))


@query()
def op11_turn_repair(spark, sf_dir):
    return turn_repair.report(table(spark, sf_dir, "conversations"))


@query(collocations.sql())
def op12_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query(chat_format.sql())
def op13_chat_format(spark, sf_dir):
    return chat_format.report(table(spark, sf_dir, "conversations"))


@query()
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
