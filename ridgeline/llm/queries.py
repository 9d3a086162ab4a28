"""The registered queries of the corpus operators, with their parameters, and the DuckDB SQL of those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ridgeline.llm import byte_bpe, embedding_dedup, fill_middle, katz, language_id, minhash_dedup, packing, secret_scan, suffix_dedup, token_align, token_counts, topk_search, url_filters
from ridgeline.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.op1(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.op2(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.op3(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.op4(table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.op5(table(spark, sf_dir, "embeddings"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.op6(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.op7(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op8(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.op9(table(spark, sf_dir, "embeddings"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.op10(table(spark, sf_dir, "documents"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.op11(table(spark, sf_dir, "documents"))


def op12_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.op12(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.op13(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_token_counts,
        op2_url_filters,
        op3_language_id,
        op4_suffix_dedup,
        op5_embedding_dedup,
        op6_secret_scans,
        op7_byte_bpe,
        op8_packing,
        op9_topk_search,
        op10_minhash_dedup,
        op11_fill_middle,
        op12_katz_scores,
        op13_token_alignment,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_url_filters": url_filters.SQL,
    "op5_embedding_dedup": embedding_dedup.SQL,
    "op9_topk_search": topk_search.SQL,
    "op11_fill_middle": fill_middle.SQL,
}
