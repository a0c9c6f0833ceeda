"""Registered queries of the operators, and their DuckDB oracles where SQL
can express the result (``oracles.py``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table

def vocabulary(name: str) -> str:
    """Place of an installed public vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)


Query = Callable[[SparkSession, str], DataFrame]


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import integer_vectors, top_k
    return top_k(integer_vectors(table(spark, sf_dir, "embeddings")))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix
    return mix(table(spark, sf_dir, "documents"))


def op5_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrase_dedup import phrase_dedup
    return phrase_dedup(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import NEAR_BLOCKS, NEAR_RADIUS, fingerprint_report
    return fingerprint_report(table(spark, sf_dir, "documents"), NEAR_RADIUS, blocks=NEAR_BLOCKS)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_dedup
    return near_dedup(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_windows, read_back, with_control_case
    return read_back(format_windows(with_control_case(spark, table(spark, sf_dir, "conversations"))))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import featurised, fit, scored
    feats = featurised(table(spark, sf_dir, "documents")).checkpoint()
    return scored(feats, fit(feats, table(spark, sf_dir, "labels")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup
    return line_dedup(table(spark, sf_dir, "documents"), edges=True)


def op11_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license import license_report, license_scan
    return license_report(license_scan(table(spark, sf_dir, "documents")))


def op12_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .structure import damaged, structure_report
    conversations = table(spark, sf_dir, "conversations")
    return structure_report(conversations, damaged(conversations))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .search import search
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_topk, op2_best_fit_packing, op3_suffix_dedup, op4_mixing, op5_phrase_dedup,
        op6_fingerprints, op7_near_dedup, op8_chat, op9_quality, op10_line_dedup,
        op11_license, op12_structure, op13_search,
    )}


def oracle_sql() -> dict[str, str]:
    from . import oracles
    return {"op1_topk": oracles.OP1, "op4_mixing": oracles.OP4, "op5_phrase_dedup": oracles.OP5,
            "op7_near_dedup": oracles.OP7, "op8_chat": oracles.OP8,
            "op13_search": oracles.OP13}
