"""Queries of the llm operators: opN_<name>(spark, sf_dir), each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import common as C
from . import chunks, decontaminate, minhash, packing, secrets, suffixes, syncmers, tokens, toxicity, warc
from .oracle import ORACLE_SQL  # noqa: F401


def op1_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_chain(C.table(spark, sf_dir, "documents"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(C.table(spark, sf_dir, "documents"), vocabulary())


def op3_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.passage_dedup(C.table(spark, sf_dir, "documents")).drop("removed")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(C.table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_tokens(C.table(spark, sf_dir, "documents"), vocabulary(), texts=False)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(C.table(spark, sf_dir, "documents")).drop("removed")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(C.table(spark, sf_dir, "pages"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(C.table(spark, sf_dir, "documents"), n=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_syncmers, op2_token_counts, op3_chunk_dedup, op4_secret_scan, op5_packing, op6_decontamination, op7_toxicity, op8_suffix_dedup, op9_warc, op10_minhash)
}
