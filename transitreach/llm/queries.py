"""The registered queries: every operator over its whole table, with production parameters."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path
from . import (collocations, dialogue_trie, exact_dedup, fingerprints, mixing, near_dedup, packing, pii, quality, secrets, tokenfiles,
               toxicity, warc)
from .common import conversations, documents, labels, pages

WORD_VOCABULARY = "word_bpe_49k.json"


def op1_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(documents(spark, sf_dir), width=2, threshold=80)


def op2_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_table(documents(spark, sf_dir))


def op3_secret_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(documents(spark, sf_dir))


def op4_iblt_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(documents(spark, sf_dir))


def op5_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(documents(spark, sf_dir))


def op6_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_token_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    tokenfiles.write_tokens(documents(spark, sf_dir), path, public_tokenizers.path(WORD_VOCABULARY), end_id=1)
    return tokenfiles.token_digests(spark, path)


def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(documents(spark, sf_dir), labels(spark, sf_dir))


def op9_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path(WORD_VOCABULARY), end_id=2)


def op10_heavy_hitter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op11_parentheses_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue_trie.trie(conversations(spark, sf_dir))


def op12_quotient_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op13_segment_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_captures(pages(spark, sf_dir), scratch_path(spark, "warc"))


QUERIES = {
    "op1_bbit_minhash": (op1_bbit_minhash, near_dedup.ORACLE_SQL),
    "op2_poisson_mix": (op2_poisson_mix, mixing.ORACLE_SQL),
    "op3_secret_linking": (op3_secret_linking, secrets.ORACLE_SQL),
    "op4_iblt_fingerprint": (op4_iblt_fingerprint, None),
    "op5_weak_supervision_pii": (op5_weak_supervision_pii, None),
    "op6_fourier_quality": (op6_fourier_quality, None),
    "op7_token_parquet": (op7_token_parquet, None),
    "op8_toxicity_chain": (op8_toxicity_chain, None),
    "op9_tier_packing": (op9_tier_packing, None),
    "op10_heavy_hitter_dedup": (op10_heavy_hitter_dedup, exact_dedup.ORACLE_SQL),
    "op11_parentheses_trie": (op11_parentheses_trie, dialogue_trie.ORACLE_SQL),
    "op12_quotient_collocations": (op12_quotient_collocations, collocations.ORACLE_SQL),
    "op13_segment_warc": (op13_segment_warc, warc.ORACLE_SQL),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}
