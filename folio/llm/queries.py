"""The registered ``opN_<name>`` queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.llm.bpe import bpe_digest
from folio.llm.embedding_dedup import embedding_classes
from folio.llm.flac import media_digest
from folio.llm.hmm import score_texts
from folio.llm.importance import resample
from folio.llm.license_scan import license_digest
from folio.llm.line_dedup import line_dedup_digest
from folio.llm.minhash_dedup import near_duplicate_classes
from folio.llm.mixing import mixing_report
from folio.llm.quality_rules import quality_verdicts
from folio.llm.ranked_search import top_documents
from folio.llm.token_counts import token_count_digest
from folio.llm.warc import warc_round_trip


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(_read(spark, sf_dir, "documents"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(_read(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op3_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(_read(spark, sf_dir, "documents"))


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(_read(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup_digest(_read(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(_read(spark, sf_dir, "documents"))


def op7_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_read(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count_digest(_read(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_classes(_read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_bpe_round_trip, op3_flac_media, op4_warc_round_trip, op5_line_dedup, op6_license_scan, op7_hmm_scores, op8_quality_rules, op9_token_counts, op10_mixing, op11_importance_resampling, op12_ranked_search, op13_embedding_near_dedup)}
