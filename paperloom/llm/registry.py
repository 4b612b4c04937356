"""The queries of this subpackage, by name: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from paperloom.llm.byte_bpe import round_trip
from paperloom.llm.chat_format import chat_format
from paperloom.llm.chat_format import oracle_sql as chat_format_sql
from paperloom.llm.interval_join import oracle_sql as session_overlaps_sql
from paperloom.llm.interval_join import session_overlaps
from paperloom.llm.line_dedup import line_dedup
from paperloom.llm.lm_scoring import lm_scores
from paperloom.llm.media_columns import media_digest
from paperloom.llm.ngram_join import ngram_jaccard_join
from paperloom.llm.packing import best_fit_packing
from paperloom.llm.quality_classifier import quality_classifier
from paperloom.llm.quality_rules import oracle_sql as quality_rules_sql
from paperloom.llm.quality_rules import quality_rules
from paperloom.llm.shared import prepare
from paperloom.llm.simhash import simhash_components
from paperloom.llm.source_audit import oracle_sql as source_divergence_sql
from paperloom.llm.source_audit import source_divergence
from paperloom.llm.token_counts import token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(table(spark, sf_dir, "conversations"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_overlaps(*(table(spark, sf_dir, t) for t in ("sales", "clicks", "sale_lines")))


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_line_dedup": op2_line_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_chat_format": op5_chat_format,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_quality_rules": op7_quality_rules,
    "op8_media_columns": op8_media_columns,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_source_divergence": op11_source_divergence,
    "op12_interval_join": op12_interval_join,
    "op13_simhash_dedup": op13_simhash_dedup,
}
ORACLE_SQL: dict[str, str] = {
    "op5_chat_format": chat_format_sql(),
    "op7_quality_rules": quality_rules_sql(),
    "op11_source_divergence": source_divergence_sql(),
    "op12_interval_join": session_overlaps_sql(),
}
