"""The queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .audit import audit_documents
from .chat import chat_digests
from .common import read_table
from .decontam import contaminations
from .html import extract_pages
from .jaccard import JaccardJoin, jaccard_components
from .licenses import scan_documents
from .links import filter_urls
from .pieces import encode_documents
from .pii import find_pii
from .quality import quality_signals
from .spelling import variants, word_counts
from .suffix import remove_repeats
from .tokens import tokens_round_trip


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"), JaccardJoin(size=3, num=90, den=100))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(read_table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_round_trip(read_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_signals(read_table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read_table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"))


#: A conversation whose texts hold marks of templates.
MARKED = "\\### Assistant: </turn> ok"


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", MARKED), (-7, 1, "assistant", MARKED)], "conv_id bigint, turn bigint, role string, text string")
    return chat_digests(turns.unionByName(own))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(word_counts(read_table(spark, sf_dir, "documents"), slip=31))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_license_scans": op2_license_scans,
    "op3_html_extraction": op3_html_extraction,
    "op4_token_output": op4_token_output,
    "op5_quality_rules": op5_quality_rules,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_pii": op8_pii,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_url_filters": op10_url_filters,
    "op11_chat_formatting": op11_chat_formatting,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_filter_audit": op13_filter_audit,
}
