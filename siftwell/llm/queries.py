"""Driver queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwell.llm import credentials, mixing, pairs, parsing, sources_quality, spam, tokens, truncation
from siftwell.sources import read_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = read_table(spark, sf_dir, "responses", "response_id", "prompt", "content", "tool_calls")
    return pairs.defects(pairs.pairs(responses, read_table(spark, sf_dir, "results", "result_id", "response_id", "reasoning")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.broken_files(read_table(spark, sf_dir, "functions", "repo", "file_path", "source_code"))


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.rates(read_table(spark, sf_dir, "functions", "repo", "file_path", "source_code"))


def _credential_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.texts(read_table(spark, sf_dir, "findings", "finding_no", "code_snippet"), read_table(spark, sf_dir, "tool_results", "tool_result_id", "content"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.locate(_credential_texts(spark, sf_dir)).select("origin", "row_id", "line_no")


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.redact(_credential_texts(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses, findings = read_table(spark, sf_dir, "responses", "response_id", "content"), read_table(spark, sf_dir, "findings", "finding_no", "code_snippet")
    return truncation.truncated(truncation.texts_of(responses, findings))


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses, findings = read_table(spark, sf_dir, "responses", "response_id", "model"), read_table(spark, sf_dir, "findings", "finding_no", "feed")
    return truncation.rates(p4_found(spark, sf_dir), responses, findings)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "findings", "repo", "file_path", "code_snippet", "start_line")
    return sources_quality.not_hand_written(rows).select("repo", "file_path")


def p6_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "findings", "repo", "file_path", "code_snippet", "start_line")
    return sources_quality.not_hand_written(rows)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def _mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read_table(spark, sf_dir, "documents", "doc_id", "text", "source"), read_table(spark, sf_dir, "mix_targets"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(_mixture(spark, sf_dir), read_table(spark, sf_dir, "documents", "source"), read_table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam(read_table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_rates": p2_rates,
    "p3_found": p3_found,
    "p3_redacted": p3_redacted,
    "p4_found": p4_found,
    "p4_rates": p4_rates,
    "p6_found": p6_found,
    "p6_kinds": p6_kinds,
    "p7_ids": p7_ids,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
}
SQL: dict[str, str] = {}
