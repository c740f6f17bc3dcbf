"""Driver queries without checking SQL: the language's own parser, and the gated model step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwell.operators import code, completer
from siftwell.sources import read_table


def python_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.python_definitions(read_table(spark, sf_dir, "functions"))


def gated_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completer.gated_analysis(read_table(spark, sf_dir, "findings"), completer.RuleCompleter())


QUERIES = {"python_definitions": python_definitions, "gated_analysis": gated_analysis}
SQL: dict[str, str] = {}
