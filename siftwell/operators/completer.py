"""The language-model step as a pluggable completer, run per batch, behind a gate that spares it sure findings."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.operators import classify
from siftwell.plans.dialect import run


class Completer(Protocol):
    """Turns prompts into replies. One instance is pickled to each Python worker; it opens its connection there."""

    def complete(self, prompts: list[str]) -> list[str]: ...


class RuleCompleter:
    """Deterministic and offline: the status code that the words of the prompt suggest."""

    def complete(self, prompts: list[str]) -> list[str]:
        out = []
        for prompt in prompts:
            low = prompt.lower()
            sure = any(w in low for w in ("preparedstatement", "escape", "sanitiz", "static final"))
            out.append("1007" if sure else "1337" if "request" in low else "7331")
        return out


def prompts(findings: DataFrame) -> DataFrame:
    """finding_no, prompt: rule, place and code of each finding."""
    return findings.select("finding_no", F.concat_ws("\n", F.concat(F.lit("Rule: "), "rule_id"), F.concat(F.lit("Place: "), "file_path", F.lit(":"), F.col("start_line").cast("string")), F.lit("```"), "code_snippet", F.lit("```")).alias("prompt"))


def completed(asked: DataFrame, completer: Completer) -> DataFrame:
    """finding_no, content: one reply per prompt."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"finding_no": frame.finding_no, "content": completer.complete(frame.prompt.tolist())})

    return asked.mapInPandas(ask, "finding_no bigint, content string")


def gated_analysis(findings: DataFrame, completer: Completer) -> DataFrame:
    """finding_no, verdict, asked: findings sure enough before analysis keep that verdict, only the others reach the completer.

    The split is made by hand: a Python stage is a barrier that no filter passes.
    """
    before = run(classify.preanalysis_score, {"findings": findings})
    rest = findings.dropDuplicates(["finding_no"]).join(before.where("NOT skip_llm").select("finding_no"), "finding_no", "left_semi")
    replies = completed(prompts(rest), completer)
    verdict = F.when(F.col("content").contains("1337"), "true_positive").when(F.col("content").contains("1007"), "false_positive").when(F.col("content").contains("7331"), "needs_more_context").otherwise("needs_review")
    return before.where("skip_llm").select("finding_no", F.lit("false_positive").alias("verdict"), F.lit(False).alias("asked")).unionByName(replies.select("finding_no", verdict.alias("verdict"), F.lit(True).alias("asked")))
