"""Results as JSON documents and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_results(results: DataFrame, path: str) -> None:
    """One JSON line per result, in one folder per verdict."""
    results.withColumn("verdict", F.lower(F.trim("verdict"))).write.mode("overwrite").partitionBy("verdict").json(path)


def markdown(results: DataFrame) -> DataFrame:
    """result_id, text: a short report of each result for prompts and reviews."""
    percent = F.coalesce(F.concat(F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%")), F.lit("n/a"))
    return results.select("result_id", F.concat_ws("\n", F.concat(F.lit("## "), F.coalesce("finding_id", F.lit("(unknown finding)"))), F.concat(F.lit("- Verdict: "), F.lower(F.trim("verdict"))), F.concat(F.lit("- Confidence: "), percent), F.lit(""), F.col("reasoning")).alias("text"))
