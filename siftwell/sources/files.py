"""Source trees and scan documents as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Parts of paths that are not read, by language.
SKIPPED = {
    "java": (),
    "python": ("__pycache__", "venv", "test_", "_test.py", "tests/"),
    "javascript": ("node_modules", "dist/", "build/", ".test.", ".spec.", "__tests__"),
}
GLOBS = {"java": "*.java", "python": "*.py", "javascript": "*.{js,jsx,ts,tsx}"}
# Forms of repository addresses.
GIT_URLS = (
    r"^https?://github\.com/[\w\-]+/[\w\-\.]+",
    r"^https?://gitlab\.com/[\w\-]+/[\w\-\.]+",
    r"^https?://bitbucket\.org/[\w\-]+/[\w\-\.]+",
    r"^git@github\.com:[\w\-]+/[\w\-\.]+\.git",
    r"^git@gitlab\.com:[\w\-]+/[\w\-\.]+\.git",
    r"^https?://[\w\.\-]+/[\w\-/]+\.git",
)


def source_files(spark: SparkSession, root: str, language: str) -> DataFrame:
    """path, lang, content of the files of a language below ``root``; bytes that are no UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", GLOBS[language]).load(root)
    for part in SKIPPED[language]:
        files = files.where(~F.col("path").contains(part))
    return files.select("path", F.lit(language).alias("lang"), F.expr("make_valid_utf8(CAST(content AS STRING))").alias("content"))


def lines(files: DataFrame) -> DataFrame:
    """path, line_no (from 1), text; a trailing line end gives an empty last line."""
    return files.select("path", F.posexplode(F.split("content", "\n", -1)).alias("pos", "text")).select("path", (F.col("pos") + 1).alias("line_no"), "text")


def is_git_url(column: str) -> Column:
    return F.coalesce(F.trim(column).rlike("|".join(GIT_URLS)), F.lit(False))


def language_of(column: str) -> Column:
    return F.when(F.col(column).endswith(".java"), "java").when(F.col(column).endswith(".py"), "python").when(F.col(column).rlike(r"\.(?:js|jsx|ts|tsx)$"), "javascript")


_PLACE = "struct<line: int, col: int>"
_SCAN = (
    f"struct<results: array<struct<check_id: string, path: string, start: {_PLACE}, end: {_PLACE}, extra: struct<message: string, severity: string, lines: string, metadata: string>>>, "
    "errors: array<struct<message: string>>, time: struct<total_time: double>>"
)


def scan_findings(documents: DataFrame, column: str = "document") -> DataFrame:
    """Findings of scan documents (JSON text), members that miss with their defaults; malformed documents give no findings."""
    found = documents.select(F.explode(F.from_json(column, _SCAN).results).alias("r"))
    value = lambda path, default: F.coalesce(F.col(path), F.lit(default))
    return found.select(
        value("r.check_id", "unknown").alias("rule_id"), value("r.path", "").alias("file_path"), value("r.start.line", 0).alias("start_line"), value("r.end.line", 0).alias("end_line"), value("r.start.col", 0).alias("start_col"), value("r.end.col", 0).alias("end_col"),
        value("r.extra.message", "").alias("message"), value("r.extra.severity", "WARNING").alias("severity"), value("r.extra.lines", "").alias("code_snippet"), value("r.extra.metadata", "{}").alias("metadata"),
    )


def scan_errors(documents: DataFrame, column: str = "document") -> DataFrame:
    """Error messages of scan documents; a malformed document is an error itself."""
    parsed = documents.select(F.from_json(column, _SCAN).alias("d"))
    listed = parsed.select(F.explode("d.errors").alias("e")).select(F.col("e.message").alias("message"))
    return listed.unionByName(parsed.where("d IS NULL OR (d.results IS NULL AND d.errors IS NULL)").select(F.lit("malformed scan document").alias("message")))
