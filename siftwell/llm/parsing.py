"""Source files that do not parse in the language their extension claims.

Each value is one function or method. It is cut into tokens of its language and run through the dialect
grammars of that language together (a file of declarations, or members of a class body) by a generalised LL
parser; a value that every dialect rejects makes its file a case. What the parser finds out about a state of its
stacks it remembers per Python worker (``frontiers``).

Defined cases: null, empty and blank code is no case; a byte order mark and either kind of line end are
accepted; files of other extensions are not judged; the language column is not used; rows delivered twice
count once; very long functions are parsed whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.frontiers import Frontiers
from siftwell.llm.grammars import grammar
from siftwell.llm.scanners import SCANNERS
from siftwell.storage import spread

#: Extensions and their languages.
LANGUAGES = {".java": "java", ".py": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".mts": "typescript", ".cts": "typescript"}


@cache
def _reader(language: str) -> tuple[Callable[[str], list[int] | None], Frontiers]:
    rules = grammar(language)
    return SCANNERS[language](rules.kinds), Frontiers(rules)


def parses(code: str, language: str) -> bool:
    """Does some dialect of the language accept the code?"""
    scan, frontiers = _reader(language)
    symbols = scan(code.lstrip("\ufeff"))
    return symbols is not None and frontiers.accepts(symbols)


def judged(functions: DataFrame) -> DataFrame:
    """repo, file_path, language, broken (0 or 1) per function with code in a file of a known language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            broken = [0 if parses(code, language) else 1 for language, code in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(broken, pa.int32())], names=["repo", "file_path", "language", "broken"])

    extension = F.lower(F.regexp_extract("file_path", r"(\.\w+)$", 1))
    language = F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), extension)
    rows = functions.select("repo", "file_path", language.alias("language"), F.col("source_code").cast("string").alias("code"))
    return spread(rows.where("language IS NOT NULL AND code RLIKE '\\\\S'")).mapInArrow(run, "repo string, file_path string, language string, broken int")


def broken_files(functions: DataFrame) -> DataFrame:
    """repo, file_path of the files with a function that no dialect accepts."""
    return judged(functions).where("broken = 1").select("repo", "file_path").distinct()


def rates(functions: DataFrame) -> DataFrame:
    """repo, language, files, broken_files, share, per repository and language."""
    files = judged(functions).groupBy("repo", "file_path", "language").agg(F.max("broken").alias("broken"))
    return files.groupBy("repo", "language").agg(F.count("*").alias("files"), F.sum("broken").cast("bigint").alias("broken_files"), F.avg("broken").alias("share"))
