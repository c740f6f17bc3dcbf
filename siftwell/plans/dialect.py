"""One logical plan, written once, rendered as SQL for Spark and for the engine that checks it.

A plan is a function from a ``Dialect`` to SQL text. The differences between the two are few and all here:
how literals are escaped, how patterns are matched, how lists are built and unnested.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from siftwell.sources import read_table

Plan = Callable[["Dialect"], str]


class Dialect:
    spark = True

    def __init__(self, views: dict[str, str] | None = None) -> None:
        self.views = views
        self.used: list[str] = []

    def t(self, name: str) -> str:
        """A base table."""
        if name not in self.used:
            self.used.append(name)
        return self.views[name] if self.views else name

    def lit(self, text: str) -> str:
        if self.spark:
            return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return "'" + text.replace("'", "''") + "'"

    def rx(self, column: str, pattern: str) -> str:
        return f"{column} RLIKE {self.lit(pattern)}" if self.spark else f"regexp_matches({column}, {self.lit(pattern)})"

    def rx_word(self, column: str, word: str) -> str:
        """Does the value of ``word`` (letters, digits, _) stand in ``column`` as a word?"""
        pattern = f"concat({self.lit(chr(92) + 'b')}, {word}, {self.lit(chr(92) + 'b')})"
        return f"{column} RLIKE {pattern}" if self.spark else f"regexp_matches({column}, {pattern})"

    def ex(self, column: str, pattern: str, group: int = 1) -> str:
        """A group of the first match, NULL where there is none."""
        return f"nullif(regexp_extract({column}, {self.lit(pattern)}, {group}), '')"

    def count(self, column: str, pattern: str) -> str:
        return f"CAST(regexp_count({column}, {self.lit(pattern)}) AS BIGINT)" if self.spark else f"CAST(len(regexp_extract_all({column}, {self.lit(pattern)})) AS BIGINT)"

    def sub(self, column: str, pattern: str, new: str) -> str:
        return f"regexp_replace({column}, {self.lit(pattern)}, {self.lit(new)})" if self.spark else f"regexp_replace({column}, {self.lit(pattern)}, {self.lit(new)}, 'g')"

    def any(self, column: str, patterns: Sequence[str], flags: str = "(?i)") -> str:
        """Some pattern matches: one alternation, one pass."""
        return self.rx(column, flags + "|".join(f"(?:{p})" for p in patterns)) if patterns else "false"

    def all_labels(self, column: str, catalog: Sequence[tuple[str, ...]], label: int = 1, flags: str = "(?i)") -> str:
        """The labels of all entries that match, in order, joined by '; ' ('' for none)."""
        return "concat_ws('; ', " + ", ".join(f"CASE WHEN {self.rx(column, flags + row[0])} THEN {self.lit(row[label])} END" for row in catalog) + ")"

    def first_label(self, column: str, catalog: Sequence[tuple[str, ...]], label: int = 1, flags: str = "(?i)") -> str:
        """The label of the first entry that matches."""
        return "CASE " + " ".join(f"WHEN {self.rx(column, flags + row[0])} THEN {self.lit(row[label])}" for row in catalog) + " END"

    def first_group(self, column: str, patterns: Sequence[str], flags: str = "") -> str:
        return "coalesce(" + ", ".join(self.ex(column, flags + p) for p in patterns) + ")"

    def lines(self, source: str, columns: str, column: str) -> str:
        """columns, line_no (from 1), text: the lines of a column of a subquery."""
        if self.spark:
            return f"(SELECT {columns}, pos + 1 AS line_no, text FROM {source} AS src LATERAL VIEW posexplode(split({column}, '\\\\n', -1)) l AS pos, text)"
        return f"(SELECT {columns}, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS text FROM (SELECT *, string_split({column}, chr(10)) AS ls FROM {source} AS src))"

    def all_matches(self, source: str, columns: str, column: str, pattern: str, group: int) -> str:
        """columns, hit: the groups of all matches in a column of a subquery."""
        if self.spark:
            return f"(SELECT {columns}, hit FROM {source} AS src LATERAL VIEW explode(regexp_extract_all({column}, {self.lit(pattern)}, {group})) l AS hit)"
        return f"(SELECT {columns}, unnest(regexp_extract_all({column}, {self.lit(pattern)}, {group})) AS hit FROM {source} AS src)"

    def list(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def append(self, column: str, item: str) -> str:
        return f"array_append({column}, {item})" if self.spark else f"list_append({column}, {item})"

    def has(self, column: str, item: str) -> str:
        return f"array_contains({column}, {item})" if self.spark else f"list_contains({column}, {item})"

    def join(self, column: str, separator: str) -> str:
        return f"array_join({column}, {self.lit(separator)})" if self.spark else f"array_to_string({column}, {self.lit(separator)})"

    def sorted_join(self, value: str, separator: str) -> str:
        """An aggregate: the distinct values in order, joined."""
        return f"coalesce({self.join(f'array_sort(collect_set({value}))' if self.spark else f'list_sort(list(DISTINCT {value}) FILTER ({value} IS NOT NULL))', separator)}, '')"

    def left(self, column: str, n: int) -> str:
        return f"substring({column}, 1, {n})"

    def right(self, column: str, n: int) -> str:
        return f"right({column}, {n})"

    def json(self, column: str, path: str) -> str:
        """A scalar of a JSON text, NULL where there is none or the text is malformed."""
        if self.spark:
            return f"CAST(try_variant_get(try_parse_json({column}), '$.{path}', 'string') AS STRING)"
        return f"json_extract_string(CASE WHEN json_valid({column}) THEN {column} END, '$.{path}')"

    def object(self, **members: str) -> str:
        """JSON text of an object with the given expressions."""
        if self.spark:
            return "to_json(named_struct(" + ", ".join(f"'{k}', {v}" for k, v in members.items()) + "), map('ignoreNullFields', 'false'))"
        return "CAST(json_object(" + ", ".join(f"'{k}', {v}" for k, v in members.items()) + ") AS VARCHAR)"

    def double(self, expression: str) -> str:
        return f"round(CAST({expression} AS DOUBLE), 6)"

    def int(self, expression: str) -> str:
        return f"CAST({expression} AS BIGINT)"


class Checker(Dialect):
    spark = False


def run(plan: Plan, frames: dict[str, DataFrame]) -> DataFrame:
    """The plan over DataFrames by table name."""
    spark = next(iter(frames.values())).sparkSession
    views = {name: f"siftwell_{name}_{uuid.uuid4().hex}" for name in frames}
    for name, frame in frames.items():
        frame.createOrReplaceTempView(views[name])
    try:
        return spark.sql(plan(Dialect(views)))
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def query(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
    """The plan as a driver query: its base tables are read from the data directory."""
    probe = Dialect()
    plan(probe)
    tables = tuple(probe.used)
    return lambda spark, sf_dir: run(plan, {name: read_table(spark, sf_dir, name) for name in tables})


def sql(plan: Plan) -> str:
    return plan(Checker())
