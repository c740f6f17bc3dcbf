"""Code of functions: parameters, block ends, literals, arguments, call lines, definitions by the language's own parser."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from siftwell.operators import base
from siftwell.plans.dialect import Dialect


def parameters(d: Dialect) -> str:
    """Names of the parameters of functions, in order: the last word of each declaration, marks of rest parameters dropped."""
    each = "transform(parameters, p -> regexp_extract(p, '(\\\\w+)\\\\W*$', 1))" if d.spark else "list_transform(parameters, lambda p: regexp_extract(p, '(\\w+)\\W*$', 1))"
    size = "size(parameters)" if d.spark else "len(parameters)"
    return f"SELECT DISTINCT function_id, {d.join(each, ',')} AS names, {d.int(size)} AS n FROM {d.t('functions')} f WHERE parameters IS NOT NULL AND {size} > 0"


def indented_blocks(d: Dialect) -> str:
    """Last line of Python functions by indentation: the line before the first that is not blank and not deeper than the first."""
    indent = f"length(text) - length({d.sub('text', '^[ ]+', '')})"
    src = f"(SELECT function_id, source_code FROM {base.functions(d)} f WHERE {base.language(d)} = 'python')"
    return f"""
    SELECT function_id, {d.int("max(line_no)")} AS lines, {d.int("coalesce(min(CASE WHEN line_no > 1 AND filled AND indent <= first_indent THEN line_no - 1 END), max(line_no))")} AS ends
    FROM (SELECT function_id, line_no, filled, indent, first_value(indent) OVER (PARTITION BY function_id ORDER BY line_no) AS first_indent
          FROM (SELECT function_id, line_no, {d.rx("text", "[^ ]")} AS filled, {indent} AS indent FROM {d.lines(src, "function_id", "source_code")} l) x) y
    GROUP BY function_id
    """


def string_literals(d: Dialect) -> str:
    """String literals per function and how many characters they take."""
    literal = r"\"(?:[^\"\\\n]|\\.)*\""
    return f"""SELECT function_id, {d.count("source_code", literal)} AS literals, {d.int(f"length(source_code) - length({d.sub('source_code', literal, '')})")} AS characters FROM {base.functions(d)} f"""


def sink_arguments(d: Dialect) -> str:
    """First argument of the first query or command call of a finding, cut at the first closing parenthesis, and whether it is a literal."""
    args = d.ex("code_snippet", r"(?:execute\w*|exec|run|query|write)\s*\(([^)]+)\)")
    return f"""SELECT finding_no, {d.sub("first", r"^\s+|\s+$", "")} AS argument, {d.rx("first", r"^\s*(?:\".*\"|'.*')\s*$")} AS is_literal
        FROM (SELECT finding_no, {"split_part"}(args, ',', 1) AS first FROM (SELECT finding_no, {args} AS args FROM {base.findings(d)} f) a WHERE args IS NOT NULL) b"""


def literal_arguments(d: Dialect) -> str:
    """Per rule: calls with an argument, how many of the arguments are literals, and whether all are."""
    return f"""SELECT f.rule_id, {d.int("count(*)")} AS calls, {d.int("count(CASE WHEN a.is_literal THEN 1 END)")} AS literals, count(*) = count(CASE WHEN a.is_literal THEN 1 END) AS all_literal
        FROM ({sink_arguments(d)}) a JOIN (SELECT DISTINCT finding_no, rule_id FROM {d.t('findings')} k) f ON a.finding_no = f.finding_no GROUP BY f.rule_id"""


def call_lines(d: Dialect) -> str:
    """Lines that call something, definition lines left out."""
    definition = r"^\s*(?:@\w+.*\s)?(?:(?:public|private|protected|static|final|async|export|default|abstract)\s+)*(?:def|function|class)\b|^\s*(?:public|private|protected)\b.*[{]\s*$"
    return f"""SELECT function_id, line_no, {d.count("text", r"\w+\s*\(")} AS calls FROM {base.function_lines(d)} l WHERE {d.rx("text", r"\w+\s*\(")} AND NOT {d.rx("text", definition)}"""


def context_gaps(d: Dialect) -> str:
    """What is missing to judge a finding: no function around it, no callers known, a query built from parts, no sanitizer in sight."""
    parts = [
        ("g.finding_no IS NULL", "no enclosing function"), (f"NOT coalesce({d.rx('f.code_snippet', '(?i)sanitiz|escape|encode|valid')}, false)", "no sanitizer in sight"),
        (f"coalesce({d.rx('f.code_snippet', '(?i)(select|update|insert|delete) .*[+%]')}, false)", "query built from parts"), (f"coalesce({d.rx('f.code_snippet', '(?i)request|req[.]')}, false)", "outside data"),
    ]
    from siftwell.operators.lookup import finding_in_function

    return f"""SELECT f.finding_no, concat_ws('; ', {", ".join(f"CASE WHEN {c} THEN {d.lit(t)} END" for c, t in parts)}) AS gaps
        FROM {base.findings(d)} f LEFT JOIN ({finding_in_function(d)}) g ON f.finding_no = g.finding_no"""


def answers_by_question(d: Dialect) -> str:
    """Guided answers per question: how many, how many missing."""
    if d.spark:
        rows = f"(SELECT DISTINCT result_id, q, a FROM {d.t('results')} r LATERAL VIEW explode(guided_answers) e AS q, a)"
    else:
        rows = f"(SELECT DISTINCT result_id, e.key AS q, e.value AS a FROM (SELECT result_id, unnest(map_entries(guided_answers)) AS e FROM {d.t('results')} r))"
    return f"SELECT q AS question, {d.int('count(*)')} AS answers, {d.int('count(*) - count(a)')} AS missing FROM {rows} x GROUP BY q"


PLANS = (parameters, indented_blocks, string_literals, sink_arguments, literal_arguments, call_lines, context_gaps, answers_by_question)


def _definitions(code: str) -> list[tuple]:
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out, todo = [], [(tree, None)]
    while todo:
        node, owner = todo.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                names = [a.arg for a in (*child.args.posonlyargs, *child.args.args, *child.args.kwonlyargs)]
                out.append((child.name, owner, child.lineno, child.end_lineno, ",".join(names), [ast.unparse(x) for x in child.decorator_list], isinstance(child, ast.AsyncFunctionDef)))
            todo.append((child, child.name if isinstance(child, ast.ClassDef) else owner))
    return out


def python_definitions(functions: DataFrame) -> DataFrame:
    """Functions defined in Python code, nested ones too, by the parser of the language: decorators are kept as a list.

    Code that does not parse, null and empty code give no rows; copies of a row give their definitions once.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, *found) for i, code in zip(frame.function_id, frame.source_code) for found in _definitions(code)]
            yield pd.DataFrame(rows, columns=["function_id", "name", "class_name", "start_line", "end_line", "parameters", "decorators", "is_async"])

    python = functions.where("file_path LIKE '%.py' AND source_code IS NOT NULL").select("function_id", "source_code").distinct()
    return python.mapInPandas(run, "function_id bigint, name string, class_name string, start_line int, end_line int, parameters string, decorators array<string>, is_async boolean")
