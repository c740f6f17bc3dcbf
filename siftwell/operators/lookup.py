"""Lookups over code: functions around findings, lines around them, calls and callers, names, classes, searches."""

from __future__ import annotations

from siftwell.operators import base
from siftwell.plans.dialect import Dialect

_CALL = r"(\w+)\s*\("
# Words before a parenthesis that call nothing.
_KEYWORDS = "('if', 'for', 'while', 'switch', 'catch', 'return', 'def', 'function', 'new', 'class', 'with', 'elif', 'except', 'lambda', 'print', 'super', 'synchronized')"


def finding_in_function(d: Dialect) -> str:
    """The innermost function around each finding's first line; findings outside all functions are left out."""
    return f"""SELECT finding_no, function_id, name FROM (
        SELECT f.finding_no, g.function_id, g.name, row_number() OVER (PARTITION BY f.finding_no ORDER BY g.start_line DESC, g.end_line, g.function_id) AS n
        FROM {base.findings(d)} f JOIN {base.functions(d)} g ON f.repo = g.repo AND f.file_path = g.file_path AND f.start_line BETWEEN g.start_line AND g.end_line) x WHERE n = 1"""


def surrounding_lines(d: Dialect) -> str:
    """Lines of functions within ten lines of a finding in their file, numbered, with the distance."""
    return f"""SELECT f.finding_no, l.function_id, {d.int("l.line_no + l.start_line - 1")} AS line, {d.int("l.line_no + l.start_line - 1 - f.start_line")} AS distance, l.text
        FROM {base.findings(d)} f JOIN {d.lines(base.functions(d), "function_id, repo, file_path, start_line", "source_code")} l
        ON f.repo = l.repo AND f.file_path = l.file_path AND l.line_no + l.start_line - 1 BETWEEN f.start_line - 10 AND f.start_line + 10"""


def brace_depth(d: Dialect) -> str:
    """Open braces after each line of functions in brace languages, and whether the function ends there."""
    src = f"(SELECT function_id, source_code FROM {base.functions(d)} f WHERE {base.language(d)} IN ('java', 'javascript'))"
    return f"""SELECT function_id, line_no, depth, depth <= 0 AND line_no > 1 AS ends FROM (
        SELECT function_id, line_no, {d.int("sum(step) OVER (PARTITION BY function_id ORDER BY line_no)")} AS depth
        FROM (SELECT function_id, line_no, {d.count("text", "[{]")} - {d.count("text", "[}]")} AS step FROM {d.lines(src, "function_id", "source_code")} l) x) y"""


def _calls(d: Dialect) -> str:
    return f"(SELECT function_id, repo, name, hit AS callee FROM {d.all_matches(base.functions(d), 'function_id, repo, name', 'source_code', _CALL, 1)} c WHERE hit NOT IN {_KEYWORDS} AND hit <> name)"


def calls(d: Dialect) -> str:
    """Per function the names it calls, and how often."""
    return f"SELECT function_id, callee, {d.int('count(*)')} AS times FROM {_calls(d)} c GROUP BY function_id, callee"


def callers(d: Dialect) -> str:
    """Per function the callers of its name in its repository: how many, and the first five by name."""
    first = "array_join(slice(array_sort(collect_set(c.name)), 1, 5), ',')" if d.spark else "array_to_string(list_sort(list(DISTINCT c.name))[1:5], ',')"
    names = f"(SELECT DISTINCT repo, name, callee FROM {_calls(d)} k)"
    return f"""SELECT g.function_id, c.callers, c.first_callers FROM {base.functions(d)} g
        JOIN (SELECT repo, callee, {d.int("count(*)")} AS callers, {first} AS first_callers FROM {names} c GROUP BY repo, callee) c ON g.repo = c.repo AND g.name = c.callee"""


def call_edges(d: Dialect) -> str:
    """Resolved edges of the call graph: caller and callee names that both are functions of the repository."""
    return f"""SELECT DISTINCT c.repo, c.name AS caller, c.callee FROM {_calls(d)} c JOIN (SELECT DISTINCT repo, name FROM {base.functions(d)} f) g ON c.repo = g.repo AND c.callee = g.name"""


def siblings(d: Dialect) -> str:
    """Per function how many other functions its file has, and the next one below."""
    return f"""SELECT function_id, {d.int("count(*) OVER (PARTITION BY repo, file_path) - 1")} AS others, lead(name) OVER (PARTITION BY repo, file_path ORDER BY start_line, function_id) AS next_name FROM {base.functions(d)} f"""


def class_index(d: Dialect) -> str:
    """File of each class of a repository; of several the one last in path order."""
    return f"SELECT repo, class_name, max(file_path) AS file_path, {d.int('count(DISTINCT file_path)')} AS files FROM {base.functions(d)} f WHERE class_name IS NOT NULL GROUP BY repo, class_name"


def search_code(d: Dialect, term: str = "update") -> str:
    """Hits of a literal, case-insensitive term, once per function and kind: definition, class, call, text."""
    low = lambda col: f"contains(lower({col}), {d.lit(term.lower())})"
    return f"""SELECT function_id, 'definition' AS kind FROM {base.functions(d)} f WHERE {low("name")}
        UNION ALL SELECT function_id, 'class' FROM {base.functions(d)} f WHERE {low("class_name")}
        UNION ALL SELECT DISTINCT function_id, 'call' FROM {_calls(d)} c WHERE {low("callee")}
        UNION ALL SELECT function_id, 'text' FROM {base.functions(d)} f WHERE {low("source_code")} AND NOT {low("name")}"""


def hardcoded_or_template(d: Dialect) -> str:
    """Findings that assign a text: is it hardcoded, or does a getter, a template or a concatenation make it?"""
    # Forms of template strings.
    templates = (r"\"[^\"]*%[sd][^\"]*\"", r"\"[^\"]*\{[^}]*\}[^\"]*\"", r"\"[^\"]*\$\{[^}]*\}[^\"]*\"", r"\"[^\"]*\+\s*\w+")
    value = d.ex("code_snippet", r"\w+\s*=\s*([^;\n]+)")
    return f"""SELECT finding_no, CASE WHEN {d.rx("v", r"[.]get\w*\(")} THEN 'getter' WHEN {d.any("v", templates, "")} THEN 'template' WHEN {d.rx("v", r"[.]format\(|[+]")} THEN 'built' WHEN {d.rx("v", r"^[\"'].*[\"']$")} THEN 'hardcoded' ELSE 'expression' END AS form
        FROM (SELECT finding_no, {value} AS v FROM {base.findings(d)} f) x WHERE v IS NOT NULL"""


def numbered_lines(d: Dialect) -> str:
    """Lines of functions as a numbered view, with a mark on the first."""
    text = "STRING" if d.spark else "VARCHAR"
    return f"SELECT function_id, line_no, concat(CASE WHEN line_no = 1 THEN '>>>' ELSE '   ' END, ' ', lpad(CAST(line_no AS {text}), 4, ' '), ' | ', text) AS shown FROM {base.function_lines(d)} l"


PLANS = (finding_in_function, surrounding_lines, brace_depth, calls, callers, call_edges, siblings, class_index, search_code, hardcoded_or_template, numbered_lines)
