"""Driver queries of the data-flow operators. The checking SQL explodes lines, joins the pattern catalogs as tables and
follows assignments by recursion, where the operators fold arrays inside a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftwell.functions import catalogs as c
from siftwell.operators import dataflow
from siftwell.plans import graph_queries
from siftwell.sources import read_table

#: What the line trace looks for.
TRACED, CALLED = "rowLimit", "execute"


def _over(operator: Callable[[DataFrame], DataFrame], files: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        functions = read_table(spark, sf_dir, "functions")
        return operator(dataflow.files_of(functions) if files else functions)

    return query


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _table(rows: tuple) -> str:
    return "(VALUES " + ", ".join(f"({i}, {_q('(?i)' + r[0])}, {_q(r[1])})" for i, r in enumerate(rows, 1)) + ") p(k, pattern, label)"


def _assigned(text: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({text}, {_q(p)}, 1), '')" for p in c.ASSIGNED) + ")"


def _word(text: str, word: str) -> str:
    return f"regexp_matches({text}, '\\b' || {word} || '\\b')"


_FUNCTIONS = "u AS (SELECT DISTINCT ON (function_id) function_id, source_code FROM functions WHERE source_code IS NOT NULL AND source_code <> '')"
_FILES = """u AS (SELECT min(function_id) AS function_id, string_agg(source_code, chr(10) ORDER BY start_line, function_id) AS source_code
  FROM (SELECT DISTINCT ON (function_id) * FROM functions WHERE source_code IS NOT NULL AND source_code <> '') GROUP BY repo, file_path)"""


def _base(units: str) -> str:
    """li: lines; so: sources by line and pattern; ta: source and tainted variable; pa: paths."""
    return f"""
    WITH RECURSIVE {units},
    li AS (SELECT function_id, line_no, text, {_assigned("text")} AS v FROM (SELECT function_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS text FROM (SELECT function_id, string_split(source_code, chr(10)) AS l FROM u))),
    sp AS (SELECT li.function_id, li.line_no, li.v, p.k, p.label FROM li JOIN {_table(c.TAINT_SOURCES)} ON regexp_matches(li.text, p.pattern)),
    so AS (SELECT function_id, line_no, v, count(*) AS n FROM sp WHERE v IS NOT NULL GROUP BY ALL),
    sk AS (SELECT li.function_id, li.line_no, li.text, min(p.k) AS k, arg_min(p.label, p.k) AS label FROM li JOIN {_table(c.SINKS)} ON regexp_matches(li.text, p.pattern) GROUP BY ALL),
    sn AS (SELECT DISTINCT li.function_id, li.line_no, li.text FROM li JOIN {_table(c.SANITIZERS)} ON regexp_matches(li.text, p.pattern)),
    sw AS (SELECT so.function_id, so.line_no AS source_line, so.v AS source, 1 AS nxt, [so.v] AS acc FROM so
           UNION ALL
           SELECT w.function_id, w.source_line, w.source, w.nxt + 1, CASE WHEN l.v IS NOT NULL AND NOT list_contains(w.acc, l.v) AND len(list_filter(w.acc, lambda a: a <> l.v AND {_word("l.text", "a")})) > 0 THEN list_append(w.acc, l.v) ELSE w.acc END
           FROM sw w JOIN li l ON l.function_id = w.function_id AND l.line_no = w.nxt),
    ta AS (SELECT function_id, source_line, source, unnest(acc) AS variable FROM (SELECT function_id, source_line, source, arg_max(acc, nxt) AS acc FROM sw GROUP BY ALL)),
    hd AS (SELECT function_id, k, min(line_no) AS from_line, any_value(label) AS source_type FROM sp WHERE (function_id, k) IN (SELECT function_id, max(k) FROM sp GROUP BY function_id) GROUP BY ALL),
    p0 AS (SELECT ta.function_id, ta.source_line, ta.source, ta.variable, min(sk.line_no) AS sink_line FROM ta JOIN sk ON ta.function_id = sk.function_id AND {_word("sk.text", "ta.variable")} GROUP BY ALL),
    p1 AS (SELECT p0.*, hd.from_line, hd.source_type FROM p0 JOIN hd ON p0.function_id = hd.function_id),
    aw AS (SELECT DISTINCT function_id, variable, from_line, sink_line, from_line AS nxt, [variable] AS acc FROM p1
           UNION ALL
           SELECT w.function_id, w.variable, w.from_line, w.sink_line, w.nxt + 1, CASE WHEN l.v IS NOT NULL AND NOT list_contains(w.acc, l.v) AND len(list_filter(w.acc, lambda a: a <> l.v AND {_word("l.text", "a")})) > 0 THEN list_append(w.acc, l.v) ELSE w.acc END
           FROM aw w JOIN li l ON l.function_id = w.function_id AND l.line_no = w.nxt WHERE w.nxt <= w.sink_line),
    al AS (SELECT function_id, variable, from_line, sink_line, arg_max(acc, nxt) AS known FROM aw GROUP BY ALL),
    cl AS (SELECT al.function_id, al.variable, count(DISTINCT sn.line_no) AS sanitizer_lines FROM al JOIN sn ON sn.function_id = al.function_id AND sn.line_no BETWEEN al.from_line AND al.sink_line AND len(list_filter(al.known, lambda a: {_word("sn.text", "a")})) > 0 GROUP BY ALL),
    pa AS (SELECT p1.function_id, p1.source_line AS line_no, p1.source, p1.variable, p1.from_line, p1.source_type, p1.sink_line, sk.label AS sink, array_to_string(list_sort(list_filter(al.known, lambda a: a <> p1.variable)), ',') AS aliases, coalesce(cl.sanitizer_lines, 0) AS sanitizer_lines
           FROM p1 JOIN al ON p1.function_id = al.function_id AND p1.variable = al.variable JOIN sk ON p1.function_id = sk.function_id AND p1.sink_line = sk.line_no LEFT JOIN cl ON p1.function_id = cl.function_id AND p1.variable = cl.variable),
    sa AS (SELECT s.function_id, s.sources, coalesce(x.paths, 0) AS paths, coalesce(x.unsafe_paths, 0) AS unsafe_paths FROM (SELECT function_id, CAST(sum(n) AS BIGINT) AS sources FROM so GROUP BY function_id) s
           LEFT JOIN (SELECT pa.function_id, CAST(sum(so.n) AS BIGINT) AS paths, CAST(sum(CASE WHEN pa.sanitizer_lines = 0 THEN so.n ELSE 0 END) AS BIGINT) AS unsafe_paths FROM pa JOIN so ON pa.function_id = so.function_id AND pa.line_no = so.line_no GROUP BY ALL) x ON s.function_id = x.function_id)
    """


_TAINTED = " SELECT function_id, source_line AS line_no, source AS variable, array_to_string(list_sort(list(variable)), ',') AS tainted FROM ta GROUP BY ALL"
_PATHS = " SELECT *, sanitizer_lines > 0 AS is_sanitized FROM pa"
_SAFETY = " SELECT *, CAST(unsafe_paths = 0 AS INT) AS is_safe FROM sa"
_SUMMARIES = """ SELECT u.function_id, CASE WHEN sa.sources IS NULL THEN 'No taint sources' WHEN paths = 0 THEN format('{} source(s), no path to a sink', sources)
    ELSE format('{} source(s), {} path(s): {} sanitized, {} unsanitized', sources, paths, paths - unsafe_paths, unsafe_paths) END AS summary FROM u LEFT JOIN sa ON u.function_id = sa.function_id"""
_LINES = f"WITH {_FUNCTIONS}, li AS (SELECT function_id, line_no, text, {_assigned('text')} AS v FROM (SELECT function_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS text FROM (SELECT function_id, string_split(source_code, chr(10)) AS l FROM u)))"


def _hits(rules: tuple) -> str:
    return f"""{_LINES}, vs AS (SELECT DISTINCT function_id, v FROM li WHERE v IS NOT NULL),
    h AS (SELECT li.function_id, li.line_no, li.text, string_agg(p.label, '; ' ORDER BY p.k) AS labels FROM li JOIN {_table(tuple((a, b) for a, b in rules))} ON regexp_matches(li.text, p.pattern) GROUP BY ALL)
    SELECT h.function_id, vs.v AS variable, h.line_no, h.labels FROM h JOIN vs ON h.function_id = vs.function_id AND {_word("h.text", "vs.v")}"""


_CLEAN = "(?i)" + "|".join(f"(?:{p})" for p in c.LOOKUP_SANITIZERS)
_TRACE = f"""{_LINES} SELECT function_id, count_if(use) AS uses, count_if(use AND clean) AS sanitizers, count_if(sink) AS sinks, min(CASE WHEN sink THEN line_no END) AS first_sink
    FROM (SELECT function_id, line_no, lower(text) LIKE '%{TRACED.lower()}%' AS use, regexp_matches(text, {_q(_CLEAN)}) AS clean, lower(text) LIKE '%{CALLED.lower()}%' AS sink FROM li) GROUP BY function_id HAVING count_if(use OR sink) > 0"""

_THROUGH = (
    _base(_FILES).replace("WITH RECURSIVE", graph_queries._BASE.strip() + ",", 1)
    + """, un AS (SELECT function_id, unsafe_paths FROM sa WHERE unsafe_paths > 0),
    fi AS (SELECT un.function_id, f.repo, f.file_path FROM un JOIN f ON f.function_id = un.function_id),
    ca AS (SELECT function_id, repo, a FROM (SELECT DISTINCT fi.function_id, fi.repo, l.a, dense_rank() OVER (PARTITION BY fi.function_id ORDER BY l.a) AS k FROM fi JOIN n b ON b.repo = fi.repo AND b.file_path = fi.file_path JOIN l ON l.repo = b.repo AND l.b = b.id JOIN n a ON a.repo = l.repo AND a.id = l.a WHERE a.file_path <> fi.file_path) WHERE k <= 5),
    cw AS (SELECT f.repo, f.id, t.text FROM f JOIN (SELECT function_id, unnest(string_split(source_code, chr(10))) AS text FROM f) t ON f.function_id = t.function_id WHERE regexp_matches(t.text, """
    + _q("(?i)" + "|".join(f"(?:{p})" for p, _ in c.SANITIZERS))
    + f""")),
    hp AS (SELECT DISTINCT ca.function_id, ca.a FROM ca JOIN cw ON ca.repo = cw.repo AND ca.a = cw.id JOIN pa ON pa.function_id = ca.function_id AND pa.sanitizer_lines = 0 AND {_word("cw.text", "pa.source")})
    SELECT un.function_id, un.unsafe_paths, (SELECT count(*) FROM ca WHERE ca.function_id = un.function_id) AS callers, (SELECT count(*) FROM hp WHERE hp.function_id = un.function_id) AS sanitizing_callers,
           (SELECT count(*) FROM hp WHERE hp.function_id = un.function_id) > 0 AS safe_through_caller FROM un"""
)


QUERIES = {
    "taint_propagate": _over(dataflow.tainted),
    "taint_paths": _over(dataflow.paths),
    "function_safety": _over(dataflow.safety),
    "function_summaries": _over(dataflow.summaries),
    "file_tainted": _over(dataflow.tainted, files=True),
    "file_paths": _over(dataflow.paths, files=True),
    "file_safety": _over(dataflow.safety, files=True),
    "file_summaries": _over(dataflow.summaries, files=True),
    "variable_sinks": _over(lambda f: dataflow.hits_of_variables(f, "sink")),
    "variable_sanitizers": _over(lambda f: dataflow.hits_of_variables(f, "sanitizer")),
    "variable_states": _over(dataflow.variable_states),
    "line_trace": _over(lambda f: dataflow.line_trace(f, TRACED, CALLED)),
    "taint_across_functions": _over(dataflow.across_functions),
    "safety_through_callers": _over(dataflow.safety_through_callers),
}
SQL = {
    "taint_propagate": _base(_FUNCTIONS) + _TAINTED,
    "taint_paths": _base(_FUNCTIONS) + _PATHS,
    "function_safety": _base(_FUNCTIONS) + _SAFETY,
    "function_summaries": _base(_FUNCTIONS) + _SUMMARIES,
    "file_tainted": _base(_FILES) + _TAINTED,
    "file_paths": _base(_FILES) + _PATHS,
    "file_safety": _base(_FILES) + _SAFETY,
    "file_summaries": _base(_FILES) + _SUMMARIES,
    "variable_sinks": _hits(c.SINKS),
    "variable_sanitizers": _hits(c.SANITIZERS),
    "line_trace": _TRACE,
    "safety_through_callers": _THROUGH,
}
