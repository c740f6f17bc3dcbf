"""Driver queries over the call graph of ``functions``. The checking SQL is written apart from the operators: it unnests,
joins and recurses where they fold rows, join frontiers and prune."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import catalogs as c
from siftwell.operators import callgraph as g
from siftwell.sources import read_table
from siftwell.storage import cut

_COLUMNS = ("function_id", "repo", "file_path", "name", "class_name", "start_line", "end_line", "decorators", "annotations", "source_code")


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "functions", *_COLUMNS)


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    f = _functions(spark, sf_dir)
    nodes, edges = cut(g.nodes(f), "nodes"), cut(g.edges(f), "edges")
    return nodes, edges, cut(g.links(edges, nodes), "links")


def _starts(nodes: DataFrame) -> DataFrame:
    return nodes.where("is_sink").select("repo", F.col("id").alias("start"))


def call_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.nodes(_functions(spark, sf_dir))


def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.edges(_functions(spark, sf_dir)).select("repo", "caller_id", "callee", "call_line")


def call_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _functions(spark, sf_dir)
    return g.links(g.edges(f), g.nodes(f))


def first_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.first_edges(g.edges(_functions(spark, sf_dir)))


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _functions(spark, sf_dir)
    return g.stats(g.nodes(f), g.edges(f))


def callers_and_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _, links = _graph(spark, sf_dir)
    return g.neighbours(links, nodes)


def paths_to_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _, links = _graph(spark, sf_dir)
    return g.paths_to_sinks(links, nodes)


def caller_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _, links = _graph(spark, sf_dir)
    return g.caller_chains(links, nodes)


def shared_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _, links = _graph(spark, sf_dir)
    return g.shared_chain(links, _starts(nodes))


def caller_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _, links = _graph(spark, sf_dir)
    return g.level_report(links, nodes, _starts(nodes))


def candidate_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _functions(spark, sf_dir)
    return g.candidate_callers(g.edges(f), cut(g.nodes(f), "nodes"))


def cross_file_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _, links = _graph(spark, sf_dir)
    return g.cross_file_context(links, nodes, _starts(nodes))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _flag(table: dict) -> str:
    return "CASE lang " + " ".join(f"WHEN '{k}' THEN regexp_matches(txt, {_q('|'.join(f'(?:{p})' for p in v))})" for k, v in table.items()) + " END"


def _stop() -> str:
    return " OR ".join(f"(lang = '{k}' AND nm IN ({', '.join(_q(w) for w in v)}))" for k, v in g.NO_CALLS.items() if v)


_BASE = f"""
WITH RECURSIVE raw AS (SELECT *, row_number() OVER (PARTITION BY function_id) AS copy FROM functions WHERE name IS NOT NULL AND source_code IS NOT NULL AND source_code <> ''),
f0 AS (SELECT * EXCLUDE (lang), CASE WHEN file_path LIKE '%.java' THEN 'java' WHEN file_path LIKE '%.py' THEN 'python' WHEN regexp_matches(file_path, '[.](?:js|jsx|ts|tsx)$') THEN 'javascript' END AS lang, regexp_replace(file_path, '\\.\\w+$', '') AS bare FROM raw WHERE copy = 1),
f AS (SELECT *, CASE lang WHEN 'java' THEN coalesce(class_name, regexp_extract(bare, '([^/]*)$', 1)) || '.' || name WHEN 'python' THEN replace(bare, '/', '.') || '.' || name ELSE bare || ':' || name END AS id,
      array_to_string(list_concat(coalesce(decorators, []), coalesce(annotations, []), [source_code]), chr(10)) AS txt FROM f0 WHERE lang IS NOT NULL),
n AS (SELECT repo, id, name, class_name, file_path, start_line, end_line, is_entry, is_sink FROM (
      SELECT *, {_flag(c.ENTRY_POINTS)} AS is_entry, {_flag(c.CODE_SINKS)} AS is_sink, row_number() OVER (PARTITION BY repo, id ORDER BY coalesce(start_line, 0) DESC, file_path DESC, function_id DESC) AS k FROM f) WHERE k = 1),
l0 AS (SELECT function_id, repo, lang, id, name, start_line, unnest(range(len(l))) AS i, unnest(l) AS t FROM (SELECT *, string_split(source_code, chr(10)) AS l FROM f)),
ls AS (SELECT *, min(CASE WHEN regexp_matches(t, '(?:^|[^.\\w])' || regexp_escape(name) || '\\s*[(]') THEN i END) OVER (PARTITION BY function_id) AS own FROM l0),
cs AS (SELECT *, unnest(regexp_extract_all(t, '(?:(\\w+)\\.)?(\\w+)\\s*\\(', 1)) AS rc, unnest(regexp_extract_all(t, '(?:(\\w+)\\.)?(\\w+)\\s*\\(', 2)) AS nm FROM ls),
e AS (SELECT repo, id AS caller_id, CASE WHEN rc <> '' THEN rc || '.' || nm ELSE nm END AS callee, rc, nm, CAST(coalesce(start_line, 1) + i AS BIGINT) AS call_line FROM cs WHERE NOT ({_stop()}) AND NOT (coalesce(i = own, false) AND nm = name AND rc = '')),
l AS (SELECT DISTINCT e.repo, e.caller_id AS a, coalesce(x.id, k.id, u.id) AS b FROM (SELECT DISTINCT repo, caller_id, callee, rc, nm FROM e) e LEFT JOIN n x ON e.repo = x.repo AND e.callee = x.id
      LEFT JOIN (SELECT repo, class_name, name, min(id) AS id FROM n WHERE class_name IS NOT NULL GROUP BY ALL) k ON e.repo = k.repo AND e.rc = k.class_name AND e.nm = k.name
      LEFT JOIN (SELECT repo, name, min(id) AS id FROM n GROUP BY ALL HAVING count(*) = 1) u ON e.repo = u.repo AND e.nm = u.name WHERE coalesce(x.id, k.id, u.id) IS NOT NULL)
"""


def _top(n: int) -> str:
    return f"(SELECT repo, a, b FROM (SELECT *, row_number() OVER (PARTITION BY repo, b ORDER BY a) AS k FROM l WHERE a <> b) WHERE k <= {n})"


def _shared() -> str:
    out = f", top5 AS {_top(5)}, s0 AS (SELECT repo, id AS start, id AS node, 0 AS level FROM n WHERE is_sink)"
    for step in (1, 2, 3):
        seen = " UNION ALL ".join(f"SELECT repo, start, node FROM s{i}" for i in range(step))
        out += f", s{step} AS (SELECT DISTINCT s.repo, s.start, t.a AS node, {step} AS level FROM s{step - 1} s JOIN top5 t ON s.repo = t.repo AND s.node = t.b WHERE (s.repo, s.start, t.a) NOT IN ({seen}))"
    return out + ", shared AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3)"


def _report() -> str:
    out = f""", r1 AS (SELECT n.repo, n.id AS start, 1 AS level, row_number() OVER (PARTITION BY n.repo, n.id ORDER BY t.a) AS place, t.a AS node, v.is_entry
        FROM n JOIN {_top(20)} t ON n.repo = t.repo AND n.id = t.b JOIN n v ON t.repo = v.repo AND t.a = v.id WHERE n.is_sink)"""
    for step in range(2, 6):
        out += f""", r{step} AS (SELECT * FROM (SELECT r.repo, r.start, {step} AS level, row_number() OVER (PARTITION BY r.repo, r.start ORDER BY r.place, t.a) AS place, t.a AS node, v.is_entry
            FROM r{step - 1} r JOIN {_top(5)} t ON r.repo = t.repo AND r.node = t.b JOIN n v ON t.repo = v.repo AND t.a = v.id WHERE NOT r.is_entry) WHERE place <= 10)"""
    return out + " " + " UNION ALL ".join(f"SELECT repo, start, CAST(level AS BIGINT) AS level, place, node, is_entry FROM r{i}" for i in range(1, 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (call_nodes, call_sites, call_links, first_edges, graph_stats, callers_and_callees, paths_to_sink, caller_chains, shared_chain, caller_report, candidate_callers, cross_file_context)
}
SQL: dict[str, str] = {
    "call_nodes": _BASE + "SELECT * FROM n",
    "call_sites": _BASE + "SELECT repo, caller_id, callee, call_line FROM e",
    "call_links": _BASE + "SELECT repo, a, b FROM l",
    "first_edges": _BASE + "SELECT repo, caller_id, callee, min(call_line) AS call_line, count(*) AS calls FROM e GROUP BY ALL",
    "graph_stats": _BASE
    + """SELECT v.repo, v.nodes, coalesce(e2.edges, 0) AS edges, v.entries, v.sinks, round(coalesce(e2.pairs, 0) / v.nodes, 6) AS mean_callers, round(coalesce(e2.pairs, 0) / v.nodes, 6) AS mean_callees
        FROM (SELECT repo, count(*) AS nodes, count_if(is_entry) AS entries, count_if(is_sink) AS sinks FROM n GROUP BY repo) v LEFT JOIN (SELECT repo, count(*) AS edges, count(DISTINCT (caller_id, callee)) AS pairs FROM e GROUP BY repo) e2 ON v.repo = e2.repo""",
    "callers_and_callees": _BASE
    + "SELECT n.repo, n.id, (SELECT count(*) FROM l WHERE l.repo = n.repo AND l.b = n.id) AS callers, (SELECT count(*) FROM l WHERE l.repo = n.repo AND l.a = n.id) AS callees FROM n",
    "paths_to_sink": _BASE
    + """, p AS (SELECT repo, id AS source, id AS "at", is_sink AS over, [id] AS path FROM n WHERE is_entry
        UNION ALL SELECT p.repo, p.source, l.b, v.is_sink, list_append(p.path, l.b) FROM p JOIN l ON p.repo = l.repo AND p."at" = l.a JOIN n v ON l.repo = v.repo AND l.b = v.id WHERE NOT p.over AND len(p.path) <= 10 AND NOT list_contains(p.path, l.b))
        SELECT repo, source, p."at" AS sink, array_to_string(path, ' -> ') AS path, CAST(len(path) - 1 AS BIGINT) AS edges FROM p WHERE over""",
    "caller_chains": _BASE
    + """, p AS (SELECT repo, id AS start, id AS node, [id] AS chain, is_entry FROM n WHERE is_sink
        UNION ALL SELECT p.repo, p.start, l.a, list_append(p.chain, l.a), v.is_entry FROM p JOIN l ON p.repo = l.repo AND p.node = l.b JOIN n v ON l.repo = v.repo AND l.a = v.id WHERE NOT p.is_entry AND len(p.chain) < 5 AND NOT list_contains(p.chain, l.a))
        SELECT repo, start, node, array_to_string(chain, ' <- ') AS chain, CAST(len(chain) - 1 AS BIGINT) AS distance, is_entry FROM p""",
    "shared_chain": _BASE + _shared() + " SELECT repo, start, node, CAST(level AS BIGINT) AS level FROM shared",
    "caller_report": _BASE + _report(),
    "candidate_callers": _BASE
    + """, t AS (SELECT n.repo, n.id, e.caller_id, min(CASE WHEN e.callee = n.id THEN 0 WHEN e.callee = n.class_name || '.' || n.name THEN 1 ELSE 2 END) AS tier
        FROM n JOIN e ON n.repo = e.repo AND (e.callee = n.id OR e.callee = n.class_name || '.' || n.name OR e.callee = n.name) WHERE (e.repo, e.caller_id) IN (SELECT repo, id FROM n) GROUP BY ALL)
        SELECT repo, id, caller_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY repo, id ORDER BY caller_id) AS k FROM (SELECT *, min(tier) OVER (PARTITION BY repo, id) AS best FROM t) WHERE tier = best) WHERE k <= 10""",
    "cross_file_context": _BASE
    + _shared()
    + """ SELECT repo, start, kind, node, row_number() OVER (PARTITION BY repo, start, kind ORDER BY rank, node) AS place FROM (
        SELECT repo, start, CASE level WHEN 1 THEN 'caller' ELSE 'chain' END AS kind, node, level AS rank FROM shared
        UNION ALL SELECT s.repo, s.id, 'related', o.id, coalesce(o.start_line, 0) FROM n s JOIN n o ON s.repo = o.repo AND s.file_path = o.file_path AND s.id <> o.id WHERE s.is_sink)""",
}
