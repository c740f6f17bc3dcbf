"""Data flow and call graphs on code made by hand: the verdicts a user of line-based taint analysis expects."""

import pytest

from siftwell.operators import callgraph as g
from siftwell.operators import dataflow

_SCHEMA = "function_id bigint, repo string, file_path string, name string, class_name string, start_line int, end_line int, parameters array<string>, source_code string, doc string"


def _functions(spark, *codes, twice=True):
    rows = [(i, "r", f"f{i}.java", f"fn{i}", None, 1, 99, [], c, "x") for i, c in enumerate(codes)]
    return spark.createDataFrame(rows * (2 if twice else 1), _SCHEMA)


def test_taint_goes_through_every_alias(spark):
    code = 'String b = a + "x";\nString a = request.getParameter("q");\nString c = a.trim();\nString d = c;\nstmt.executeQuery(d);'
    (row,) = dataflow.tainted(_functions(spark, code)).collect()
    assert (row.variable, row.tainted) == ("a", "a,b,c,d")


def test_copies_and_changes_are_aliases(spark):
    (row,) = dataflow.variable_states(_functions(spark, 'String input = request.getParameter("i");\nString copied = input;\nString modified = copied.trim();\nString safe = escapeHtml(input);')).collect()
    assert row.aliases == "copied,modified,safe"
    assert row.transformations == "source@L1; alias copied@L2; alias modified@L3; alias safe@L4"
    assert row.sanitizers == "HTML escaping@L4"


@pytest.mark.parametrize(
    "code, verdict",
    [
        ('String q = request.getParameter("q");\nString sql = "select " + q;\nstmt.executeQuery(sql);', (1, 1, 1, 0)),
        ('String q = request.getParameter("q");\nString s = escapeHtml(q);\nresponse.getWriter().write(s);', (1, 1, 0, 1)),
        ('String q = request.getParameter("q");\nstmt.executeQuery("select " + q);', (1, 1, 1, 0)),
        ('String q = request.getParameter("q");\nlog(q);', (1, 0, 0, 1)),
        # The sanitizer stands after the sink.
        ('String q = request.getParameter("q");\nstmt.executeQuery(q);\nString s = escapeHtml(q);', (1, 1, 1, 0)),
        # ... or cleans another variable.
        ('String q = request.getParameter("q");\nString s = escapeHtml(t);\nstmt.executeQuery(q);', (1, 1, 1, 0)),
        # Two ways, one of them clean.
        ('String q = request.getParameter("q");\nString s = sanitize(q);\nString u = "x" + q;\nstmt.executeQuery(u);', (1, 1, 1, 0)),
        ("data = request.json\ncursor.execute(data)", (1, 1, 1, 0)),
        ("const id = req.params.id;\ndocument.write(id);", (1, 1, 1, 0)),
        # A name inside a longer name is another name.
        ('String q = request.getParameter("q");\nstmt.executeQuery(qq);', (1, 0, 0, 1)),
    ],
)
def test_verdicts(spark, code, verdict):
    (row,) = dataflow.safety(_functions(spark, code)).collect()
    assert (row.sources, row.paths, row.unsafe_paths, row.is_safe) == verdict


def test_a_function_without_sources_is_safe_in_words(spark):
    rows = {r.function_id: r.summary for r in dataflow.summaries(_functions(spark, "int x = 1;", 'String q = request.getParameter("q");\nstmt.execute(q);')).collect()}
    assert rows == {0: "No taint sources", 1: "1 source(s), 1 path(s): 0 sanitized, 1 unsanitized"}


def test_paths_name_their_places(spark):
    (row,) = dataflow.paths(_functions(spark, '\nString q = request.getParameter("q");\nString t = q;\nstmt.executeQuery(t);')).collect()
    assert (row.line_no, row.source, row.variable, row.from_line, row.source_type, row.sink_line, row.sink) == (2, "q", "t", 2, "http_param", 4, "SQL query execution")


def test_taint_crosses_functions_by_the_place_of_the_argument(spark):
    rows = [
        (1, "r", "a.java", "get", "A", 1, 9, [], 'void get() {\n  String q = request.getParameter("q");\n  String t = q;\n  save(1, t);\n  save(t, 2);\n}', ""),
        (2, "r", "b.java", "save", "B", 1, 9, ["int n", "String text"], "void save(int n, String text) {\n  stmt.executeQuery(text);\n}", ""),
        (3, "q", "b.java", "save", "B", 1, 9, ["int n", "String text"], "void save(int n, String text) {\n  stmt.executeQuery(text);\n}", ""),
    ]
    got = {(r.caller_id, r.callee_id, r.call_line, r.place, r.argument, r.parameter, r.sink_line, r.is_sanitized) for r in dataflow.across_functions(spark.createDataFrame(rows, _SCHEMA)).collect()}
    assert got == {(1, 2, 4, 1, "t", "text", 2, False), (1, 2, 5, 0, "t", "n", None, False)}


def test_arguments_are_split_outside_brackets(spark):
    row = spark.range(1).selectExpr(f"{dataflow.argument_list(chr(39) + 'a, f(b, c), [d, e], g' + chr(39))} AS a").first()
    assert row.a == ["a", "f(b, c)", "[d, e]", "g"]


def test_null_and_empty_tables(spark):
    none = _functions(spark, None, "")
    empty = spark.createDataFrame([], _SCHEMA)
    for operator in (dataflow.tainted, dataflow.paths, dataflow.safety, dataflow.summaries, dataflow.variable_states, dataflow.across_functions, dataflow.files_of, dataflow.safety_through_callers, lambda f: dataflow.line_trace(f, "x", "y"), lambda f: dataflow.hits_of_variables(f, "sink")):
        assert operator(none).count() == 0 and operator(empty).count() == 0


_GRAPH = [
    ("r", "get", '@GetMapping("/x")\npublic void get() {\n  step(a);\n  step(b);\n  gone(a);\n}'), ("r", "step", "void step() {\n  save(a);\n}"), ("r", "save", "void save() {\n  stmt.executeQuery(a);\n  step(b);\n}"), ("r", "alone", "void alone() {}"),
    ("q", "save", "void save() {\n  stmt.executeQuery(a);\n}"), ("q", "step", "void step() {\n}"),
]


def _graph(spark):
    rows = [(i, repo, f"C{i}.java", name, "C", 1, 9, [], code, "") for i, (repo, name, code) in enumerate(_GRAPH)]
    f = spark.createDataFrame(rows * 2, _SCHEMA)
    nodes, edges = g.nodes(f).cache(), g.edges(f).cache()
    return nodes, edges, g.links(edges, nodes).cache()


def _rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_graphs_are_those_of_the_code(spark):
    nodes, edges, links = _graph(spark)
    assert _rows(g.stats(nodes, edges).select("repo", "nodes", "edges", "entries", "sinks")) == [("q", 2, 1, 0, 1), ("r", 4, 7, 1, 1)]
    assert _rows(links) == [("r", "C.get", "C.step"), ("r", "C.save", "C.step"), ("r", "C.step", "C.save")]
    assert _rows(g.neighbours(links, nodes).where("repo = 'r'")) == [("r", "C.alone", 0, 0), ("r", "C.get", 0, 1), ("r", "C.save", 1, 1), ("r", "C.step", 2, 1)]
    assert ("r", "C.get", "step", 3, 2) in _rows(g.first_edges(edges))


def test_paths_end_at_the_first_sink(spark):
    nodes, _, links = _graph(spark)
    assert _rows(g.paths_to_sinks(links, nodes)) == [("r", "C.get", "C.save", "C.get -> C.step -> C.save", 2)]
    assert _rows(g.paths_to_sinks(links, nodes, depth=1)) == []


def test_chains_visit_no_node_twice_and_stop_at_entries(spark):
    nodes, _, links = _graph(spark)
    assert [r[3] for r in _rows(g.caller_chains(links, nodes).where("repo = 'r'"))] == ["C.save <- C.step <- C.get", "C.save", "C.save <- C.step"]
    starts = nodes.where("is_sink").selectExpr("repo", "id AS start")
    assert _rows(g.shared_chain(links, starts)) == [("r", "C.save", "C.get", 2), ("r", "C.save", "C.step", 1)]
    assert _rows(g.level_report(links, nodes, starts)) == [("r", "C.save", 1, 1, "C.step", False), ("r", "C.save", 2, 1, "C.get", True), ("r", "C.save", 2, 2, "C.save", False), ("r", "C.save", 3, 1, "C.step", False), ("r", "C.save", 4, 1, "C.get", True), ("r", "C.save", 4, 2, "C.save", False), ("r", "C.save", 5, 1, "C.step", False)]


def test_a_dense_graph_has_all_its_simple_paths(spark):
    """621 simple paths of at most ten edges over two edges a node, against a search in plain Python."""
    n = 100
    ids = spark.range(n).selectExpr("'r' AS repo", "CAST(id AS STRING) AS id", "id % 10 = 0 AS is_entry", "id % 9 = 0 AS is_sink")
    out = {i: sorted({(i * 7 + 3) % n, (i * 11 + 5) % n} - {i}) for i in range(n)}
    links = spark.createDataFrame([("r", str(a), str(b)) for a, bs in out.items() for b in bs], "repo string, a string, b string")

    def walk(path):
        if path[-1] % 9 == 0:
            yield path
        elif len(path) <= 10:
            for b in out[path[-1]]:
                if b not in path:
                    yield from walk([*path, b])

    expected = sorted(" -> ".join(map(str, p)) for i in range(0, n, 10) for p in walk([i]))
    assert sorted(r.path for r in g.paths_to_sinks(links, ids).collect()) == expected and len(expected) == 621


def test_callers_are_found_by_the_nearest_way(spark):
    rows = [
        (1, "r", "x/A.java", "run", "A", 1, 2, [], "void run() { }", ""), (2, "r", "x/B.java", "run", "B", 1, 2, [], "void run() { }", ""), (3, "r", "x/C.java", "go", "C", 1, 2, [], "void go() {\n A.run();\n}", ""),
        (4, "r", "x/D.java", "come", "D", 1, 2, [], "void come() {\n run();\n}", ""),
    ]
    f = spark.createDataFrame(rows, _SCHEMA)
    assert _rows(g.candidate_callers(g.edges(f), g.nodes(f))) == [("r", "A.run", "C.go", 0), ("r", "B.run", "D.come", 2)]
    assert _rows(g.cross_file_context(g.links(g.edges(f), g.nodes(f)), g.nodes(f), spark.createDataFrame([("r", "A.run")], "repo string, start string"))) == [("r", "A.run", "caller", "C.go", 1)]


def test_unions_of_graphs(spark):
    a = spark.createDataFrame([("r", "x", "one"), ("r", "y", "one")], "repo string, id string, name string")
    b = spark.createDataFrame([("r", "x", "two")], "repo string, id string, name string")
    assert _rows(g.last_wins(a, b)) == [("r", "x", "two"), ("r", "y", "one")]
    assert g.united(a, a, b).count() == 5
