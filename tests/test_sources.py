"""Source trees, scan documents, sinks, the model step and the stream, on small inputs."""

import json
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from siftwell.operators import code, completer
from siftwell.sources import files, sinks
from siftwell.streaming import conversation


def test_source_trees_skip_and_repair(spark):
    tmp_path = Path(tempfile.mkdtemp(prefix="tree-"))  # the parts that are skipped may stand anywhere in a path
    for name, content in {"a/A.java": b"x\xffy\nz\n", "b/m.py": b"pass", "venv/n.py": b"pass", "c/k.ts": b"let a", "node_modules/q.js": b"1", "c/k.spec.js": b"1"}.items():
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    root = str(tmp_path / "tree")
    java = files.source_files(spark, root, "java")
    assert [r.content for r in java.collect()] == ["x�y\nz\n"]
    assert [(r.line_no, r.text) for r in files.lines(java).orderBy("line_no").collect()] == [(1, "x�y"), (2, "z"), (3, "")]
    assert files.source_files(spark, root, "python").count() == 1
    assert [r.path.rsplit("/", 1)[1] for r in files.source_files(spark, root, "javascript").collect()] == ["k.ts"]


def test_scan_documents_with_defaults(spark):
    good = json.dumps({"results": [{"check_id": "r1", "path": "a.py", "start": {"line": 3, "col": 1}, "extra": {"message": "m", "severity": "ERROR", "metadata": {"cwe": ["x"]}}}, {}], "errors": [{"message": "e1"}], "time": {"total_time": 1.5}})
    documents = spark.createDataFrame([(good,), ("{broken",), (None,)], "document string")
    rows = sorted(tuple(r)[:3] + (r.severity, r.metadata) for r in files.scan_findings(documents).collect())
    assert rows == [("r1", "a.py", 3, "ERROR", '{"cwe":["x"]}'), ("unknown", "", 0, "WARNING", "{}")]
    assert sorted(r.message for r in files.scan_errors(documents).collect()) == ["e1", "malformed scan document", "malformed scan document"]


def test_addresses_and_languages(spark):
    frame = spark.createDataFrame([("https://github.com/a/b",), ("git@gitlab.com:a/b.git",), ("https://x.org/a/b.git",), ("/home/a",), (None,)], "u string")
    assert [r[0] for r in frame.select(files.is_git_url("u")).collect()] == [True, True, True, False, False]
    names = spark.createDataFrame([("a.java",), ("b.py",), ("c.tsx",), ("d.md",)], "p string")
    assert [r[0] for r in names.select(files.language_of("p")).collect()] == ["java", "python", "javascript", None]


def test_results_written_and_rendered(spark, tmp_path):
    results = spark.createDataFrame([(1, "r:a:1", " True_Positive ", 0.914, "why"), (2, None, "false_positive", None, None)], "result_id bigint, finding_id string, verdict string, confidence double, reasoning string")
    sinks.write_results(results, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).where("verdict = 'true_positive'").count() == 1
    text = {r.result_id: r.text for r in sinks.markdown(results).collect()}
    assert text[1] == "## r:a:1\n- Verdict: true_positive\n- Confidence: 91%\n\nwhy" and "n/a" in text[2]


def test_sure_findings_are_not_sent_to_the_model(spark):
    schema = "finding_no bigint, repo string, rule_id string, message string, severity string, file_path string, start_line int, end_line int, code_snippet string, metadata string, feed string"
    findings = spark.createDataFrame([(1, "r", "sql", None, None, "a", 1, 1, 'static final String A = "x"; config.get(a)', None, None), (2, "r", "sql", None, None, "a", 1, 1, "request.getParameter(x); s.executeQuery(x)", None, None)], schema)
    got = {r.finding_no: (r.verdict, r.asked) for r in completer.gated_analysis(findings, completer.RuleCompleter()).collect()}
    assert got == {1: ("false_positive", False), 2: ("true_positive", True)}


def test_python_definitions(spark):
    source = "@deco(1)\nasync def f(a, *, b=1):\n    def g(): pass\n"
    frame = spark.createDataFrame([(1, "a.py", source), (1, "a.py", source), (2, "b.py", "def ("), (3, "c.js", source), (4, "d.py", None)], "function_id bigint, file_path string, source_code string")
    rows = sorted((r.function_id, r.name, r.parameters, r.decorators, r.is_async, r.end_line) for r in code.python_definitions(frame).collect())
    assert rows == [(1, "f", "a,b", ["deco(1)"], True, 3), (1, "g", "", [], False, 3)]


def test_stream_ends_in_the_state_of_the_batch(spark, tmp_path):
    rows = [("c1", "uses escapeHtml"), ("c1", "nothing"), ("c2", "ESAPI and sanitize"), ("c2", None), ("c1", "PreparedStatement")]
    schema = "tool_call_id string, content string"
    for n, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = conversation.tool_state(stream).writeStream.format("memory").queryName("tool_state_test").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    last = spark.table("tool_state_test").groupBy("tool_call_id").agg(F.max_by(F.struct("results", "hits", "sanitizers"), "results").alias("s")).collect()
    assert {r.tool_call_id: tuple(r.s) for r in last} == {"c1": (3, 2, "PreparedStatement,escape"), "c2": (1, 1, "sanitize")}


def test_cut_tables_are_deleted(spark):
    from siftwell.storage import cleanup, cut

    frame = cut(spark.range(3).toDF("n"), "three")
    assert frame.count() == 3
    assert cleanup(spark) >= 1 and cleanup(spark) == 0
