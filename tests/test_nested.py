"""Flat child tables against small fixtures: JSON text inside text, lone objects, nulls, malformed documents."""

from siftwell.operators import nested


def _findings(spark, *rows):
    return spark.createDataFrame([(i, text) for i, text in enumerate(rows)], "finding_no bigint, metadata string")


def _rows(df):
    return sorted((r.parent_id, r.pos, r.sub_pos, r.child_key) for r in df.collect())


def test_steps_and_their_variables(spark):
    text = '{"dataflow_trace": {"steps": [{"id": "a", "vars": [{"name": "x"}, null, {"name": "y"}]}, null, {"id": "b"}]}}'
    assert _rows(nested.trace_children(_findings(spark, text))) == [(0, 0, -1, "a"), (0, 0, 0, "x"), (0, 0, 2, "y"), (0, 2, -1, "b")]


def test_an_object_is_a_list_of_one_and_text_is_read_through(spark):
    inner = '{"steps": {"id": "a", "vars": {"name": "x"}}}'
    whole = '{"dataflow_trace": %s}' % __import__("json").dumps(inner)
    quoted = __import__("json").dumps('{"dataflow_trace": ' + inner + "}")
    expected = [(0, 0, -1, "a"), (0, 0, 0, "x")]
    assert _rows(nested.trace_children(_findings(spark, whole))) == expected
    assert _rows(nested.trace_children(_findings(spark, quoted))) == expected


def test_malformed_null_and_empty_documents_give_no_rows(spark):
    bad = ['{"dataflow_trace": {"steps": [{"id": "a"}]}', "", None, "null", "[]", "7", "{'dataflow_trace': {}}", '{"dataflow_trace": {"steps": [{"id": "a"}]}} x', '{"dataflow_trace": null}', '{"dataflow_trace": {"steps": [1, "z", []]}}']
    assert _rows(nested.trace_children(_findings(spark, *bad))) == []


def test_a_child_without_key_has_a_null_key(spark):
    assert _rows(nested.trace_children(_findings(spark, '{"dataflow_trace": {"steps": [{}]}}'))) == [(0, 0, -1, None)]


def test_turns_alone_or_under_messages(spark):
    turns = '[{"role": "u"}, {"tool_calls": [{"id": "c1"}, {"id": "c2"}]}, {"tool_calls": null}]'
    df = spark.createDataFrame([(1, turns), (2, '{"messages": %s}' % turns), (3, '{"tool_calls": {"id": "c3"}}')], "result_id bigint, conversation_history string")
    assert _rows(nested.history_children(df)) == [(1, 1, 0, "c1"), (1, 1, 1, "c2"), (2, 1, 0, "c1"), (2, 1, 1, "c2"), (3, 0, 0, "c3")]


def test_maps_and_arrays_with_nulls(spark):
    answers = spark.createDataFrame([(1, {"q": "a", "r": None}), (2, None), (3, {})], "result_id bigint, guided_answers map<string,string>")
    assert _rows(nested.answer_children(answers)) == [(1, -1, -1, "q"), (1, -1, -1, "r")]
    calls = spark.createDataFrame([(1, [("x", "t"), None, (None, "t")]), (2, None), (3, [])], "message_id bigint, tool_calls array<struct<id: string, type: string>>")
    assert sorted(_rows(nested.call_children(calls)), key=str) == sorted([(1, 0, -1, "x"), (1, 2, -1, None)], key=str)


def test_copies_extra_columns_and_empty_tables(spark):
    findings = spark.createDataFrame([(1, '{"dataflow_trace": {"steps": [{"id": "a"}]}}', "p", 5)] * 2, "finding_no bigint, metadata string, field string, pos int")
    results = spark.createDataFrame([], "result_id bigint, conversation_history string, guided_answers map<string,string>")
    messages = spark.createDataFrame([], "message_id bigint, tool_calls array<struct<id: string>>")
    out = nested.flat_children(findings, results, messages)
    assert out.columns == ["field", "parent_id", "pos", "sub_pos", "child_key"]
    assert [tuple(r) for r in out.collect()] == [("metadata", 1, 0, -1, "a")]


def test_very_many_children(spark):
    text = '{"dataflow_trace": {"steps": [%s]}}' % ",".join('{"id": "%d"}' % i for i in range(20_000))
    assert nested.trace_children(_findings(spark, text)).count() == 20_000
