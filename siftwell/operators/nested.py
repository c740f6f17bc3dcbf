"""Deeply nested records into flat child tables with parent-child links.

Every table is one projection over its parent: nested ``transform`` calls carry the ancestor's key and
the 0-based indices down to each child, ``flatten`` joins the per-ancestor arrays and one ``inline``
emits the rows. There is no self-join, no repeated explode and no Python.

Defined cases
    * positions count null elements, which give no row; elements that are no objects give none either;
    * an object where a list is expected is a list of one;
    * text that holds JSON text is read through, at every level;
    * malformed JSON, at the level where it stands, gives no rows; so do null, empty and blank texts;
    * a child without the key member has a null ``child_key``;
    * a parent delivered twice gives each child once; extra columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

_STRICT = "map('allowSingleQuotes','false','allowNonNumericNumbers','false')"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``value`` evaluated once under ``name``: lambdas have no common-subexpression pass."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _plain(text: str) -> str:
    """JSON text, a quoted JSON string replaced by its content."""
    return f"CASE WHEN ltrim({text}) LIKE '\"%' THEN get(from_json(concat('[', {text}, ']'), 'array<string>', {_STRICT}), 0) ELSE {text} END"


def _record(text: str, members: str) -> str:
    """The members of the one object in ``text`` as a struct of texts; NULL unless it is exactly one well-formed object."""
    parsed = f"from_json(concat('[', {text}, ']'), 'array<struct<{members}>>', {_STRICT})"
    return f"CASE WHEN ltrim({text}) LIKE '{{%' THEN {_let('one', parsed, 'CASE WHEN size(one) = 1 THEN one[0] END')} END"


def _elements(text: str) -> str:
    """The elements of a list as texts; an object counts as a list of one; anything else has none."""
    nested = f"from_json(concat('[', {text}, ']'), 'array<array<string>>', {_STRICT})"
    return (
        f"CASE WHEN ltrim({text}) LIKE '[%' THEN {_let('all', nested, 'CASE WHEN size(all) = 1 THEN all[0] END')} "
        f"WHEN ltrim({text}) LIKE '{{%' THEN array({text}) END"
    )


def _emit(df: DataFrame, field: str, rows: str) -> DataFrame:
    """``rows``: array<array<struct<parent_id, pos, sub_pos, child_key>>> with nulls where there is nothing."""
    flat = df.selectExpr(f"filter(flatten(filter({rows}, r -> r IS NOT NULL)), r -> r IS NOT NULL) AS rows")
    return flat.selectExpr("inline(rows)").selectExpr(f"'{field}' AS field", "parent_id", "pos", "sub_pos", "child_key")


def _row(parent: str, pos: str, sub: str, key: str) -> str:
    return (
        f"named_struct('parent_id', {parent}, 'pos', CAST({pos} AS BIGINT), 'sub_pos', CAST({sub} AS BIGINT), "
        f"'child_key', CAST({key} AS STRING))"
    )


def trace_children(findings: DataFrame, key: str = "finding_no", column: str = "metadata") -> DataFrame:
    """Steps of ``dataflow_trace`` and the ``vars`` of each step."""
    trace = _let("doc", _plain(f"`{column}`"), f"{_record('doc', 'dataflow_trace: string')}.dataflow_trace")
    steps = _let("trace", _let("t", trace, _plain("t")), f"{_record('trace', 'steps: string')}.steps")
    elements = _let("steps", _let("l", steps, _plain("l")), _elements("steps"))
    variable = _let("p", _plain("v"), _let("o", _record("p", "name: string"), f"CASE WHEN o IS NOT NULL THEN {_row(f'`{key}`', 'i', 'j', 'o.name')} END"))
    variables = _let("vs", _let("q", "s.vars", _plain("q")), f"transform({_elements('vs')}, (v, j) -> {variable})")
    step = _let("w", _plain("raw"), _record("w", "id: string, vars: string"))
    body = _let("s", step, f"CASE WHEN s IS NOT NULL THEN concat(array({_row(f'`{key}`', 'i', '-1', 's.id')}), coalesce({variables}, array())) END")
    return _emit(findings, "metadata", f"transform({elements}, (raw, i) -> {body})")


def history_children(results: DataFrame, key: str = "result_id", column: str = "conversation_history") -> DataFrame:
    """Tool calls of each turn; the turns are the document itself or stand under ``messages``."""
    listed = _let("o", _record("doc", "messages: string"), f"CASE WHEN o IS NULL THEN doc WHEN o.messages IS NULL THEN doc ELSE {_plain('o.messages')} END")
    turns = _let("turns", _let("doc", _plain(f"`{column}`"), listed), _elements("turns"))
    call = _let("p", _plain("c"), _let("o", _record("p", "id: string"), f"CASE WHEN o IS NOT NULL THEN {_row(f'`{key}`', 'i', 'j', 'o.id')} END"))
    calls = _let("t", _let("w", _plain("raw"), f"{_record('w', 'tool_calls: string')}.tool_calls"), _let("u", _plain("t"), f"transform({_elements('u')}, (c, j) -> {call})"))
    return _emit(results, "conversation_history", f"transform({turns}, (raw, i) -> {calls})")


def answer_children(results: DataFrame, key: str = "result_id", column: str = "guided_answers") -> DataFrame:
    """Entries of a map column, null values included."""
    rows = f"array(transform(map_keys(`{column}`), k -> {_row(f'`{key}`', '-1', '-1', 'k')}))"
    return _emit(results, "guided_answers", rows)


def call_children(messages: DataFrame, key: str = "message_id", column: str = "tool_calls") -> DataFrame:
    """Elements of an array-of-struct column; null elements keep their place and give no row."""
    rows = f"array(filter(transform(`{column}`, (c, i) -> CASE WHEN c IS NOT NULL THEN {_row(f'`{key}`', 'i', '-1', 'c.id')} END), r -> r IS NOT NULL))"
    return _emit(messages, "tool_calls", rows)


def flat_children(findings: DataFrame, results: DataFrame, messages: DataFrame) -> DataFrame:
    """All child tables as one: field, parent_id, pos, sub_pos, child_key; each child once."""
    parts = [trace_children(findings), history_children(results), answer_children(results), call_children(messages)]
    return reduce(DataFrame.unionByName, parts).distinct()
