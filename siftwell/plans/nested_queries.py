"""Driver queries of the nested-record operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwell.operators import nested
from siftwell.sources import read_table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flat_children(
        read_table(spark, sf_dir, "findings", "finding_no", "metadata"),
        read_table(spark, sf_dir, "results", "result_id", "conversation_history", "guided_answers"),
        read_table(spark, sf_dir, "messages", "message_id", "tool_calls"),
    )


def _plain(x: str) -> str:
    """The value of JSON text inside JSON text."""
    return f"CASE json_type({x}) WHEN 'VARCHAR' THEN CASE WHEN json_valid({x} ->> '$') THEN CAST({x} ->> '$' AS JSON) END ELSE {x} END"


def _list(x: str) -> str:
    return f"CASE json_type({x}) WHEN 'ARRAY' THEN CAST({x} AS JSON[]) WHEN 'OBJECT' THEN [{x}] END"


def _checking_sql() -> str:
    """The same children by unnesting level after level."""
    return f"""
    WITH meta AS (SELECT DISTINCT finding_no AS id, metadata AS t FROM findings WHERE json_valid(metadata)),
    m1 AS (SELECT id, {_plain("CAST(t AS JSON)")} AS v FROM meta), m2 AS (SELECT id, {_plain("(v -> '$.dataflow_trace')")} AS v FROM m1), m3 AS (SELECT id, {_plain("(v -> '$.steps')")} AS v FROM m2),
    m4 AS (SELECT id, {_list("v")} AS l FROM m3), m5 AS (SELECT id, unnest(range(len(l))) AS pos, unnest(l) AS e FROM m4), m6 AS (SELECT id, pos, {_plain("e")} AS e FROM m5), step AS (SELECT * FROM m6 WHERE json_type(e) = 'OBJECT'),
    v1 AS (SELECT id, pos, {_plain("(e -> '$.vars')")} AS v FROM step), v2 AS (SELECT id, pos, {_list("v")} AS l FROM v1), v3 AS (SELECT id, pos, unnest(range(len(l))) AS sub_pos, unnest(l) AS e FROM v2), v4 AS (SELECT id, pos, sub_pos, {_plain("e")} AS e FROM v3),
    hist AS (SELECT DISTINCT result_id AS id, conversation_history AS t FROM results WHERE json_valid(conversation_history)),
    h1 AS (SELECT id, {_plain("CAST(t AS JSON)")} AS v FROM hist), h2 AS (SELECT id, CASE WHEN json_type(v) = 'OBJECT' AND json_type(v -> '$.messages') <> 'NULL' THEN v -> '$.messages' ELSE v END AS v FROM h1), h3 AS (SELECT id, {_plain("v")} AS v FROM h2),
    h4 AS (SELECT id, {_list("v")} AS l FROM h3), h5 AS (SELECT id, unnest(range(len(l))) AS pos, unnest(l) AS e FROM h4), h6 AS (SELECT id, pos, {_plain("e")} AS e FROM h5), h7 AS (SELECT id, pos, {_plain("(e -> '$.tool_calls')")} AS v FROM h6 WHERE json_type(e) = 'OBJECT'),
    h8 AS (SELECT id, pos, {_list("v")} AS l FROM h7), h9 AS (SELECT id, pos, unnest(range(len(l))) AS sub_pos, unnest(l) AS e FROM h8), h10 AS (SELECT id, pos, sub_pos, {_plain("e")} AS e FROM h9),
    c1 AS (SELECT message_id AS id, unnest(range(len(tool_calls))) AS pos, unnest(tool_calls) AS c FROM messages)
    SELECT DISTINCT * FROM (
      SELECT 'metadata' AS field, id AS parent_id, CAST(pos AS BIGINT) AS pos, CAST(-1 AS BIGINT) AS sub_pos, e ->> '$.id' AS child_key FROM step
      UNION ALL SELECT 'metadata', id, pos, sub_pos, e ->> '$.name' FROM v4 WHERE json_type(e) = 'OBJECT'
      UNION ALL SELECT 'conversation_history', id, pos, sub_pos, e ->> '$.id' FROM h10 WHERE json_type(e) = 'OBJECT'
      UNION ALL SELECT 'guided_answers', result_id, -1, -1, unnest(map_keys(guided_answers)) FROM results
      UNION ALL SELECT 'tool_calls', id, pos, -1, c.id FROM c1 WHERE c IS NOT NULL)
    """


QUERIES = {"p5_found": p5_found}
SQL = {"p5_found": _checking_sql()}
