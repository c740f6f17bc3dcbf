"""Replies and tool transcripts: parsing replies into verdicts, calls written as text, state, truncation, cost."""

from __future__ import annotations

from siftwell.functions import catalogs as c
from siftwell.operators import base
from siftwell.plans.dialect import Dialect

_VERDICTS = "('true_positive', 'false_positive', 'needs_review', 'needs_more_context', 'insufficient_context')"


def parse_response(d: Dialect) -> str:
    """verdict and confidence of each reply: a status code anywhere, overridden by JSON, fenced or bare; reasoning of bad JSON is the text itself."""
    s = "s"
    fence = f"CASE WHEN contains({s}, '```json') THEN split_part(split_part({s}, '```json', 2), '```', 1) WHEN contains({s}, '```') THEN {d.sub(f'split_part({s}, {chr(39)}```{chr(39)}, 2)', '^json', '')} ELSE {s} END"
    strip = lambda x: d.sub(x, r"^\s+|\s+$", "")
    valid = "j LIKE '{%' AND " + ("try_parse_json(j) IS NOT NULL" if d.spark else "json_valid(j)")
    verdict = f"CASE WHEN jv IN {_VERDICTS} THEN CASE jv WHEN 'insufficient_context' THEN 'needs_more_context' ELSE jv END WHEN contains(s, '1337') THEN 'true_positive' WHEN contains(s, '1007') THEN 'false_positive' WHEN contains(s, '7331') THEN 'needs_more_context' ELSE 'needs_review' END"
    status = "CASE WHEN contains(s, '1337') THEN 0.9 WHEN contains(s, '1007') THEN 0.9 WHEN contains(s, '7331') THEN 0.3 ELSE 0.5 END"
    factors = " + ".join(f"coalesce(CAST({d.json('j', 'confidence_breakdown.' + n)} AS DOUBLE), 0.5) * {w}" for n, w in c.WEIGHTS)
    has = f"{d.json('j', 'confidence_breakdown.' + c.WEIGHTS[0][0])} IS NOT NULL"
    return f"""
    SELECT response_id, CASE WHEN confidence < 0.5 AND verdict = 'needs_review' THEN 'needs_more_context' ELSE verdict END AS verdict, {d.double("confidence")} AS confidence, reasoning
    FROM (SELECT response_id, {verdict} AS verdict, CAST(CASE WHEN ok AND jc IS NOT NULL THEN CAST(jc AS DOUBLE) WHEN ok AND broken_down THEN weighted ELSE {status} END AS DOUBLE) AS confidence,
                 CASE WHEN ok THEN coalesce(jr, '') ELSE substring(s, 1, 1000) END AS reasoning
          FROM (SELECT response_id, s, {valid} AS ok, {d.json("j", "verdict")} AS jv, {d.json("j", "confidence")} AS jc, {d.json("j", "reasoning")} AS jr, {has} AS broken_down, {factors} AS weighted
                FROM (SELECT response_id, s, {strip(fence)} AS j FROM (SELECT response_id, {strip("content")} AS s FROM {base.responses(d)} r WHERE content IS NOT NULL) a) b) e) f
    """


def text_tool_call(d: Dialect) -> str:
    """Replies that write a tool call as text instead of making one."""
    low = "lower(content)"
    marks = " OR ".join(f"contains({low}, {d.lit(m)})" for m in c.TEXT_TOOL_MARKS)
    return f"""SELECT response_id, {marks} OR (contains({low}, '"parameters"') AND (contains({low}, '"tool') OR contains({low}, '"function'))) AS tool_call_in_text FROM {base.responses(d)} r WHERE content IS NOT NULL"""


def _state_label(d: Dialect) -> str:
    return d.first_label("content", c.STATE_SANITIZERS)


def tool_state(d: Dialect) -> str:
    """Per tool call the state its results leave: sanitizers named by them, and confidence .5 plus .15 for each result that names one, at most .95."""
    return f"""
    SELECT tool_call_id, {d.int("count(*)")} AS results, {d.int("count(label)")} AS hits, {d.sorted_join("label", ",")} AS sanitizers, {d.double("least(0.95, 0.5 + 0.15 * count(label))")} AS confidence
    FROM (SELECT tool_call_id, {_state_label(d)} AS label FROM {base.tool_results(d)} t WHERE content IS NOT NULL AND success) x GROUP BY tool_call_id
    """


def conversation_state(d: Dialect) -> str:
    """Per conversation: turns, tool results, their sanitizers, confidence; tool results are joined to the calls they answer."""
    return f"""
    SELECT m.conv_id, {d.int("count(DISTINCT m.message_id)")} AS tool_turns, {d.int("count(x.label)")} AS hits, {d.sorted_join("x.label", ",")} AS sanitizers, {d.double("least(0.95, 0.5 + 0.15 * count(x.label))")} AS confidence
    FROM {base.messages(d)} m LEFT JOIN (SELECT tool_call_id, {_state_label(d)} AS label FROM {base.tool_results(d)} t WHERE content IS NOT NULL) x ON m.tool_call_id = x.tool_call_id
    WHERE m.role = 'tool' GROUP BY m.conv_id
    """


def truncate_middle(d: Dialect, budget: int = 3200) -> str:
    """Tool results over a budget: the first 60 % and the last 20 % of it, a notice between."""
    head, tail = budget * 60 // 100, budget * 20 // 100
    cut = f"concat({d.left('content', head)}, ' ... [', CAST(length(content) - {head + tail} AS {'STRING' if d.spark else 'VARCHAR'}), ' characters left out] ... ', {d.right('content', tail)})"
    return f"SELECT tool_result_id, length(content) > {budget} AS truncated, CASE WHEN length(content) > {budget} THEN {cut} ELSE content END AS content FROM {base.tool_results(d)} t WHERE content IS NOT NULL"


def token_cost(d: Dialect) -> str:
    """Per model tokens and estimated cost; replies without counts cost nothing."""
    return f"""SELECT model, {d.int("count(*)")} AS replies, {d.int("sum(coalesce(prompt_tokens, 0))")} AS prompt_tokens, {d.int("sum(coalesce(completion_tokens, 0))")} AS completion_tokens,
               {d.double("sum(coalesce(prompt_tokens, 0) * 0.01 + coalesce(completion_tokens, 0) * 0.03) / 1000")} AS cost FROM {base.responses(d)} r GROUP BY model"""


PLANS = (parse_response, text_tool_call, tool_state, conversation_state, truncate_middle, token_cost)
