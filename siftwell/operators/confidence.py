"""Confidence of analysis results: weighted score, weakest factors, advice, stop policy, rollups of investigations."""

from __future__ import annotations

from siftwell.functions import catalogs as c
from siftwell.operators import base
from siftwell.plans.dialect import Dialect

_B = "confidence_breakdown"


def weighted(d: Dialect, column: str = _B) -> str:
    return d.double(" + ".join(f"{column}.{name} * {weight}" for name, weight in c.WEIGHTS))


def weighted_confidence(d: Dialect) -> str:
    """Dot product of the six factors with their weights; results without a breakdown are left out."""
    return f"SELECT result_id, {weighted(d)} AS score FROM {base.results(d)} r WHERE {_B} IS NOT NULL"


def weakest_factors(d: Dialect) -> str:
    """The three factors with the least values; ties keep the order of the weights."""
    if d.spark:
        items = ", ".join(f"named_struct('v', {_B}.{name}, 'o', {i}, 'n', '{name}')" for i, (name, _) in enumerate(c.WEIGHTS))
        three = f"array_join(transform(slice(array_sort(array({items})), 1, 3), x -> x.n), ',')"
    else:
        items = ", ".join(f"{{'v': {_B}.{name}, 'o': {i}, 'n': '{name}'}}" for i, (name, _) in enumerate(c.WEIGHTS))
        three = f"array_to_string(list_transform(list_sort([{items}])[1:3], lambda x: x.n), ',')"
    return f"SELECT result_id, {three} AS weakest FROM {base.results(d)} r WHERE {_B} IS NOT NULL"


def advice(d: Dialect) -> str:
    """What would raise the confidence: one sentence for each factor under one half."""
    parts = ", ".join(f"CASE WHEN {_B}.{name} < 0.5 THEN {d.lit(text)} END" for name, text in c.ADVICE)
    return f"SELECT result_id, concat_ws('; ', {parts}) AS advice FROM {base.results(d)} r WHERE {_B} IS NOT NULL"


def stop_policy(d: Dialect) -> str:
    """Go on with a result or stop, and why: the iteration limit, a confident verdict, a wish for context, low confidence."""
    v = "lower(trim(verdict))"
    why = f"CASE WHEN context_iterations >= 3 THEN 'limit' WHEN confidence >= 0.75 AND {v} IN ('true_positive', 'false_positive') THEN 'confident' WHEN {v} = 'needs_more_context' THEN 'wants context' WHEN confidence < 0.5 THEN 'low confidence' ELSE 'done' END"
    return f"SELECT result_id, why, why IN ('wants context', 'low confidence') AS go_on FROM (SELECT result_id, {why} AS why FROM {base.results(d)} r) p"


def investigation_metrics(d: Dialect) -> str:
    """Split of verdicts (whatever is neither true nor false positive counts as review), iterations, averages."""
    v = "lower(trim(verdict))"
    return f"""
    SELECT {d.int("count(*)")} AS total, {d.int(f"count(CASE WHEN {v} = 'true_positive' THEN 1 END)")} AS true_positives, {d.int(f"count(CASE WHEN {v} = 'false_positive' THEN 1 END)")} AS false_positives,
           {d.int(f"count(CASE WHEN {v} IS NULL OR {v} NOT IN ('true_positive', 'false_positive') THEN 1 END)")} AS needs_review,
           {d.int("count(CASE WHEN context_iterations <= 1 THEN 1 END)")} AS single_round, {d.int("count(CASE WHEN context_iterations > 1 THEN 1 END)")} AS several_rounds,
           {d.double("avg(context_iterations)")} AS mean_rounds, {d.double("avg(tool_calls_made)")} AS mean_tool_calls, {d.double("avg(confidence)")} AS mean_confidence
    FROM {base.results(d)} r
    """


def trace_rollup(d: Dialect) -> str:
    """Per finding its investigation: results, tool calls, least and greatest confidence, the last verdict."""
    return f"""
    SELECT finding_no, {d.int("count(*)")} AS results, {d.int("sum(tool_calls_made)")} AS tool_calls, {d.int("max(context_iterations)")} AS rounds,
           {d.double("min(confidence)")} AS least, {d.double("max(confidence)")} AS greatest, {"max_by(verdict, result_id)" if d.spark else "arg_max(verdict, result_id)"} AS last_verdict
    FROM {base.results(d)} r WHERE finding_no IS NOT NULL GROUP BY finding_no
    """


PLANS = (weighted_confidence, weakest_factors, advice, stop_policy, investigation_metrics, trace_rollup)
