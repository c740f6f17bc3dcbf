"""Base relations of the triage plans: each key of a table once, without the columns in which copies differ."""

from __future__ import annotations

from siftwell.plans.dialect import Dialect


def functions(d: Dialect) -> str:
    return f"(SELECT DISTINCT function_id, repo, file_path, name, class_name, start_line, end_line, source_code FROM {d.t('functions')} WHERE source_code IS NOT NULL AND source_code <> '')"


def function_lines(d: Dialect) -> str:
    """function_id, line_no (from 1 within the function), text."""
    return d.lines(functions(d), "function_id", "source_code")


def findings(d: Dialect) -> str:
    return f"(SELECT DISTINCT finding_no, repo, rule_id, message, severity, file_path, start_line, end_line, code_snippet, metadata, feed FROM {d.t('findings')})"


def responses(d: Dialect) -> str:
    return f"(SELECT DISTINCT response_id, finding_no, model, content, finish_reason, prompt_tokens, completion_tokens, total_tokens FROM {d.t('responses')})"


def results(d: Dialect) -> str:
    return f"(SELECT DISTINCT result_id, finding_no, response_id, finding_id, verdict, confidence, reasoning, tool_calls_made, context_iterations, final_iteration, confidence_breakdown FROM {d.t('results')})"


def messages(d: Dialect) -> str:
    return f"(SELECT DISTINCT message_id, conv_id, turn, role, content, tool_call_id, name FROM {d.t('messages')})"


def tool_results(d: Dialect) -> str:
    return f"(SELECT DISTINCT tool_result_id, tool_call_id, tool_name, content, success FROM {d.t('tool_results')})"


def language(d: Dialect, column: str = "file_path") -> str:
    return f"CASE WHEN {d.rx(column, r'[.]java$')} THEN 'java' WHEN {d.rx(column, r'[.]py$')} THEN 'python' WHEN {d.rx(column, r'[.](?:js|jsx|ts|tsx)$')} THEN 'javascript' END"
