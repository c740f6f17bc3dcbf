"""Context of findings for prompts and verdicts: questions by rule, paths of taint, callers and what they sanitize."""

from __future__ import annotations

from siftwell.functions import catalogs as c
from siftwell.operators import base, lookup
from siftwell.plans.dialect import Dialect


def rule_questions(d: Dialect) -> str:
    """Which list of guided questions goes with a rule in a file: Java prefixes (longest first), crypto, other parts in order, default."""
    low = "lower(rule_id)"
    java = " ".join(f"WHEN is_java AND starts_with({low}, {d.lit(p)}) THEN {d.lit(q)}" if not d.spark else f"WHEN is_java AND startswith({low}, {d.lit(p)}) THEN {d.lit(q)}" for p, q in sorted(c.JAVA_QUESTIONS, key=lambda x: -len(x[0])))
    rest = " ".join(f"WHEN contains({low}, {d.lit(p)}) THEN {d.lit(q)}" for p, q in (*c.CRYPTO_QUESTIONS, *c.RULE_QUESTIONS))
    return f"""SELECT DISTINCT rule_id, is_java, CASE {java} {rest} ELSE 'default' END AS questions
        FROM (SELECT rule_id, {d.rx("file_path", "[.]java$")} AS is_java FROM {d.t('findings')} f WHERE rule_id IS NOT NULL AND file_path IS NOT NULL) x"""


def caller_flags(d: Dialect) -> str:
    """Per function that may call others: is it an entry point, and how many sanitizers does it use?"""
    entry = " OR ".join(f"contains(source_code, {d.lit(p)}) OR coalesce(contains(class_name, {d.lit(p)}), false)" for p in c.CALLER_ENTRY)
    return f"SELECT function_id, {entry} AS is_entry, {d.count('source_code', '(?i)' + '|'.join(f'(?:{p})' for p in c.CALLER_SANITIZERS))} AS sanitizers FROM {base.functions(d)} f"


def source_and_sink_text(d: Dialect) -> str:
    """Source and sink of a finding in words, for prompts."""
    parameter = d.ex("code_snippet", r"request\.getParameter\(['\"](\w+)['\"]\)")
    body = d.ex("code_snippet", r"request\.body\.(\w+)")
    quote = d.lit("'")
    source = f"coalesce('request.getParameter(' || {quote} || {parameter} || {quote} || ')', 'request.body.' || {body}, 'user input')"
    cases = " ".join(f"WHEN contains(lower(rule_id), {d.lit(part)}) THEN coalesce({', '.join(d.ex('code_snippet', p, 0) for p in patterns)})" for part, patterns in c.PROMPT_SINKS)
    return f"SELECT finding_no, {source} AS source, coalesce(CASE {cases} END, 'dangerous function') AS sink FROM {base.findings(d)} f WHERE code_snippet IS NOT NULL"


def hits_by_kind(d: Dialect) -> str:
    """Search hits counted by kind."""
    return f"SELECT kind, {d.int('count(*)')} AS hits FROM ({lookup.search_code(d)}) h GROUP BY kind"


def tool_usage(d: Dialect) -> str:
    """Per tool its results, failures and empty results."""
    return f"SELECT tool_name, {d.int('count(*)')} AS results, {d.int('count(CASE WHEN NOT success THEN 1 END)')} AS failures, {d.int('count(CASE WHEN content IS NULL OR content = {} THEN 1 END)'.format(d.lit('')))} AS empty FROM {base.tool_results(d)} t GROUP BY tool_name"


def turns_by_role(d: Dialect) -> str:
    """Per conversation its turns by role, and the last role."""
    last = "max_by(role, turn)" if d.spark else "arg_max(role, turn)"
    return f"SELECT conv_id, {', '.join(f'''{d.int(f'count(CASE WHEN role = {chr(39)}{r}{chr(39)} THEN 1 END)')} AS {r}_turns''' for r in ('system', 'user', 'assistant', 'tool'))}, {last} AS last_role FROM {base.messages(d)} m GROUP BY conv_id"


PLANS = (rule_questions, caller_flags, source_and_sink_text, hits_by_kind, tool_usage, turns_by_role)
