"""Classification of findings: kinds of weakness, sinks, origins of values, constants, questions, the score before analysis."""

from __future__ import annotations

from siftwell.functions import catalogs as c
from siftwell.operators import base
from siftwell.plans.dialect import Dialect


def _kind(d: Dialect, rule: str = "rule_id") -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({rule}), {d.lit(part)}) THEN {d.lit(kind)}" for part, kind in c.RULE_KINDS) + " ELSE 'unknown' END"


def rule_kind(d: Dialect) -> str:
    """Kind of weakness of each rule: the first part contained in its id decides."""
    return f"SELECT DISTINCT rule_id, {_kind(d)} AS kind FROM {d.t('findings')} f WHERE rule_id IS NOT NULL"


def issue_of_rule(d: Dialect) -> str:
    """Issue whose hint goes with a rule."""
    cases = " ".join(f"WHEN {' OR '.join(f'contains(lower(rule_id), {d.lit(p)})' for p in parts)} THEN {d.lit(issue)}" for parts, issue in c.ISSUES)
    return f"SELECT DISTINCT rule_id, CASE {cases} ELSE 'default' END AS issue FROM {d.t('findings')} f WHERE rule_id IS NOT NULL"


def _sink(d: Dialect, kind: str = "kind", code: str = "code_snippet") -> tuple[str, str]:
    """validity and reason of a finding's sink."""
    valid, reason = [f"WHEN {kind} = 'unknown' THEN true"], [f"WHEN {kind} = 'unknown' THEN 'unknown'"]
    for name, (sinks, safe) in c.SINK_RULES.items():
        is_safe = f"{kind} = '{name}' AND {d.any(code, safe)}"
        if name == "hardcoded_secret":
            is_sink = f"{kind} = '{name}' AND {d.any(code, c.SECRET_LITERALS)}"
        else:
            is_sink = f"{kind} = '{name}' AND {d.any(code, sinks)}"
        valid += [f"WHEN {is_safe} THEN false", f"WHEN {is_sink} THEN true", f"WHEN {kind} = '{name}' THEN false"]
        reason += [f"WHEN {is_safe} THEN 'safe transform'", f"WHEN {is_sink} THEN 'sink'", f"WHEN {kind} = '{name}' THEN 'no sink'"]
    return f"CASE {' '.join(valid)} ELSE true END", f"CASE {' '.join(reason)} ELSE 'no requirement' END"


def sink_check(d: Dialect) -> str:
    """Is there a sink that fits the rule? Safe transforms go before sinks; kinds without requirements hold."""
    valid, reason = _sink(d)
    confidence = "CASE reason WHEN 'safe transform' THEN 0.9 WHEN 'sink' THEN 0.9 WHEN 'no sink' THEN 0.7 ELSE 0.5 END"
    return f"""
    SELECT finding_no, kind, valid, reason, {d.double(confidence)} AS confidence FROM (
      SELECT finding_no, kind, {valid} AS valid, {reason} AS reason FROM (SELECT finding_no, code_snippet, {_kind(d)} AS kind FROM {base.findings(d)} f) k) r
    """


def _origin(d: Dialect, code: str = "code_snippet") -> str:
    return f"CASE WHEN {d.any(code, [p for p, _ in c.USER_INPUT])} THEN 'user_input' WHEN {d.any(code, [p for p, _ in c.CONFIG])} THEN 'config_loaded' WHEN {d.any(code, [p for p, _ in c.SYSTEM])} THEN 'system_internal' ELSE 'unknown' END"


def value_origin(d: Dialect) -> str:
    """Where the values of a finding come from: user input before configuration before system, with the first reason of each."""
    return f"""
    SELECT finding_no, origin, origin IN ('config_loaded', 'system_internal') AS trusted,
           {d.double("CASE origin WHEN 'user_input' THEN 0.95 WHEN 'config_loaded' THEN 0.9 WHEN 'system_internal' THEN 0.95 ELSE 0.5 END")} AS confidence,
           CASE origin WHEN 'user_input' THEN {d.first_label("code_snippet", c.USER_INPUT)} WHEN 'config_loaded' THEN {d.first_label("code_snippet", c.CONFIG)} WHEN 'system_internal' THEN {d.first_label("code_snippet", c.SYSTEM)} END AS reason
    FROM (SELECT finding_no, code_snippet, {_origin(d)} AS origin FROM {base.findings(d)} f) o
    """


def finding_variable(d: Dialect) -> str:
    """The variable a finding is about."""
    return f"SELECT finding_no, {d.first_group('code_snippet', c.FINDING_VARIABLE)} AS variable FROM {base.findings(d)} f"


def trusted_constants(d: Dialect) -> str:
    """Constants defined on the lines of functions: name and value by the first pattern that matches."""
    name = d.first_group("text", c.CONSTANTS, "(?i)")
    value = "coalesce(" + ", ".join(d.ex("text", "(?i)" + p, 2) for p in c.CONSTANTS) + ")"
    return f"SELECT * FROM (SELECT function_id, line_no, {name} AS name, {value} AS value FROM {base.function_lines(d)} l) k WHERE name IS NOT NULL"


def output_context(d: Dialect) -> str:
    """Does the finding's variable reach output? Safe contexts are tried before dangerous ones."""
    v = "variable"
    piece = lambda before, after: f"concat({d.lit('(?i)' + before)}, {v}, {d.lit(after)})"
    hit = lambda before, after: f"code_snippet RLIKE {piece(before, after)}" if d.spark else f"regexp_matches(code_snippet, {piece(before, after)})"
    # Fixed values: (before, after) the variable, safe contexts and then dangerous ones.
    safe = (("", r"\s*\.equals\s*\("), ("", r"\s*\.matches\s*\("), (r"Integer\.parseInt\s*\(\s*", ""), (r"Long\.parseLong\s*\(\s*", ""), (r"Enum\.valueOf\s*\([^,]+,\s*", ""), (r"logger\.[a-z]+\s*\([^)]*", ""), (r"log\.[a-z]+\s*\([^)]*", ""))
    bad = ((r"\.write\s*\([^)]*", ""), (r"\.print\s*\([^)]*", ""), (r"innerHTML\s*=\s*[^;]*", ""), (r"\.html\s*\([^)]*", ""))
    return f"""
    SELECT finding_no, variable, CASE WHEN {' OR '.join(hit(*s) for s in safe)} THEN false WHEN {' OR '.join(hit(*s) for s in bad)} THEN true ELSE false END AS in_output
    FROM (SELECT finding_no, code_snippet, {d.first_group('code_snippet', c.FINDING_VARIABLE)} AS variable FROM {base.findings(d)} f) x WHERE variable IS NOT NULL
    """


def preanalysis_score(d: Dialect) -> str:
    """Additive score before any model is asked, and what follows from it.

    The increments are added in a fixed order; user input takes .2 off, not below .3, last. Verdicts look at
    the score before it is capped at 1.
    """
    valid, _ = _sink(d)
    constant = d.any("code_snippet", c.CONSTANTS)
    score = "0.5 + CASE WHEN constant THEN 0.30 ELSE 0 END + CASE WHEN NOT valid THEN 0.20 ELSE 0 END + CASE WHEN origin IN ('config_loaded', 'system_internal') THEN 0.35 ELSE 0 END"
    return f"""
    SELECT finding_no, kind, {d.double("least(score, 1.0)")} AS confidence,
           CASE WHEN score >= 0.75 THEN 'likely_false_positive' WHEN score <= 0.35 THEN 'likely_true_positive' ELSE 'needs_llm' END AS verdict, score >= 0.85 AS skip_llm
    FROM (SELECT finding_no, kind, CAST(CASE WHEN origin = 'user_input' THEN greatest(0.3, raw - 0.2) ELSE raw END AS DOUBLE) AS score
          FROM (SELECT finding_no, kind, origin, round(CAST({score} AS DOUBLE), 9) AS raw
                FROM (SELECT finding_no, kind, {valid} AS valid, {_origin(d)} AS origin, {constant} AS constant
                      FROM (SELECT finding_no, code_snippet, {_kind(d)} AS kind FROM {base.findings(d)} f WHERE code_snippet IS NOT NULL) a) b) e) g
    """


PLANS = (rule_kind, issue_of_rule, sink_check, value_origin, finding_variable, trusted_constants, output_context, preanalysis_score)
