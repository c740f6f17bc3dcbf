"""Reports: findings by rule, severities, counters and rates, verdicts against expectations, serialized results."""

from __future__ import annotations

from siftwell.operators import base, classify
from siftwell.plans.dialect import Dialect


def findings_by_rule(d: Dialect) -> str:
    """Findings, files and repositories of each rule."""
    return f"SELECT rule_id, {d.int('count(*)')} AS findings, {d.int('count(DISTINCT file_path)')} AS files, {d.int('count(DISTINCT repo)')} AS repos FROM {base.findings(d)} f GROUP BY rule_id"


def _severity(d: Dialect) -> str:
    s = "upper(trim(severity))"
    return f"CASE WHEN {s} IN ('CRITICAL', 'HIGH') THEN 'ERROR' WHEN {s} = 'MEDIUM' THEN 'WARNING' WHEN {s} = 'LOW' THEN 'INFO' ELSE coalesce({s}, 'WARNING') END"


def severities(d: Dialect) -> str:
    """Severities after their aliases, in any case and with stray blanks; a missing one is a warning."""
    return f"SELECT severity, {d.int('count(*)')} AS findings FROM (SELECT {_severity(d)} AS severity FROM {base.findings(d)} f) s GROUP BY severity"


def severe_findings(d: Dialect) -> str:
    """Findings whose severity is an error."""
    return f"SELECT finding_no, rule_id, repo, file_path FROM {base.findings(d)} f WHERE {_severity(d)} = 'ERROR'"


def first_findings(d: Dialect) -> str:
    """Top-k report: the 100 findings with the least numbers."""
    return f"SELECT finding_no, rule_id, file_path FROM {base.findings(d)} f ORDER BY finding_no LIMIT 100"


def verdict_counts(d: Dialect) -> str:
    """Counters over all results and the rates that follow from them (0 when there are none)."""
    v = "lower(trim(verdict))"
    n = lambda name: f"count(CASE WHEN {v} = '{name}' THEN 1 END)"
    return f"""SELECT {d.int("count(*)")} AS total, {", ".join(f"{d.int(n(x))} AS {x}" for x in ("true_positive", "false_positive", "needs_review", "needs_more_context"))},
               {d.double(f"CASE WHEN count(*) = 0 THEN 0 ELSE {n('false_positive')} * 100.0 / count(*) END")} AS false_positive_rate, {d.int("sum(tool_calls_made)")} AS tool_calls,
               {d.int("sum(CASE WHEN context_iterations > 1 THEN context_iterations - 1 ELSE 0 END)")} AS expansions FROM {base.results(d)} r"""


def actionable_results(d: Dialect) -> str:
    """Results to act on: true positives and those that need review."""
    return f"SELECT result_id, finding_no, lower(trim(verdict)) AS verdict FROM {base.results(d)} r WHERE lower(trim(verdict)) IN ('true_positive', 'needs_review')"


def scanned_files(d: Dialect) -> str:
    """Per repository and language the files and functions seen."""
    return f"""SELECT repo, lang, {d.int("count(DISTINCT file_path)")} AS files, {d.int("count(*)")} AS functions, {d.int("count(DISTINCT class_name)")} AS classes
               FROM (SELECT repo, file_path, class_name, {base.language(d)} AS lang FROM {base.functions(d)} f) x GROUP BY repo, lang"""


def verdict_matrix(d: Dialect) -> str:
    """Verdicts of the analysis against those before it."""
    return f"""SELECT p.verdict AS before_analysis, lower(trim(r.verdict)) AS after_analysis, {d.int("count(*)")} AS results
               FROM {base.results(d)} r JOIN ({classify.preanalysis_score(d)}) p ON r.finding_no = p.finding_no GROUP BY p.verdict, lower(trim(r.verdict))"""


def metadata_members(d: Dialect) -> str:
    """Members of the findings' JSON metadata, with defaults; malformed text gives the defaults."""
    return f"""SELECT finding_no, coalesce({d.json("metadata", "category")}, 'unknown') AS category, coalesce(upper({d.json("metadata", "confidence")}), 'UNKNOWN') AS confidence,
               {d.json("metadata", "dataflow_trace.kind")} AS flow FROM {base.findings(d)} f WHERE metadata IS NOT NULL AND metadata LIKE '{{%'"""


def results_json(d: Dialect) -> str:
    """One JSON document per result."""
    return f"SELECT result_id, {d.object(finding_id='finding_id', verdict='lower(trim(verdict))', tool_calls='tool_calls_made', iterations='context_iterations')} AS document FROM {base.results(d)} r"


def result_files(d: Dialect) -> str:
    """Name of the file each result is saved under: numbered within its finding, three digits."""
    text = "STRING" if d.spark else "VARCHAR"
    return f"""SELECT result_id, concat({d.sub("finding_id", "[^A-Za-z0-9_-]", "_")}, '/', lpad(CAST(n AS {text}), 3, '0'), '_final.json') AS path
               FROM (SELECT result_id, finding_id, row_number() OVER (PARTITION BY finding_id ORDER BY result_id) AS n FROM {base.results(d)} r) x"""


PLANS = (findings_by_rule, severities, severe_findings, first_findings, verdict_counts, actionable_results, scanned_files, verdict_matrix, metadata_members, results_json, result_files)
