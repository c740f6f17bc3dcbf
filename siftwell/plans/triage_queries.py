"""Driver queries of the triage plans, each with the same plan for the checking engine."""

from __future__ import annotations

from siftwell.operators import classify, code, confidence, context, lookup, report, taint, transcripts
from siftwell.plans.dialect import query, sql

_PLANS = {plan.__name__: plan for module in (taint, classify, confidence, transcripts, report, lookup, code, context) for plan in module.PLANS}

QUERIES = {name: query(plan) for name, plan in _PLANS.items()}
SQL = {name: sql(plan) for name, plan in _PLANS.items()}
