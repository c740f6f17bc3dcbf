"""Sources, sanitizers and sinks by line.

All catalogs are compiled into projections over the lines of a function; nothing is joined to a pattern table.
"""

from __future__ import annotations

from siftwell.functions import catalogs as c
from siftwell.operators import base
from siftwell.plans.dialect import Dialect


def taint_hits(d: Dialect) -> str:
    """Per line the descriptions of all sources, sanitizers and sinks on it; lines without any are left out, by one pass before the labels."""
    return f"""
    SELECT * FROM (
      SELECT function_id, line_no, {d.all_labels("text", c.TAINT_SOURCES, 2)} AS sources, {d.all_labels("text", c.SANITIZERS)} AS sanitizers, {d.all_labels("text", c.SINKS)} AS sinks
      FROM {base.function_lines(d)} l WHERE {d.any("text", [row[0] for row in (*c.TAINT_SOURCES, *c.SANITIZERS, *c.SINKS)])}) h
    WHERE sources <> '' OR sanitizers <> '' OR sinks <> ''
    """


def _sources(d: Dialect) -> str:
    return f"""(SELECT * FROM (SELECT function_id, line_no, {d.first_group("text", c.ASSIGNED)} AS variable, {d.all_labels("text", c.TAINT_SOURCES, 1)} AS source_types FROM {base.function_lines(d)} l WHERE {d.any("text", [row[0] for row in c.TAINT_SOURCES])}) s
               WHERE variable IS NOT NULL AND source_types <> '')"""


def taint_sources(d: Dialect) -> str:
    """Variables assigned from outside data: one row per line, with the types of all sources on it."""
    return f"SELECT function_id, line_no, variable, source_types FROM {_sources(d)} s"


def sanitizer_effectiveness(d: Dialect) -> str:
    """Per line and sanitizer found literally on it: how effective it is."""
    parts = " UNION ALL ".join(f"SELECT function_id, line_no, {d.lit(word)} AS sanitizer, {d.lit(effect)} AS effect FROM ls WHERE contains(text, {d.lit(word)})" for word, effect in c.EFFECTIVENESS)
    return f"WITH ls AS (SELECT function_id, line_no, text FROM {base.function_lines(d)} l) {parts}"


def entry_points_and_sinks(d: Dialect) -> str:
    """Per function of a known language: is it an entry point, does it hold a sink?"""
    flag = lambda table: "CASE lang " + " ".join(f"WHEN '{k}' THEN {d.any('source_code', v, '')}" for k, v in table.items()) + " END"
    return f"SELECT function_id, lang, {flag(c.ENTRY_POINTS)} AS is_entry_point, {flag(c.CODE_SINKS)} AS is_sink FROM (SELECT function_id, source_code, {base.language(d)} AS lang FROM {base.functions(d)} f) x WHERE lang IS NOT NULL"


PLANS = (taint_hits, taint_sources, sanitizer_effectiveness, entry_points_and_sinks)
