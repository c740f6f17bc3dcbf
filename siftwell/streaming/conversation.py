"""Conversation state kept over a stream of tool results."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftwell.functions.catalogs import STATE_SANITIZERS

OUTPUT = "tool_call_id string, results long, hits long, sanitizers string, confidence double"
STATE = "results long, hits long, sanitizers string"
_RULES = [(re.compile(pattern, re.I), name) for pattern, name in STATE_SANITIZERS]


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    results, hits, names = state.get if state.exists else (0, 0, "")
    known = set(filter(None, names.split(",")))
    for frame in frames:
        for content in frame.content:
            results += 1
            label = next((name for rule, name in _RULES if rule.search(content)), None)
            if label:
                hits += 1
                known.add(label)
    names = ",".join(sorted(known))
    state.update((results, hits, names))
    yield pd.DataFrame([(key[0], results, hits, names, min(0.95, 0.5 + 0.15 * hits))], columns=["tool_call_id", "results", "hits", "sanitizers", "confidence"])


def tool_state(stream: DataFrame) -> DataFrame:
    """The state of each tool call after every batch; the last row of a call equals the batch plan ``tool_state``.

    ``stream``: tool_call_id, content of tool results; rows without content change nothing.
    """
    return stream.where("content IS NOT NULL").groupBy("tool_call_id").applyInPandasWithState(_fold, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def results_per_window(stream: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tool results per tool and window of event time; rows later than ``late`` are left out."""
    return stream.withWatermark("returned_at", late).selectExpr("tool_name", f"window(returned_at, '{size}') AS w", "success").groupBy("w", "tool_name").count().selectExpr("w.start AS start", "tool_name", "count")
