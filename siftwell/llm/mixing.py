"""Mixing sources to target weights with soft membership.

1. A labelled table gives the classifier: rows with a listed source are counted per source and hashed
   token (multinomial naive Bayes). All labelled rows are counted, map-side, in one pass; the model has
   ``sources x BUCKETS`` cells, a size that does not grow with the data.
2. Membership: a row whose source is listed belongs to it; a row with a null source gets the posteriors
   of the classifier; a row whose source is not listed has no target and stays out.
3. Document rates in [0, cap] are fitted by projected gradient least squares so that the expected
   tokens of each domain meet ``share * total``. The gradient of a rate depends on the row only through
   its posteriors, so rows with the same posteriors and cap share one rate and are summed first; each
   step is one aggregation whose result is a vector of one number per source.
4. Rates become whole numbers of uses by systematic sampling along the token sizes, so that the tokens
   used follow the rates closely even in small sources.

Defined cases: rows without tokens (null, empty texts) are never used; a listed source without rows
keeps its target in the report and reaches 0, its share being spread over the others in proportion;
with no rows at all the mixture is empty; duplicate rows are separate documents; the largest total is
used at which every source that has rows can still reach its share under its cap, unless ``total`` is
given (then sources that run out are reported short).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.llm.tokens import VOCABULARY, broadcast_vocabulary, encoder
from siftwell.storage import cut, spread

BUCKETS = 8192
#: A text counts as so many tokens of evidence at most, so that posteriors of long texts stay soft.
EVIDENCE = 24.0
STEPS, TOLERANCE = 40, 1e-7
_MAX_SOURCES = 10_000


def _counted(df: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, source, n_tokens and the hashed token counts of each row."""
    content = broadcast_vocabulary(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(content.value).encode
        for batch in batches:
            sizes, cells, counts = [], [], []
            for value in batch.column(2).to_pylist():
                ids = np.asarray(encode(value) if value else [], dtype=np.int64)
                cell, count = np.unique(ids * 2654435761 % (1 << 32) * BUCKETS >> 32, return_counts=True)
                sizes.append(len(ids))
                cells.append(cell.astype(np.int32))
                counts.append(count.astype(np.int32))
            listed = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(cells, listed), pa.array(counts, listed)],
                names=["doc_id", "source", "n_tokens", "cells", "counts"],
            )

    picked = df.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("text").cast("string"))
    return spread(picked).mapInArrow(run, "doc_id bigint, source string, n_tokens bigint, cells array<int>, counts array<int>")


def _log_model(labelled: DataFrame, sources: list[str]) -> np.ndarray:
    """Log prior in column 0, then log P(cell | source); one row per source."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for source, cells, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                row = totals.setdefault(source, np.zeros(BUCKETS + 1))
                row[0] += 1
                if cells:
                    row[np.asarray(cells) + 1] += counts
        for source, row in totals.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([source] * len(at)), pa.array(at, pa.int32()), pa.array(row[at])], names=["source", "cell", "n"])

    summed = labelled.select("source", "cells", "counts").mapInArrow(partial, "source string, cell int, n double").groupBy("source", "cell").agg(F.sum("n").alias("n"))
    table = np.zeros((len(sources), BUCKETS + 1))
    place = {s: k for k, s in enumerate(sources)}
    for row in summed.collect():  # at most sources x (BUCKETS + 1) rows
        table[place[row.source], row.cell] = row.n
    words = table[:, 1:] + 0.05
    prior = np.log((table[:, :1] + 0.5) / (table[:, 0].sum() + 0.5 * len(sources)))
    return np.hstack([prior, np.log(words / words.sum(axis=1, keepdims=True))])


def _posteriors(df: DataFrame, model: np.ndarray, present: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, p (array<double>, one per source) of rows without a source."""
    held = df.sparkSession.sparkContext.broadcast((model, present))  # sources x (BUCKETS + 1) doubles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, has = held.value
        for batch in batches:
            rows = []
            for cells, counts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                score = logs[:, 0].copy()
                if cells:
                    weight = np.asarray(counts, dtype=float)
                    score += logs[:, np.asarray(cells) + 1] @ (weight * min(1.0, EVIDENCE / weight.sum()))
                score[~has] = -np.inf
                p = np.exp(score - score.max())
                rows.append(np.round(p / p.sum(), 4).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "n_tokens", "p"])

    return df.select("doc_id", "n_tokens", "cells", "counts").mapInArrow(run, "doc_id bigint, n_tokens bigint, p array<double>")


def _rates(history: list[list[float]], start: float) -> Column:
    """The rate of a row after all steps, replayed from the errors of the steps: clip(r - p . e) over and over."""
    errors = F.array(*[F.array(*[F.lit(float(x)) for x in step]) for step in history])
    begin = F.least(F.lit(start), F.col("cap"))
    if not history:
        return begin
    dot = lambda e: F.aggregate(F.zip_with("p", e, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(errors, begin, lambda r, e: F.greatest(F.lit(0.0), F.least(F.col("cap"), r - dot(e))))


def mixture(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, total: float | None = None) -> DataFrame:
    """doc_id, source, n_tokens, rate, uses (1..max_repeats): the documents of the mixture."""
    wanted = {r.source: (max(0.0, r.target_share or 0.0), max(0, r.max_repeats or 0)) for r in targets.where("source IS NOT NULL").select("source", "target_share", "max_repeats").limit(_MAX_SOURCES).collect()}
    sources = sorted(wanted)
    counted = cut(_counted(documents, vocabulary), "mix-counted").where("n_tokens > 0")
    labelled = counted.where(F.col("source").isin(sources))
    stock = {r.source: (r.tokens, r.n) for r in labelled.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).collect()}
    present = np.array([s in stock and wanted[s][0] > 0 and wanted[s][1] > 0 for s in sources], dtype=bool)
    caps = np.array([float(wanted[s][1]) for s in sources])
    share = np.array([wanted[s][0] for s in sources]) * present
    if not present.any():
        return documents.sparkSession.createDataFrame([], "doc_id bigint, source string, n_tokens bigint, rate double, uses int")
    share = share / share.sum()
    model = _log_model(labelled, sources)

    unit = F.transform(F.array(*[F.lit(s) for s in sources]), lambda s: F.when(s == F.col("source"), 1.0).otherwise(0.0))
    cap_list = F.array(*[F.lit(float(c)) for c in caps])
    known = labelled.select("doc_id", "source", "n_tokens", unit.alias("p"))
    guessed = _posteriors(counted.where("source IS NULL"), model, present).select("doc_id", F.lit(None).cast("string").alias("source"), "n_tokens", "p")
    # The cap of a soft row is the least cap of the domains it may belong to.
    cap = F.array_min(F.transform(F.arrays_zip(F.col("p").alias("p"), cap_list.alias("c")), lambda z: F.when(z["p"] > 0.02, z["c"])))
    rows = cut(known.unionByName(guessed).withColumn("cap", F.coalesce(cap, F.lit(0.0))).withColumn("grp", F.xxhash64("p", "cap")), "mix-rows")
    groups = cut(rows.groupBy("grp").agg(F.first("p").alias("p"), F.first("cap").alias("cap"), F.sum("n_tokens").alias("tokens")), "mix-groups")

    k = len(sources)
    stocked = groups.agg(*[F.sum(F.col("tokens") * F.col("p")[i]).alias(f"s{i}") for i in range(k)]).first()
    available = np.array([stocked[i] or 0.0 for i in range(k)])
    hard = np.array([float(stock[s][0]) if s in stock else 0.0 for s in sources])
    if total is None:
        total = float(np.min((caps * hard)[present] / share[present]))
    goal, scale = share * total, np.where(available > 0, available, 1.0)
    start, history = min(1.0, total / max(1.0, available.sum())), []
    for _ in range(STEPS):
        rate = _rates(history, start)
        reached = groups.select("tokens", "p", rate.alias("r")).agg(*[F.sum(F.col("tokens") * F.col("p")[i] * F.col("r")).alias(f"t{i}") for i in range(k)]).first()
        error = (np.array([x or 0.0 for x in reached]) - goal) / scale
        if np.max(np.abs(error[present])) < TOLERANCE or (history and np.max(np.abs(error - np.array(history[-1]))) < TOLERANCE * 1e-2):
            break
        history.append([float(x) for x in error])
    return _uses(rows.withColumn("rate", _rates(history, start)))


def _uses(rows: DataFrame) -> DataFrame:
    """Whole numbers of uses with the given rates: systematic sampling within a group, along token sizes.

    Row numbers within a group come from counts per cell (size class and hash), so no group is ever in one task.
    """
    cells = rows.withColumn("size", F.floor(F.log2("n_tokens") * 16).cast("int")).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int"))
    before = Window.partitionBy("grp").orderBy("size", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.groupBy("grp", "size", "part").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inner = Window.partitionBy("grp", "size", "part").orderBy("n_tokens", "doc_id")
    placed = cells.withColumn("i", F.row_number().over(inner)).join(offsets, ["grp", "size", "part"])
    phase = F.pmod(F.xxhash64("grp", F.lit("phase")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    at = F.col("i") + F.col("offset")
    uses = (F.floor(at * F.col("rate") + phase + 1e-9) - F.floor((at - 1) * F.col("rate") + phase + 1e-9)).cast("int")
    return placed.select("doc_id", "source", "n_tokens", "rate", F.least(uses, F.col("cap").cast("int")).alias("uses")).where("uses > 0")


def shares(mixed: DataFrame, documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of ``targets``, and for rows without a listed source together: what was asked and what was reached."""
    mixed = cut(mixed, "mix-uses")
    whole = mixed.agg(F.sum(F.col("n_tokens") * F.col("uses")).cast("double")).first()[0]  # one number
    used = mixed.groupBy("source").agg(F.count("*").alias("documents_used"), F.max("uses").alias("most_uses"), F.sum(F.col("n_tokens") * F.col("uses")).alias("reached_tokens"))
    stock = documents.groupBy("source").agg(F.count("*").alias("documents"))
    named = F.coalesce(F.col("source"), F.lit("(no source)"))
    used, stock = used.withColumn("source", named), stock.withColumn("source", named)
    report = targets.select("source", "target_share", "max_repeats").join(stock, "source", "full").join(used, "source", "full")
    return report.select(
        "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("documents_used", F.lit(0)).alias("documents_used"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.coalesce("reached_tokens", F.lit(0)).alias("reached_tokens"),
        F.coalesce(F.col("reached_tokens") / F.lit(whole), F.lit(0.0)).alias("reached_share"),
    )
