"""Keyword-stuffed pages, link lists, tag and product lists among documents.

Of each document, read whole, seven features are taken: density of links, share of function words, word entropy,
repetition of word pairs, density of separators, share of the text in listed segments (links, labels, tags, items;
code, logs, tables, annotated lists and references of a text are none) and share of the words of its sentences in dense
phrases. Documents are grouped by the language their stopwords and scripts vote for (the language column may be wrong).
Per group, medians and median absolute deviations give robust centres and scales, the correlations of the clipped
scores a robust scatter matrix. The Mahalanobis distance of a document to its group decides: outliers are spam
where their distance along a direction of spam (lists; stuffed phrases) is great.

A group's model is mixed with that of all documents in proportion to its size, so small groups have no model of
their own and no size changes the rule.

Only counts per group and feature are gathered (languages x features numbers).

Defined cases: null, empty and blank texts are not spam; copies of a text are judged alike; a table without
spread in a feature (all documents alike) has no outliers in it; very long texts cost linear time.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.pairs import STOPWORDS, language
from siftwell.storage import cut, spread

FEATURES = ("links", "function", "entropy", "repetition", "separators", "listing", "stuffing")
#: Directions of spam along the features, in scores: lists of links, tags and items; phrases stuffed into sentences.
DIRECTIONS = np.array([[0.2, -0.2, 0.0, 0.0, 0.1, 1.0, 0.0], [0.0, -0.5, -0.3, 0.8, 0.0, 0.0, 1.0]])
#: An outlier is beyond this squared distance (chi-square of seven degrees of freedom, 0.9999) ...
DISTANCE = 29.9
#: ... and lies in a direction of spam if its distance along one of them (signed, as a root) is at least so great.
TOWARD = 9.3
#: Robust scales have floors: in features in which half of the documents agree, and in shares of a text.
FLOOR = np.array([0.05, 0.05, 0.05, 0.1, 0.05, 0.05, 0.03])
#: A group's centre, scale and correlations are mixed with those of all documents as if so many of these belonged to it.
PRIOR = 200.0
#: Share of the identity in a group's correlations.
RIDGE = 0.3
_CLIP = 3.0
ALL = "(all)"

_URL = re.compile(r"https?://[^\s<>\"')\]]+|www\.[^\s<>\"')\]]+", re.I)
_ANCHOR = re.compile(r"<a\s[^>]*>(.*?)</a>", re.I | re.S)
_MARKDOWN = re.compile(r"\[([^\]\n]*)\]\((?:https?:)?[^)\s]*\)")
_TAGGED = re.compile(r"<[^<>\n]{1,80}>")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_ASIAN = re.compile(r"[\u3040-ヿ一-鿿가-\ud7af]")
_CODE_LINE = re.compile(r"[;{}]\s*$|^\s*(?:def |class |import |from |return\b|function |const |let |var |public |private |protected |static |if \(|for \(|#include|@\w+|//|/\*|\*/|\*\s)|\w\(.*\)\s*[:{;]?\s*$|^\s*\w+ = |=>|\"\"\"")
_CODE_SIGN = re.compile(r"[;{}()=@#/\"*:]|^\s*(?:import|from|return)\b")
_LOG_LINE = re.compile(r"^\s*[\[(]?(?:\d{4}-\d\d-\d\d[T ]?)?\d\d:\d\d(?::\d\d)?|^\s*(?:INFO|WARN(?:ING)?|ERROR|DEBUG|TRACE)\b")
_TABLE_LINE = re.compile(r"^\s*\|.*\|\s*$|\t.*\t|^\s*[-+|: ]{5,}\s*$")
_LABEL = re.compile(r"^\s*(?:tags?|keywords?|schlagw[öo]rter|stichworte|mots[- ]cl[ée]s|etiquetas|palabras clave|more|mehr|plus|más|labels?|topics?)\s*:\s*", re.I)
#: A heading over the references of a text, and an item of such a list.
_HEADING = re.compile(r"^\W*(?:references?|r[ée]f[ée]rences?|verweise|quellen|literatur|referencias?|refer[êe]ncias?|fuentes|fontes|links?|see also|siehe auch|voir aussi|v[ée]ase tambi[ée]n|sources?|riferimenti|ссылки|источники|см\. также|参考|参考文献|参照|참고)\W*$", re.I)
_BULLET = re.compile(r"^(?:[-*•+]|\[?\d+[.)\]])\s+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_VARIABLE = re.compile(r"`[^`\n]*`|\b\w+\.(?:java|py|js|ts)\b|\d+")
_HASHED = re.compile(r"(?:^|\s)#\w")
_RULE = re.compile(r"[-+|: ]{5}")
_ENDING = re.compile(r"[.!?:]['\"»)]*\s*$|[.!?]\s")
_ASIAN_ITEMS = re.compile(r"[、，,|;；/·•\s]+")
_ASIAN_END = re.compile(r"[。！？]")
_ITEMS = re.compile(r"\s*(?:[,|;»•·>]|\s[-–—]\s|\s{2,})\s*")

_FUNCTION = {lang: frozenset(words.split()) for lang, words in STOPWORDS.items()}
_ANY_FUNCTION = frozenset().union(*_FUNCTION.values())


def _function_share(words: list[str], lang: str | None) -> float:
    return sum(map(_FUNCTION.get(lang or "", _ANY_FUNCTION).__contains__, words)) / len(words) if words else 0.0


def _stuffed_words(words: list[str]) -> int:
    """Words inside phrases of two to four words that come back so often that the text is about little else."""
    covered = bytearray(len(words))
    for n in (4, 3, 2):
        grams = list(zip(*(words[i:] for i in range(n))))
        # Phrases with a function word at an end are syntax and no keywords.
        often = {g for g, k in Counter(grams).items() if k >= 4 and k * n >= 0.06 * len(words) and g[0] not in _ANY_FUNCTION and g[-1] not in _ANY_FUNCTION}
        if often:
            for at, gram in enumerate(grams):
                if gram in often:
                    covered[at : at + n] = b"\x01" * n
    return sum(covered)


def _stuffing(lines: list[str]) -> float:
    """Share of the words of sentences that stand in dense phrases. A sentence said twice, or with another name or number in it, counts once."""
    said: dict[str, str] = {}
    for line in lines:
        for part in _SENTENCE.split(line):
            said.setdefault(_VARIABLE.sub("", part), part)
    told = [w for part in said.values() for w in _WORD.findall(part.lower())]
    return _stuffed_words(told) / len(told) if told else 0.0


def _asian_list(rest: str, linked: bool) -> bool:
    """Is a line of a script without blanks a link, or items in a row?"""
    if linked:
        return len(rest.strip()) < 20
    items = [i for i in _ASIAN_ITEMS.split(rest) if i]
    return len(items) >= 5 and not _ASIAN_END.search(rest) and sum(map(len, items)) <= 8 * len(items)


def features(text: str) -> tuple[str, list[float]]:
    """Language group and the features of a text; linear in its length."""
    has_url = "://" in text or "www." in text.lower()
    tags, brackets = "<" in text, "](" in text
    lines: list[tuple[str, str, str, int, list[str]]] = []
    words: list[str] = []
    link_size = separators = 0
    for line in text.split("\n"):
        body = line.strip()
        if not body:
            continue
        rest, urls = body, 0
        if has_url:
            urls = sum(map(len, _URL.findall(body)))
            link_size += urls
        if tags and "<" in body:
            rest = _TAGGED.sub(" ", _ANCHOR.sub(r"\1", body))
        if brackets and "](" in rest:
            rest = _MARKDOWN.sub(lambda m: " " + m[1] + " ", rest)
        if urls:
            rest = _URL.sub(" ", rest)
        tokens = _WORD.findall(rest.lower())
        words += tokens
        separators += rest.count(",") + rest.count("|") + rest.count("•") + rest.count("#") + rest.count(" - ") + rest.count(" – ")
        lines.append((line, body, rest, urls, tokens))
    count = Counter(words)
    lang, _ = language(text, count)
    size = max(1, len(text.strip()))
    asian = bool(_ASIAN.search(text)) and len(_ASIAN.findall(text)) > 0.2 * size
    n = max(1, len(words))
    entropy = -sum(c / n * math.log2(c / n) for c in count.values()) / max(1.0, math.log2(n)) if words else 0.0
    repetition = sum(c for c in Counter(zip(words, words[1:])).values() if c > 2) / n
    function = 0.4 if asian or lang in ("ru", "ko", "ar", "el") else _function_share(words, lang)
    known = _FUNCTION.get(lang or "", _ANY_FUNCTION).__contains__
    total = spam = sentence = 0.0
    listed = False
    said: list[str] = []
    for line, body, rest, urls, tokens in lines:
        if len(body) < 40 and _HEADING.match(body):
            listed = sentence >= 60
            continue
        if listed and _BULLET.match(body):
            continue  # the references of a text weigh neither way
        listed = False
        weight = float(len(body))
        total += weight
        if _LOG_LINE.search(body) or (("|" in body or "\t" in line or _RULE.match(body)) and _TABLE_LINE.search(line)):
            sentence += weight
            continue
        linked = bool(urls) or "href=" in body
        if asian and _ASIAN.search(rest):
            if _LABEL.match(rest) or len(_HASHED.findall(rest)) >= 3 or _asian_list(rest, linked):
                spam += weight
            else:
                sentence += weight
            continue
        if not linked and _CODE_SIGN.search(line) and _CODE_LINE.search(line) and not _LABEL.match(body) and not body.startswith("#"):
            sentence += weight
            continue
        label = _LABEL.match(rest) if ":" in rest else None
        inner = rest[label.end() :] if label else rest
        if label:
            tokens = _WORD.findall(inner.lower())
        if not tokens:
            spam += weight if linked else 0.0
            continue
        hashed = len(_HASHED.findall(inner)) if "#" in inner else 0
        if hashed >= 3 and hashed * 2 >= len(inner.split()) or label:
            spam += weight
            continue
        said.append(rest)
        share = sum(map(known, tokens)) / len(tokens)
        plain = share >= 0.17 and len(tokens) >= 5
        ends = not plain and bool(_ENDING.search(inner))
        if plain or ends and share >= 0.1 and len(tokens) >= 4:
            sentence += weight - urls
            if linked and urls > 0.6 * weight:
                spam += urls
        elif linked:
            spam += weight
        else:
            items = sum(1 for i in _ITEMS.split(inner.strip()) if i)
            mean = len(tokens) / max(1, items)
            if len(tokens) >= 3 and not ends and (share < 0.1 or mean <= 4.5 and items > 3) or items > 6 and mean <= 4 and share < 0.12:
                spam += weight
    # Without many repeated pairs no phrase can be dense among different sentences.
    stuffing = _stuffing(said) if repetition >= 0.1 else 0.0
    values = [link_size / size, function, entropy, repetition, min(2.0, separators / n), spam / max(1.0, total), stuffing]
    # Text without a language of its own (lists of keywords have none) is held against all documents.
    return "asian" if asian else lang or ALL, values


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, grp, one column per feature of the documents with text."""
    names = ["doc_id", "grp", *FEATURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, group, *values) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for group, values in [features(text)]]
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), *[pa.array(c, pa.float64()) for c in columns[2:]]], names=names)

    rows = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL AND trim(text) <> ''")
    return spread(rows).mapInArrow(run, "doc_id bigint, grp string, " + ", ".join(f"{f} double" for f in FEATURES))


Model = dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]


def robust(rows: DataFrame) -> Model:
    """Per group: centre, scale and the inverse of the robust correlation matrix, each mixed with that of all documents.

    Three aggregations, whose results are some groups (languages and scripts, a number fixed by the code) x features.
    """
    both = rows.where(F.col("grp") != ALL).unionByName(rows.withColumn("grp", F.lit(ALL)))
    per_group = lambda name: F.element_at(F.create_map(*[x for g, values in name.items() for x in (F.lit(g), F.array(*[F.lit(float(v)) for v in values]))]), F.col("grp"))
    middle = {r.grp: (r.n, np.array([r[f] for f in FEATURES])) for r in both.groupBy("grp").agg(F.count("*").alias("n"), *[F.percentile_approx(f, 0.5, 2000).alias(f) for f in FEATURES]).collect()}
    if ALL not in middle:
        return {}
    at = per_group({g: m for g, (_, m) in middle.items()})
    spread_ = both.groupBy("grp").agg(*[F.percentile_approx(F.abs(F.col(f) - at[i]), 0.5, 2000).alias(f) for i, f in enumerate(FEATURES)]).collect()
    scale = {r.grp: np.maximum(1.4826 * np.array([r[f] for f in FEATURES]), FLOOR) for r in spread_}
    by = per_group(scale)
    scored = both.select("grp", *[F.greatest(F.lit(-_CLIP), F.least(F.lit(_CLIP), (F.col(f) - at[i]) / by[i])).alias(f) for i, f in enumerate(FEATURES)])
    k = len(FEATURES)
    cross = scored.groupBy("grp").agg(*[F.avg(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"c{i}_{j}") for i in range(k) for j in range(i + 1)]).collect()
    correlation = {}
    for r in cross:
        cov = np.array([[r[f"c{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)])
        deviation = np.sqrt(np.maximum(np.diag(cov), 1e-6))
        correlation[r.grp] = cov / np.outer(deviation, deviation)
    out: Model = {}
    for g, (n, centre) in middle.items():
        own = 1.0 if g == ALL else n / (n + PRIOR)
        mixed = lambda a, b: own * a + (1 - own) * b  # noqa: B023, E731
        matrix = mixed(correlation[g], correlation[ALL]) * (1 - RIDGE) + RIDGE * np.eye(k)
        out[g] = (mixed(centre, middle[ALL][1]), mixed(scale[g], scale[ALL]), np.linalg.inv(matrix))
    return out


def judge(x: np.ndarray, groups: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance of each row to its group, and the greatest distance along a direction of spam."""
    distance, toward = np.zeros(len(x)), np.zeros(len(x))
    for g in set(groups):
        centre, scale, inverse = model.get(g, model[ALL])
        mine = groups == g
        z = (x[mine] - centre) / scale
        distance[mine] = np.einsum("ij,jk,ik->i", z, inverse, z)
        along = z @ inverse @ DIRECTIONS.T / np.sqrt(np.einsum("dj,jk,dk->d", DIRECTIONS, inverse, DIRECTIONS))
        toward[mine] = along.max(axis=1)
    return distance, toward


def scored(documents: DataFrame) -> DataFrame:
    """doc_id, distance (squared), toward (along the nearest direction of spam) of the documents with text."""
    rows = cut(measured(documents), "spam-features")
    held = rows.sparkSession.sparkContext.broadcast(robust(rows))  # some groups x 63 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(len(FEATURES))])
            distance, toward = judge(x, np.array(batch.column(1).to_pylist(), dtype=object), held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(distance), pa.array(toward)], names=["doc_id", "distance", "toward"])

    return rows.mapInArrow(run, "doc_id bigint, distance double, toward double")


def spam(documents: DataFrame) -> DataFrame:
    """doc_id, distance, toward of the outliers that lie in a direction of spam."""
    return scored(documents).where((F.col("distance") > DISTANCE) & (F.col("toward") >= TOWARD))
