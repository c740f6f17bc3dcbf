"""Texts cut off before their end, found by word trigrams, in pure SQL.

Every text is split into lines and words; identifiers, numbers and quoted names are folded so that
trigrams repeat. Over all texts each trigram is counted inside lines and at ends of lines. The trigram a
text ends with is then joined to these counts:

    * frequent inside and almost never an end: the text stops where others go on;
    * hardly known at all: its last word is not one that anything ends with, perhaps half a word;
    * an ending that others share: whole, whatever comes before.

Each distinct text counts once, and the counts are those of the other texts: a text's own ending is taken out.
Texts of the first kind are cut, unless they end with a mark of a whole sentence, fence or JSON value, which often
go on. Those of the second are suspects, for which an exact check follows: a bracket still open, or no mark that
ends a sentence or line. A sign left behind, an open literal, fence or JSON value makes any text a cut one, shared
ending or not.

Defined cases: null, empty and blank texts, and texts without a letter or digit, have no end to lose; a
snippet of whole lines is complete though its block is open; trailing white space is no part of the end;
rows delivered twice count once, and so do texts under many ids; a bare or labelled status code and a word for
nothing are whole replies; very long texts are split like any other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from siftwell.storage import cut

#: A trigram is an ending if it ends lines of other texts this often, absolutely and against its uses inside lines.
LEAST_ENDS, LEAST_SHARE = 2, 0.12
#: ... and against whatever follows the same two words: half a word is rare beside its whole.
LEAST_OF_CONTEXT = 0.08
#: A trigram is frequent inside lines from so many uses on, and almost never an end below this share of them.
FREQUENT, MOST_ENDS = 8, 0.02

#: No pattern crosses white space: folding a text and folding its words is the same.
_FOLD = (
    (r"`[^`\s]*`", "`x`"),
    (r"0x[0-9a-fA-F]+|\d+(?:\.\d+)*", "0"),
    (r"\b(?:[a-z]+[A-Z]|[A-Z][a-z0-9]+[A-Z]|[A-Za-z0-9]+_)\w*", "aB"),
)
_STRINGS = r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`[^`]*`'
_SIGN = r"(?:[^.\s]\.\.\.|…|\x{FFFD}|[\[(<]\s*(?:\.\.\.|…)?\s*(?:truncated|cut|cut off|snip|snipped|shortened|gekürzt|abgeschnitten|tronqué|truncado|continued|more|omitted)\b[^\])>\n]{0,30}[\])>])$"


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _folded(column: str) -> str:
    for pattern, name in _FOLD:
        column = f"regexp_replace({column}, {_lit(pattern)}, {_lit(name)})"
    return column


def _sql(query: str, **frames: DataFrame) -> DataFrame:
    """``query`` with frames in place of ``:name:``. (The formatter of ``spark.sql`` would take the braces of patterns.)"""
    spark = next(iter(frames.values())).sparkSession
    views = {name: f"siftwell_{name}_{uuid.uuid4().hex}" for name in frames}
    for name, frame in frames.items():
        frame.createOrReplaceTempView(views[name])
        query = query.replace(f":{name}:", views[name])
    try:
        return spark.sql(query)
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def _count(text: str, pattern: str) -> str:
    return f"regexp_count({text}, {_lit(pattern)})"


#: Whole replies that are no sentence.
_VALUE = r"^(?:[\p{L} ]+: *)?(?:\d{4}|(?i:null|none|nil|undefined|n/?a))$"

_SENTENCE = r"[.!?。！？][)\]}»”\"'`*]*$"
#: The decision by the counts alone.
_DEALT = f"inside >= {FREQUENT} AND others <= {MOST_ENDS} * inside"

#: The exact check, over the columns text (right-trimmed), last (its last line), inside, others (ends of lines of
#: other texts), shared (an ending that others share). Only literals that may not span lines are looked at in shared ones.
_CHECKS = f"""
WITH stripped AS (
  SELECT *, regexp_replace(last, {_lit(_STRINGS + r"|/\*.*?\*/|//[^\n]*$|(?<![\w'\"])#[^\n{{}}]*$|(?<=[=(,:])\s*/(?:[^/\\\n]|\\.)+/[a-z]*")}, 'S') AS bare,
         regexp_replace(text, {_lit(r'"(?:[^"\\]|\\.)*"')}, 'S') AS bare_json
  FROM :finals:
)
SELECT origin, row_id FROM stripped
WHERE text RLIKE {_lit(_SIGN)}
   OR CASE
        WHEN origin = 'response' THEN
          CASE
            WHEN {_count("text", "(?m)^(?:> ?)?```")} % 2 = 1 THEN true
            WHEN text RLIKE {_lit(r"^\s*(?:```\w*\s*)?[{\[]")} THEN
              bare_json LIKE '%"%'
              OR {_count("bare_json", "[{]")} <> {_count("bare_json", "[}]")}
              OR {_count("bare_json", "[\\[]")} <> {_count("bare_json", "[\\]]")}
            WHEN shared OR text RLIKE {_lit(_VALUE)} THEN false
            WHEN {_DEALT} AND NOT text RLIKE {_lit(_SENTENCE)} AND NOT text RLIKE '```$' THEN true
            ELSE NOT text RLIKE {_lit(r"[.!?:;。！？)\]}»”\"'`*>|]$")}
          END
        WHEN shared THEN bare RLIKE {_lit(r"(?<!S)\"|(?<![A-Za-zS'])'(?!')")}
        ELSE
          bare RLIKE {_lit(r'["`]')}
          OR bare RLIKE {_lit(r"(?<![A-Za-z])'")}
          OR (text RLIKE {_lit(r"/\*(?:(?!\*/).)*$")})
          OR ({_DEALT})
          OR (NOT bare RLIKE {_lit(r"[;{}()\[\],:\\+=>*/&|?S]\s*$")})
          OR (NOT last RLIKE {_lit(r"[;{(\[,:\\+&|]$")} AND ({_count("bare", "[(]")} > {_count("bare", "[)]")} OR {_count("bare", "[\\[]")} > {_count("bare", "[\\]]")}))
          OR (length(last) > 160 AND ({_count("bare", "[(]")} > {_count("bare", "[)]")} OR {_count("bare", "[{]")} > {_count("bare", "[}]")} OR {_count("bare", "[\\[]")} > {_count("bare", "[\\]]")}))
      END
"""


def truncated(texts: DataFrame) -> DataFrame:
    """origin, row_id of the cut rows of ``texts`` (origin, row_id, text)."""
    words = _sql(
        f"""
        SELECT origin, row_id, regexp_replace(text, {_lit(r"\s+$")}, '') AS text FROM :texts: WHERE text RLIKE {_lit(r"[\p{L}\p{N}]")}
        """,
        texts=texts,
    )
    distinct = _sql("SELECT DISTINCT origin, text FROM :words:", words=words)
    # A trigram is three words of a line, with ^ before its first; its hash stands for it in shuffles.
    # Written once: the counts are read twice.
    grams = _sql(
        f"""
        SELECT gram, any_value(context) AS context, count_if(last) AS ends, count_if(NOT last) AS inside FROM (
          SELECT xxhash64(context, w[i]) AS gram, context, i = size(w) - 1 AS last
          FROM (SELECT w, i, xxhash64(origin, if(i >= 2, w[i - 2], '^'), if(i >= 1, w[i - 1], '^')) AS context
                FROM (SELECT origin, w, explode(sequence(0, size(w) - 1)) AS i
                      FROM (SELECT origin, split(trim(line), '\\\\s+') AS w FROM (SELECT origin, explode(split({_folded("text")}, '\\\\n')) AS line FROM :distinct:) WHERE trim(line) <> ''))))
        GROUP BY gram
        """,
        distinct=distinct,
    )
    grams = cut(grams, "trigrams")
    contexts = _sql("SELECT context, sum(ends + inside) AS uses FROM :grams: GROUP BY context", grams=grams)
    finals = _sql(
        f"""
        SELECT origin, row_id, text, last, alone, xxhash64(context, w1) AS gram, context FROM (
          SELECT origin, row_id, text, last, n = 1 AND last = text AS alone, w[size(w) - 1] AS w1,
                 xxhash64(origin, if(n >= 3, w[size(w) - 3], '^'), if(n >= 2, w[size(w) - 2], '^')) AS context
          FROM (SELECT origin, row_id, text, last, size(raw) AS n, transform(slice(raw, greatest(1, size(raw) - 2), 3), v -> {_folded("v")}) AS w
                FROM (SELECT *, split(trim(last), '\\\\s+') AS raw FROM (SELECT *, element_at(split(text, '\\\\n'), -1) AS last FROM :words:))))
        """,
        words=words,
    )
    # The counts are joined to the distinct final trigrams first, without texts: few rows, and none is hot.
    # Every text has ended once with its final trigram, which is taken out.
    counts = _sql(
        """
        SELECT d.gram, d.context, greatest(coalesce(g.ends, 0) - 1, 0) AS others, coalesce(g.inside, 0) AS inside, greatest(coalesce(c.uses, 0) - 1, 0) AS uses
        FROM (SELECT DISTINCT gram, context FROM :finals:) d LEFT JOIN :grams: g ON d.gram = g.gram LEFT JOIN :contexts: c ON d.context = c.context
        """,
        finals=finals,
        grams=grams,
        contexts=contexts,
    )
    finals = _sql(
        f"""
        SELECT f.origin, f.row_id, f.text, f.last, c.inside, c.others,
               c.others >= {LEAST_ENDS} AND c.others >= {LEAST_SHARE} * (c.others + c.inside) AND (f.alone OR c.others >= {LEAST_OF_CONTEXT} * c.uses) AS shared
        FROM :finals: f JOIN :counts: c ON f.gram = c.gram
        """,
        finals=finals,
        counts=counts,
    )
    return _sql(_CHECKS, finals=finals).distinct()


def texts_of(responses: DataFrame, findings: DataFrame) -> DataFrame:
    """origin, row_id, text of both tables."""
    one = responses.selectExpr("'response' AS origin", "CAST(response_id AS BIGINT) AS row_id", "CAST(content AS STRING) AS text")
    return one.unionByName(findings.selectExpr("'finding' AS origin", "CAST(finding_no AS BIGINT) AS row_id", "CAST(code_snippet AS STRING) AS text"))


def rates(found: DataFrame, responses: DataFrame, findings: DataFrame) -> DataFrame:
    """origin, deliverer (model or feed), rows, cut, share: how often each delivers a cut text; each key counts once."""
    return _sql(
        """
        SELECT o.origin, o.deliverer, count(*) AS rows, count(f.row_id) AS cut, count(f.row_id) / count(*) AS share
        FROM (SELECT DISTINCT 'response' AS origin, CAST(response_id AS BIGINT) AS row_id, model AS deliverer FROM :responses:
              UNION ALL SELECT DISTINCT 'finding', CAST(finding_no AS BIGINT), feed FROM :findings:) o
        LEFT JOIN :found: f ON o.origin = f.origin AND o.row_id = f.row_id
        GROUP BY o.origin, o.deliverer
        """,
        found=found, responses=responses, findings=findings,
    )
