"""Credentials in code and configuration: found, placed and masked.

1. A keyword automaton over the case-folded text leaves most texts after one pass.
2. Issuer formats, connection strings, authorization headers, key blocks, and literals that a secret's
   name is given or compared with are looked for only in the texts that are left.
3. Structure is validated: a web token's header must be JSON with an algorithm, a Basic value must decode
   to user:password, a GitHub token's length and alphabet must fit, and so on. Fill-in and masked values,
   references to values held elsewhere, public keys, certificates, checksums and ids are no credentials.
4. Every letter of the secret becomes ``x`` or ``X`` (``a`` or ``A`` in hexadecimal), every digit ``0`` (``2`` in base
   32); other characters stay, hence length, alphabet, quoting and line structure stay too and masked text is
   found clean again.

Defined cases: null text gives no rows and comes back null; empty text comes back empty; a value split
over several literals is one credential that begins in its first part; rows delivered twice count once;
very long texts are processed whole, with a number of passes that does not depend on their length.
"""

from __future__ import annotations

import base64
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.automata import KeywordAutomaton
from siftwell.storage import spread

# Words without which no rule below can match (case folded).
KEYWORDS = (
    "pass", "pwd", "pw", "pin", "secret", "token", "key", "auth", "credential", "bearer", "basic", "private key", "://", "connect", "login",
    "account", "user", "-u ", "-u=", "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "sk-", "sk_live_", "rk_live_", "aiza", "eyj", "npm_", "pypi-", "sg.", "hooks.slack",
)

# Published token formats of issuers.
_ISSUER = re.compile(
    r"(?<![A-Za-z0-9_\-/+])(?:"
    r"(?P<aws>A(?:KIA|SIA)[A-Z0-9]{16})"
    r"|(?P<github>gh[pousr]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{22,255})"
    r"|(?P<gitlab>glpat-[A-Za-z0-9_\-]{20,64})"
    r"|(?P<slack>xox[abeprs]-[A-Za-z0-9\-]{20,250})"
    r"|(?P<stripe>[sr]k_live_[A-Za-z0-9]{16,99})"
    r"|(?P<openai>sk-(?:[a-z]+-)?[A-Za-z0-9_\-]{20,200})"
    r"|(?P<google>AIza[A-Za-z0-9_\-]{35})"
    r"|(?P<npm>npm_[A-Za-z0-9]{36})"
    r"|(?P<sendgrid>SG\.[A-Za-z0-9_\-]{16,32}\.[A-Za-z0-9_\-]{16,64})"
    r"|(?P<jwt>eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-=]{8,}\.[A-Za-z0-9_\-]{8,})"
    r")(?![A-Za-z0-9_\-])"
)
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?P<body>.*?)(?:-----END|\.\.\.|[\"'`<]|\Z)", re.S)
_PUBLIC = re.compile(r"-----BEGIN (?:CERTIFICATE|[A-Z ]*PUBLIC KEY)[^-]*-----.*?(?:-----END[^-]*-----|\Z)", re.S)
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://(?P<user>[^\s:/@\"'`<>]*):(?P<value>[^\s@/\"'`<>]+)@[A-Za-z0-9\[]")
_HEADER = re.compile(r"(?i)\b(?P<scheme>basic|bearer)\s+(?P<value>[A-Za-z0-9+/=_\-.~]{8,})")
_NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*"
_STRING = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n$]*`"
_LINE_NO = r"(?:[ \t]*\d+[:|][ \t]?)?"
#: name = "literal" in code, JSON, YAML, with the literal perhaps on later lines and in several parts.
_GIVEN = re.compile(
    rf"(?P<name>{_NAME})[\"']?\]?(?:[ \t]*:[ \t]*[A-Za-z][\w<>\[\]. |]*)?[ \t]*(?::=|=>|={{1,3}}|:)[ \t]*\(?[ \t]*(?:\r?\n{_LINE_NO}[ \t]*)?"
    rf"[rbuRBU]?(?P<value>(?:{_STRING})(?:[ \t]*(?:[+.\\][ \t]*)?\r?\n{_LINE_NO}[ \t]*(?:[+.][ \t]*)?(?:{_STRING}))*)"
)
_COMPARED = re.compile(rf"(?P<value>{_STRING})\s*(?:={{2,3}}|!={{1,2}}|\.equals\(|,)\s*(?P<name>{_NAME})")
_EQUALS = re.compile(rf"(?P<name>{_NAME})(?:\.equals\(|\s*!={{1,2}}\s*)(?P<value>{_STRING})")
_XML = re.compile(rf"<(?:\w+\s+(?:key|name)=[\"'](?P<key>{_NAME})[\"']|(?P<tag>{_NAME}))[^<>]*>(?P<value>[^<>\n]+)</")
_XML_ATTR = re.compile(rf"(?:key|name)=[\"'](?P<name>{_NAME})[\"']\s+value=(?P<value>\"[^\"\n]*\"|'[^'\n]*')")
#: name=value, name: value without quotes, as in environment, properties, INI, YAML and container files.
_BARE = re.compile(rf"(?m)^{_LINE_NO}[ \t]*(?:export[ \t]+|ENV[ \t]+|ARG[ \t]+|set[ \t]+|-[ \t]+|#[ \t]*|//[ \t]*)?(?P<name>{_NAME})(?:[ \t]*[=:][ \t]*|[ \t]+(?=\S+[ \t]*$))(?P<value>[^\s\"'`<>(){{}}\[\],;]+)[ \t]*(?:[;#].*)?\r?$")
_CALL = re.compile(rf"(?i)\b\w*(?:connect|login|authenticate|credentials?|basic_?auth)\w*\(\s*(?P<args>(?:(?:{_STRING})\s*,\s*)+(?:{_STRING}))")
#: In comments and other prose: the name, at most a word or sign, then the value.
_TALK = re.compile(rf"(?i)(?<![\w.])(?P<name>[a-z_]*(?:password|passwd|passphrase|pwd|_pw|_pass|secret|token|api_?key|[a-z]_?key)(?![a-z]))(?:\s*[:=]\s*|\s+is\s+|\s+)(?P<value>[^\s\"'`,;<>(){{}}]{{8,}})")
#: user / value and user:value after words for an account, and on command lines.
_LOGIN = re.compile(r"(?i)\b(?:login|credentials?|account|user(?:name)?)\b[^\n/:]{0,40}?[\w.@\-]+\s*[/:]\s*(?P<value>[^\s\"'`,;<>(){}]{8,})")
_COMMAND = re.compile(r"(?:^|\s)(?:-u|--user|--proxy-user)[ =][\"']?[\w.@\-]+:(?P<value>[^\s\"'`@]{4,})")
_COMMENT = re.compile(r"(?m)(?://|#|/\*|^\s*\*|<!--|--)[^\n]*")

# Parts of names.
_SECRET_LAST = {"password", "passwd", "passphrase", "pwd", "pass", "pw", "secret", "secrets", "token", "apikey", "credential", "credentials", "passcode", "pin"}
_KEY_BEFORE = {"api", "secret", "signing", "sign", "encryption", "private", "access", "auth", "master", "service", "account", "shared", "hmac", "jwt", "crypto", "aes", "session", "storage", "license", "app", "client"}
_NOT_BEFORE = {"page", "next", "csrf", "xsrf", "cursor", "continuation", "count", "max", "min", "num", "public", "has", "is", "forgot", "reset", "show", "hide", "sort", "cache", "primary", "foreign", "token", "syntax", "lexer", "bypass"}
_PLACEHOLDER = re.compile(
    r"(?i)^(?:[x*.\-_#?•0]+|x+[\w\-]*x+|\*.*|.*\*{3,}.*|<.*>?|.*\$\{.*|.*\{\{.*|\$\(.*|\$[A-Z_][A-Z0-9_]*|%[\w()]*[sd]|%\w+%|\{\w*\}.*|\[.*\]|.*\bredacted\b.*|.*\bmasked\b.*|null|none|nil|undefined|true|false|yes|no|empty|todo|tbd|n/a"
    r"|change[_\-]?(?:me|it)|replace[_\-]?.*|your[_\-].*|set[_\-]?me|fill[_\-]?.*|insert[_\-]?.*|example.*|dummy.*|sample.*|placeholder.*|test|foo|bar|baz|secret|password|passwd|token|hidden|removed|abc123|123456|example[_\-]?.*)$"
)
_ELSEWHERE = re.compile(r"(?i)^(?:vault|env|ssm|secretsmanager|keyring|kms|file|arn|aws|gcp|azure|sm|op|ref|secret|keychain|config)[:/].*|^@\w+.*|^/.*|^\.{1,2}/.*|^~/.*|^[A-Za-z]:\\.*|^\w+://[^@]*$|^projects/.*")
_IDENTIFIER = re.compile(r"^[A-Za-z_$][\w$]*(?:(?:\.|->|::)[A-Za-z_$][\w$]*)*;?$")
#: Names whose words are not set apart, such as DBPASSWORD.
_JOINED = re.compile(r"(?P<before>[a-z]*?)(?P<last>password|passwd|passphrase|apikey|secret|token|(?<=secret)key|(?<=signing)key|(?<=private)key|(?<=access)key|(?<=auth)key|(?<=encryption)key)")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


class Span(NamedTuple):
    start: int  # of the secret value, for a key block of its opening line
    end: int
    pieces: tuple[tuple[int, int], ...]  # what is masked
    kind: str


def secret_name(name: str) -> bool:
    """Does a variable, member or key of this name hold a secret itself?"""
    parts = [p.lower() for p in _PARTS.findall(name.rsplit(".", 1)[-1])]
    if parts and parts[-1].isdigit():
        parts.pop()
    if not parts:
        return False
    last, before = parts[-1], parts[-2] if len(parts) > 1 else ""
    joined = _JOINED.fullmatch(last)
    if joined:
        before, last = joined["before"] or before, joined["last"]
    if before in _NOT_BEFORE or parts[0] in ("is", "has", "no", "use", "show", "public"):
        return False
    if last == "key":
        return before in _KEY_BEFORE
    return last in _SECRET_LAST


def _fill_in(value: str) -> bool:
    bare = value.strip()
    return not bare or bool(_PLACEHOLDER.match(bare)) or len(set(bare.lower())) <= 2 or bool(re.fullmatch(r"[x0\W_]+|[x2]+=*", bare.lower()))


def secret_value(value: str, quoted: bool = True) -> bool:
    """Could the literal grant access? Not when it is fill-in, masked, or says where the value is held."""
    bare = value.strip()
    if len(bare) < 4 or _fill_in(bare) or _ELSEWHERE.match(bare) or re.search(r"\s", bare) or "{" in bare or "%s" in bare:
        return False
    if bare[-1] in "…" or bare.endswith("..."):
        bare = bare.rstrip(".…")
    if re.fullmatch(r"\d+(?:\.\d+)*", bare) and len(bare) < 8:
        return False
    if not quoted and (_IDENTIFIER.match(bare) and not re.search(r"\d", bare) or bare.endswith(("{", ","))):
        return False
    # An identifier, a field's name or a word list: no digit and no mixed case.
    return not re.fullmatch(r"[a-z]+(?:[_\-.:/][a-z]+)*|[A-Z]+(?:_[A-Z]+)*", bare) or (len(bare) >= 20 and not re.search(r"[_\-.:/]", bare))


def _strong(value: str) -> bool:
    """Of values in prose more is asked: letters and digits, no date, path, version, call or file name."""
    return (
        secret_value(value, quoted=False)
        and bool(re.search(r"[A-Za-z]", value) and re.search(r"\d", value))
        and not re.fullmatch(r"v?\d+(?:[.\-:]\w+)*|\w+\.(?:java|py|js|ts|md|txt|ya?ml|json)|[a-z]+\d{1,2}|\w+\(.*", value)
    )


def _web_token(token: str) -> bool:
    head = token.split(".")[0]
    try:
        parsed = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
        return isinstance(parsed, dict) and ("alg" in parsed or "typ" in parsed)
    except (ValueError, UnicodeDecodeError):
        return False


def _basic(value: str) -> bool:
    try:
        user, colon, password = base64.b64decode(value + "=" * (-len(value) % 4)).decode("utf-8").partition(":")
        return bool(colon) and secret_value(password)
    except (ValueError, UnicodeDecodeError):
        return False


def _pieces(value: str, start: int) -> list[tuple[int, int]]:
    """The insides of the literals of a value."""
    return [(start + m.start() + 1, start + m.end() - 1) for m in re.finditer(_STRING, value) if m.end() - m.start() > 2]


class _Intervals:
    """Disjoint intervals in order."""

    def __init__(self) -> None:
        self._starts: list[int] = []
        self._ends: list[int] = []

    def add(self, start: int, end: int) -> bool:
        """Take an interval, unless it meets one that is taken."""
        at = bisect_left(self._starts, end)
        if at and self._ends[at - 1] > start:
            return False
        self._starts.insert(at, start)
        self._ends.insert(at, end)
        return True


class Finder:
    """``find(text)``: the credentials of a text, by place, overlaps resolved in favour of the earlier rule."""

    def __init__(self) -> None:
        self._keywords = KeywordAutomaton(KEYWORDS)

    def find(self, text: str) -> list[Span]:
        if not text or not self._keywords.any(text.lower()):
            return []
        spans: list[Span] = []
        taken = _Intervals()

        def add(start: int, end: int, pieces: list[tuple[int, int]], kind: str) -> None:
            if pieces and taken.add(start, end):
                spans.append(Span(start, end, tuple(pieces), kind))

        for m in _PEM.finditer(text):
            body = re.sub(r"\\[nr]|\s", "", m["body"])
            if len(body) >= 16 and not _fill_in(body) and re.match(r"[A-Za-z0-9+/=:,\-]+$", body):
                add(m.start(), m.end(), [(m.start("body"), m.end("body"))], "private_key")
        for m in _PUBLIC.finditer(text):
            taken.add(*m.span())
        if "://" in text:
            for m in _URL.finditer(text):
                if secret_value(m["value"]) or (not _fill_in(m["value"]) and re.fullmatch(r"[\w.%!#\-]{6,}", m["value"]) and not m["value"].startswith("{")):
                    add(m.start("value"), m.end("value"), [m.span("value")], "url")
        for m in _HEADER.finditer(text):
            value = m["value"]
            if m["scheme"].lower() == "basic" and _basic(value):
                add(m.start("value"), m.end("value"), [m.span("value")], "basic")
            elif m["scheme"].lower() == "bearer" and len(value) >= 16 and secret_value(value) and re.search(r"\d", value):
                add(m.start("value"), m.end("value"), [m.span("value")], "bearer")
        for rule in (_GIVEN, _COMPARED, _EQUALS):
            for m in rule.finditer(text):
                if secret_name(m["name"]):
                    pieces = _pieces(m["value"], m.start("value"))
                    value = "".join(text[a:b] for a, b in pieces)
                    if rule is not _COMPARED or m[0][len(m["value"]) :].lstrip()[:1] != ",":
                        if secret_value(value):
                            add(pieces[0][0], pieces[-1][1], pieces, "literal")
        for m in _ISSUER.finditer(text):
            if not _fill_in(m[0].split("-", 1)[-1].split("_", 1)[-1]) and (m.lastgroup != "jwt" or _web_token(m[0])) and "EXAMPLE" not in m[0]:
                add(m.start(), m.end(), [m.span()], m.lastgroup)
        for m in _CALL.finditer(text):
            args = [(m.start("args") + s.start() + 1, m.start("args") + s.end() - 1) for s in re.finditer(_STRING, m["args"])]
            if len(args) >= 2 and secret_value(text[slice(*args[-1])]) and re.search(r"[\d!#%$]", text[slice(*args[-1])]):
                add(*args[-1], [args[-1]], "argument")
        if "</" in text:
            for m in _XML.finditer(text):
                if secret_name(m["key"] or m["tag"]) and secret_value(m["value"]):
                    add(m.start("value"), m.end("value"), [m.span("value")], "element")
        if "value=" in text:
            for m in _XML_ATTR.finditer(text):
                if secret_name(m["name"]) and secret_value(m["value"][1:-1]):
                    add(m.start("value") + 1, m.end("value") - 1, [(m.start("value") + 1, m.end("value") - 1)], "attribute")
        for m in _BARE.finditer(text):
            if secret_name(m["name"]) and secret_value(m["value"], quoted=False):
                add(m.start("value"), m.end("value"), [m.span("value")], "setting")
        for m in _COMMAND.finditer(text):
            if secret_value(m["value"]):
                add(m.start("value"), m.end("value"), [m.span("value")], "command")
        for c in _COMMENT.finditer(text):
            for m in (*_TALK.finditer(c[0]), *_LOGIN.finditer(c[0])):
                value = m["value"] if re.search(r"\d!$", m["value"]) else m["value"].rstrip(".:!?*/")
                if _strong(value):
                    at = c.start() + m.start("value")
                    add(at, at + len(value), [(at, at + len(value))], "comment")
        return sorted(spans)


def mask(text: str, spans: list[Span]) -> str:
    """The text with the pieces of the spans masked: the same length, and no sign outside the alphabet of the value."""
    out, at = [], 0
    for a, b, fill in sorted((a, b, fill) for s in spans for fill in [_alphabet("".join(text[x:y] for x, y in s.pieces))] for a, b in s.pieces):
        out.append(text[at:a])
        out.append(_ESCAPE_OR_SIGN.sub(lambda m: m[0] if m[0][0] == "\\" else fill[0] if m[0].isdigit() else fill[1] if m[0].isupper() else fill[2], text[a:b]))
        at = b
    return "".join(out) + text[at:]


#: Escapes such as \\n keep their letter.
_ESCAPE_OR_SIGN = re.compile(r"\\.|[^\W\d_]|\d")


_BASE32 = re.compile(r"(?:[A-Z2-7]{16,}|[a-z2-7]{16,})=*$")


def _alphabet(value: str) -> str:
    """What stands for a digit, a capital and a small letter of a value: 0Aa in hexadecimal, 2 for digits in base 32, else 0Xx."""
    signs = {m for m in _ESCAPE_OR_SIGN.findall(value) if m[0] != "\\"}
    letters, digits = {c for c in signs if not c.isdigit()}, {c for c in signs if c.isdigit()}
    if letters <= set("abcdefABCDEF"):
        return "0Aa"
    return ("2" if digits and _BASE32.match(value) else "0") + "Xx"


_finder: list[Finder] = []


def _shared_finder() -> Finder:
    if not _finder:
        _finder.append(Finder())
    return _finder[0]


def texts(findings: DataFrame, tool_results: DataFrame) -> DataFrame:
    """origin, row_id, text of both tables."""
    one = findings.select(F.lit("finding").alias("origin"), F.col("finding_no").cast("bigint").alias("row_id"), F.col("code_snippet").cast("string").alias("text"))
    two = tool_results.select(F.lit("tool_result").alias("origin"), F.col("tool_result_id").cast("bigint").alias("row_id"), F.col("content").cast("string").alias("text"))
    return one.unionByName(two)


def _lines(text: str, spans: list[Span]) -> Iterator[tuple[Span, int]]:
    """Spans in order with the numbers of the lines they begin on, counted in one pass."""
    line, at = 1, 0
    for span in spans:
        line += text.count("\n", at, span.start)
        at = span.start
        yield span, line


def locate(rows: DataFrame) -> DataFrame:
    """origin, row_id, line_no, kind: one row per credential of the rows of ``texts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _shared_finder().find
        for batch in batches:
            origin, ids, content = (batch.column(i).to_pylist() for i in range(3))
            out = [(o, i, line, s.start, s.kind) for o, i, text in zip(origin, ids, content) if text for s, line in _lines(text, find(text))]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                    names=["origin", "row_id", "line_no", "start", "kind"],
                )

    found = spread(rows).mapInArrow(run, "origin string, row_id bigint, line_no bigint, start bigint, kind string")
    return found.dropDuplicates(["origin", "row_id", "start"]).select("origin", "row_id", "line_no", "kind")


def redact(rows: DataFrame) -> DataFrame:
    """origin, row_id, text with the credentials masked and all else unchanged; one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _shared_finder().find
        for batch in batches:
            masked = [mask(t, s) if t and (s := find(t)) else t for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masked, pa.string())], names=["origin", "row_id", "text"])

    return spread(rows).mapInArrow(run, "origin string, row_id bigint, text string")
