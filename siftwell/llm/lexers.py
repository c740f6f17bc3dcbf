"""Tokens of Java, Python and ECMAScript/TypeScript; None where a text has a lexical error."""

from __future__ import annotations

import re

_NUMBER = r"0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*[nlL]?|0[bB][01](?:_?[01])*[nlL]?|0[oO][0-7](?:_?[0-7])*n?|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJnlLfFdD]?"
_BLANK = r"[ \t\f\r\n\uFEFF]+"

# Reserved words of the languages.
JAVA_WORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split()
)
JAVA_SOFT = frozenset("record sealed permits when non yield".split())
PYTHON_WORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
SCRIPT_WORDS = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)

_JAVA = re.compile(
    rf"(?P<skip>{_BLANK}|//[^\n]*|/\*.*?\*/)"
    r'|(?P<text>"""[ \t\f]*\r?\n(?:[^\\]|\\.)*?"""|"(?:[^"\\\r\n]|\\.)*")'
    r"|(?P<char>'(?:[^'\\\r\n]|\\(?:[btnfrs0\"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4}))')"
    rf"|(?P<number>{_NUMBER})|(?P<word>[^\W\d][\w$]*|\$[\w$]*)"
    r"|(?P<op>\.\.\.|->|::|\+\+|--|&&|\|\||<<=|==|!=|<=|>=|\+=|-=|\*=|/=|&=|\|=|\^=|%=|<<|[-+*/%&|^!~?:;,.<>=()\[\]{}@])",
    re.S,
)


#: An integer that begins with 0 is octal.
_OCTAL = re.compile(r"0[\d_]+[lL]?$")


def java(text: str) -> list[tuple[str, bool]] | None:
    out, at, size = [], 0, len(text)
    while at < size:
        m = _JAVA.match(text, at)
        if m is None:
            return None
        kind, value, at = m.lastgroup, m[0], m.end()
        if kind == "skip":
            continue
        if kind == "word":
            out.append((value if value in JAVA_WORDS or value in JAVA_SOFT else "NAME", False))
        elif kind == "op":
            # Of >> and >>> each sign stands alone, marked where the next one touches it: generics close with them.
            out.append((">a" if value == ">" and text[at : at + 1] == ">" else value, False))
            if value == ">" and text.startswith(">=", at):
                out[-1] = (">a", False)
        else:
            if kind == "number" and (at < size and (text[at].isalnum() or text[at] in "_$") or _OCTAL.match(value) and ("8" in value or "9" in value)):
                return None
            out.append(("LIT", False))
    return out


_PY_STRING = re.compile(r"(?i)(?:[rub]|br|rb|f|fr|rf|t|tr|rt)?(?:'''(?:[^\\]|\\.)*?'''|\"\"\"(?:[^\\]|\\.)*?\"\"\"|'(?:[^'\\\r\n]|\\(?:\r\n|.))*'|\"(?:[^\"\\\r\n]|\\(?:\r\n|.))*\")", re.S)
_PY_TOKEN = re.compile(rf"(?P<skip>[ \t\f]+|#[^\r\n]*|\\\r?\n)|(?P<line>\r?\n|\r)|(?P<number>{_NUMBER})|(?P<word>[^\W\d]\w*)|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|\*\*|//|>>|<<|:=|->|==|!=|<=|>=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|[-+*/%@&|^~<>=()\[\]{{}},:;.!])")
_PY_SOFT = frozenset(("match", "case", "type", "_"))


def python(text: str) -> list[tuple[str, bool]] | None:
    out: list[tuple[str, bool]] = []
    indents, depth, at, size = [0], [], 0, len(text)
    fresh = True  # at the beginning of a logical line
    while at < size:
        if fresh and not depth:
            m = re.compile(r"[ \t\f]*").match(text, at)
            lead = m[0].rpartition("\f")[2]
            width, other = len(lead.expandtabs(8)), len(lead.expandtabs(1))
            at = m.end()
            if at < size and text[at] in "#\r\n":
                end = text.find("\n", at)
                at = size if end < 0 else end + 1
                continue
            if at >= size:
                break
            if text[at] == "\\" and re.compile(r"\\\r?\n").match(text, at):
                fresh = False
            if width > indents[-1]:
                indents.append(width)
                out.append(("INDENT", False))
            while width < indents[-1]:
                indents.pop()
                out.append(("DEDENT", False))
            if width != indents[-1] or other > width:
                return None
            fresh = False
        m = _PY_STRING.match(text, at)
        if m:
            at = m.end()
            if m[0][0] in "fFtT" or m[0][1:2] in ("f", "F", "t", "T") and m[0][0] in "rR":
                if not _braces(m[0]):
                    return None
            out.append(("STR", False))
            continue
        m = _PY_TOKEN.match(text, at)
        if m is None:
            return None
        kind, value, at = m.lastgroup, m[0], m.end()
        if kind == "skip":
            continue
        if kind == "line":
            if not depth:
                out.append(("NEWLINE", False))
                fresh = True
        elif kind == "number":
            if at < size and (text[at].isalnum() or text[at] == "_") and not re.compile(r"(?:and|or|if|else|in|is|for)\b").match(text, at):
                return None
            if value[-1] in "nlLfFdD" and not value.lower().startswith("0x") or re.fullmatch(r"0\d+", value) and value.strip("0"):
                return None
            out.append(("NUM", False))
        elif kind == "word":
            out.append((value if value in PYTHON_WORDS or value in _PY_SOFT and value != "_" else "NAME", False))
        else:
            if value in "([{":
                depth.append(value)
            elif value in ")]}":
                if not depth or "([{".index(depth.pop()) != ")]}".index(value):
                    return None
            out.append((value, False))
    if depth:
        return None
    if out and out[-1][0] not in ("NEWLINE", "DEDENT"):
        out.append(("NEWLINE", False))
    out += [("DEDENT", False)] * (len(indents) - 1)
    return out


def _braces(literal: str) -> bool:
    """Replacement fields of a formatted string open and close."""
    body, depth = literal.replace("{{", "").replace("}}", ""), 0
    if depth == 0 and "{" not in body and "}" not in body:
        return True
    for c in literal.replace("{{", "  ") if "}}}" in literal or "{{{" in literal else body:
        depth += (c == "{") - (c == "}")
        if depth < 0:
            return "}}" in literal
    return depth == 0 or "{{" in literal or "}}" in literal


_SCRIPT = re.compile(
    rf"(?P<line>[\r\n\u2028\u2029]+)|(?P<skip>[ \t\f\v\u00A0\u1680\u2000-\u200B\u202F\u205F\u3000\uFEFF]+|//[^\r\n]*)|(?P<block>/\*.*?\*/)"
    r"|(?P<text>\"(?:[^\"\\\r\n]|\\(?:\r\n|.))*\"|'(?:[^'\\\r\n]|\\(?:\r\n|.))*')"
    rf"|(?P<number>{_NUMBER})|(?P<word>(?:[^\W\d]|[$#@]|\\u)[\w$]*)"
    r"|(?P<op>\.\.\.|=>|\?\?=|\?\?|\?\.(?!\d)|\*\*=|\*\*|\+\+|--|&&=|\|\|=|&&|\|\||===|!==|==|!=|<<=|<=|>=|\+=|-=|\*=|%=|&=|\|=|\^=|<<|[-+*%&|^!~?:;,.<>=()\[\]{}])",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[A-Za-z]*")
_SLASH = re.compile(r"/=|/")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
#: A slash after one of these divides.
_OPERANDS = frozenset(("NAME", "LIT", "TEMPLATE", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--", "PRIVATE"))
#: Words that are names as well, each with its own kind so that grammars can tell.
CONTEXTUAL = frozenset(
    "as async await from get of set static let yield abstract accessor any asserts bigint boolean constructor declare infer interface is keyof module namespace never object out override package private protected public readonly satisfies string symbol number type undefined unique unknown using implements global require target meta".split()
)
_KEPT = frozenset(
    "as async await from get of set static let yield abstract accessor asserts declare infer interface is keyof module namespace override private protected public readonly satisfies type unique implements out".split()
)


def script(text: str) -> list[tuple[str, bool]] | None:
    """Tokens with a flag for those that begin a line. ${ } of templates nest."""
    out: list[tuple[str, bool]] = []
    at, size, fresh = 0, len(text), False
    nests: list[int] = []  # open braces inside each template substitution
    if text.startswith("#!"):
        at = text.find("\n") if "\n" in text else size

    def template(start: int) -> int | None:
        """From inside a template to its end or to a substitution."""
        m = _TEMPLATE.match(text, start)
        if text.startswith("`", m.end()):
            out.append(("TAIL", False))
            return m.end() + 1
        if text.startswith("${", m.end()):
            out.append(("MIDDLE", False))
            nests.append(0)
            return m.end() + 2
        return None

    while at < size:
        c = text[at]
        if c == "`":
            out.append(("HEAD", fresh))
            fresh = False
            after = template(at + 1)
            if after is None:
                return None
            at = after
            continue
        if c == "}" and nests and nests[-1] == 0:
            nests.pop()
            after = template(at + 1)
            if after is None:
                return None
            at = after
            continue
        if c == "/" and text[at + 1 : at + 2] not in ("/", "*"):
            last = out[-1][0] if out else ""
            if last in _OPERANDS or last == "TAIL" or last in _KEPT:
                m, kind = _SLASH.match(text, at), None
            else:
                m, kind = _REGEX.match(text, at), "LIT"
            if m is None:
                return None
            out.append((kind or m[0], fresh))
            at, fresh = m.end(), False
            continue
        m = _SCRIPT.match(text, at)
        if m is None:
            return None
        kind, value, at = m.lastgroup, m[0], m.end()
        if kind == "line":
            fresh = True
            continue
        if kind == "skip":
            continue
        if kind == "block":
            fresh |= "\n" in value
            continue
        if kind == "word":
            if value[0] == "#":
                token = "PRIVATE" if len(value) > 1 else None
            elif value[0] == "@":
                token = "@"
                at = m.start() + 1
            else:
                token = value if value in SCRIPT_WORDS or value in _KEPT else "NAME"
            if token is None:
                return None
        elif kind == "number":
            if at < size and (text[at].isalnum() or text[at] in "_$") or re.fullmatch(r".*[lLjJfFdD]", value) and not value.lower().startswith("0x"):
                return None
            token = "LIT"
        elif kind == "text":
            token = "LIT"
        else:
            token = value
            if value == ">" and text[at : at + 1] in (">", "="):
                token = ">a" if text[at] == ">" or text.startswith(">=", at) else value
            if value == "{" and nests:
                nests[-1] += 1
            elif value == "}" and nests:
                nests[-1] -= 1
        out.append((token, fresh))
        fresh = False
    return None if nests else out
