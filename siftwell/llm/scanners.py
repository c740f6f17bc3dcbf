"""Symbols of a text for ``frontiers``: the tokens of ``lexers``, cut by one expression a text and looked up by value.

A value that was not met before, and is no plain name, is given to the lexer of its language. What an expression cannot decide goes to the lexer as
a whole: in scripts a text with a regular expression after a word or a line end, or with braces, slashes or lines in the substitution
of a template; in Python a text with a lone carriage return, or one that may end in a joined line.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from siftwell.llm import lexers

#: Values that are remembered, and the longest of them.
_MOST, _LONGEST = 100_000, 100
#: What a value is if it is not one symbol; below these, several symbols.
_WRONG, _LINE, _NOTHING, _SLASH, _DIVIDED, _TEMPLATED, _SEVERAL = -1, -2, -3, -4, -5, -6, -7

_NUMBER = rf"(?>{lexers._NUMBER})"
_QUOTED = r"\"[^\"\\\r\n]*(?:\\(?:\r\n|.)[^\"\\\r\n]*)*\"|'[^'\\\r\n]*(?:\\(?:\r\n|.)[^'\\\r\n]*)*'"
#: What a substitution may hold so that its end cannot be hidden, and a template of such substitutions, within one more of them too.
_PLAIN = r"[^{}`'\"/\\\r\n\u2028\u2029]|\"[^\"\\\r\n]*\"|'[^'\\\r\n]*'"
_INNER = rf"`[^`\\$]*(?:(?:\\.|\$(?!\{{)|\$\{{(?:{_PLAIN})*+\}})[^`\\$]*)*`"
_TEMPLATE = rf"`[^`\\$]*(?:(?:\\.|\$(?!\{{)|\$\{{(?:{_PLAIN}|{_INNER})*+\}})[^`\\$]*)*`"
#: A regular expression after a sign that no operand ends in.
_REGEX = r"(?:(?<=[(,=:\[!&|?{;])|(?<=[(,=:\[!&|?{;] ))" + lexers._REGEX.pattern

_JAVA = re.compile(
    rf"(?:{lexers._BLANK}|//[^\n]*|/\*.*?\*/)*+"
    rf"([^\W\d][\w$]*|\$[\w$]*|{_NUMBER}[\w$]*"
    r'|"""[ \t\f]*\r?\n(?:[^\\]|\\.)*?"""|"[^"\\\r\n]*(?:\\.[^"\\\r\n]*)*"'
    r"|'(?:[^'\\\r\n]|\\(?:[btnfrs0\"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4}))'"
    r"|>{2,}=?|\.\.\.|->|::|\+\+|--|&&|\|\||<<=|<<|[=!<>+*/&|^%-]=|.|\Z)",
    re.S,
)
_PYTHON = re.compile(
    r"(?:[ \t\f]+|#[^\r\n]*|\\\r?\n)*+"
    # The end of a line goes on over blank lines and comments to the first sign of the next line.
    r"((?:\r\n?|\n)(?:[ \t\f]*+(?:\n|[#\r][^\n]*(?:\n|\Z)))*+[ \t\f]*+"
    rf"|(?i:[rub]|br|rb|f|fr|rf|t|tr|rt)?(?:'''(?:[^\\]|\\.)*?'''|\"\"\"(?:[^\\]|\\.)*?\"\"\"|{_QUOTED})"
    rf"|[^\W\d]\w*|{_NUMBER}(?:(?!(?:and|or|if|else|in|is|for)\b)\w+)?"
    r"|\*\*=?|//=?|>>=?|<<=?|\.\.\.|->|[:=!<>+*/%@&|^-]=|.|\Z)",
    re.S,
)
_SCRIPT = re.compile(
    r"(?:[ \t\f\v\u00A0\u1680\u2000-\u200B\u202F\u205F\u3000\uFEFF]+|//[^\r\n]*)*+"
    rf"([\r\n\u2028\u2029]+|{_REGEX}|/\*(?:.*?\*/|.*)|(?:[^\W\d]|\$|\\u)[\w$]*|\#[\w$]*|{_NUMBER}[\w$]*|{_QUOTED}|{_TEMPLATE}"
    r"|>{2,}=?|\.\.\.|=>|/=|\?\?=?|\?\.(?!\d)|\*\*=?|\+\+|--|&&=?|\|\|=?|[=!]==?|<<=?|[<>+*%&|^-]=|.|\Z)",
    re.S,
)


class Values(dict):
    """Symbols by value. A word to which a dialect gives no meaning of its own is a name."""

    def __init__(self, kinds: dict[str, int], words: frozenset[str], lexer: Callable[[str], list | None], special: Callable[[str], int | None]) -> None:
        self.kinds, self.words, self.lexer, self.special = kinds, words, lexer, special
        self._name = 2 * kinds["NAME"]
        self.several: dict[int, tuple[int, ...]] = {}
        self._codes: dict[tuple[int, ...], int] = {}

    def symbols(self, tokens: list[tuple[str, bool]] | None) -> list[int] | None:
        """Of tokens of the lexer; None where there is a token that no rule has."""
        kinds, out = self.kinds, []
        for token, fresh in tokens or ():
            kind = kinds.get(token)
            if kind is None:
                if token not in lexers.CONTEXTUAL:
                    return None
                kind = kinds["NAME"]
            out.append(2 * kind + fresh)
        return None if tokens is None else out

    def code(self, several: tuple[int, ...]) -> int:
        if several not in self._codes:
            code = self._codes[several] = _SEVERAL - len(self._codes)
            self.several[code] = several
        return self._codes[several]

    def __missing__(self, value: str) -> int:
        if value.isidentifier() and value.isascii() and value not in self.words:
            out = self._name
        elif (out := self.special(value)) is None:
            found = self.symbols(self.lexer(value))
            out = _WRONG if not found else found[0] if len(found) == 1 else self.code(tuple(found))
        if len(value) <= _LONGEST and len(self) < _MOST:
            self[value] = out
        return out


def _cut(expression: re.Pattern, text: str) -> list[str]:
    values = expression.findall(text)
    while values and not values[-1]:  # the end of the text
        values.pop()
    return values


def java(kinds: dict[str, int]) -> Callable[[str], list[int] | None]:
    values = Values(kinds, lexers.JAVA_WORDS | lexers.JAVA_SOFT, lexers.java, lambda value: None)
    look = values.__getitem__

    def scan(text: str) -> list[int] | None:
        out = list(map(look, _cut(_JAVA, text)))
        if _WRONG in out:
            return None
        if ">>" in text:
            several = values.several
            return [s for code in out for s in (several[code] if code < 0 else (code,))]
        return out

    return scan


def python(kinds: dict[str, int]) -> Callable[[str], list[int] | None]:
    brackets = {value: _SEVERAL - i for i, value in enumerate("([{)]}")}

    def special(value: str) -> int | None:
        return _LINE if value[0] in "\r\n" else brackets.get(value)

    values = Values(kinds, lexers.PYTHON_WORDS | lexers._PY_SOFT, lambda value: (lexers.python(value) or [])[:-1] or None, special)
    look = values.__getitem__
    turns = {code: (2 * kinds[value], 1 if value in "([{" else -1) for value, code in brackets.items()}
    newline, indent, dedent = (2 * kinds[k] for k in ("NEWLINE", "INDENT", "DEDENT"))

    def scan(text: str) -> list[int] | None:
        if "\r" in text and text.count("\r") != text.count("\r\n"):
            return values.symbols(lexers.python(text))
        found = _cut(_PYTHON, "\n" + text)
        if found[-1][0] in "\r\n":
            if "\\\n" in text or "\\\r\n" in text:
                return values.symbols(lexers.python(text))
            if len(found) == 1:
                return []
            found.pop()
            ends = True
        else:
            ends = False
        out: list[int] = []
        add, depth, indents = out.append, 0, [0]
        for n, value in enumerate(found):
            symbol = look(value)
            if symbol >= 0:
                add(symbol)
            elif symbol == _LINE:
                if depth:
                    continue
                if n:
                    add(newline)
                lead = value.rpartition("\n")[2].rpartition("\f")[2]
                width = len(lead.expandtabs(8))
                if width > indents[-1]:
                    indents.append(width)
                    add(indent)
                while width < indents[-1]:
                    indents.pop()
                    add(dedent)
                if width != indents[-1] or len(lead.expandtabs(1)) > width:
                    return None
            elif symbol == _WRONG:
                return None
            else:
                symbol, turn = turns[symbol]
                add(symbol)
                depth += turn
                if depth < 0:
                    return None
        if depth:
            return None
        if out:
            if ends or out[-1] not in (newline, dedent):
                add(newline)
            out += [dedent] * (len(indents) - 1)
        return out

    return scan


def script(kinds: dict[str, int]) -> Callable[[str], list[int] | None]:
    def special(value: str) -> int | None:
        if value[0] in "\r\n\u2028\u2029":
            return _LINE
        if value[:2] == "/*":
            return _WRONG if len(value) < 4 or not value.endswith("*/") else _LINE if "\n" in value else _NOTHING
        return slashes.get(value)

    slashes = {"/": _SLASH, "/=": _DIVIDED, "`": _TEMPLATED}
    divided = {_SLASH: 2 * kinds["/"], _DIVIDED: 2 * kinds["/="]}
    operands = frozenset(kinds[k] for k in (*lexers._OPERANDS, *lexers._KEPT, "TAIL") if k in kinds)
    values = Values(kinds, lexers.SCRIPT_WORDS | lexers._KEPT, lexers.script, special)
    look, several = values.__getitem__, values.several

    def scan(text: str) -> list[int] | None:
        if text.startswith("#!"):
            return values.symbols(lexers.script(text))
        out: list[int] = []
        add, fresh = out.append, 0
        for symbol in map(look, _cut(_SCRIPT, text)):
            if symbol >= 0:
                add(symbol + fresh)
                fresh = 0
            elif symbol == _LINE:
                fresh = 1
            elif symbol in divided and out and out[-1] >> 1 in operands:
                add(divided[symbol] + fresh)
                fresh = 0
            elif symbol in divided or symbol == _TEMPLATED:
                return values.symbols(lexers.script(text))
            elif symbol == _WRONG:
                return None
            elif symbol != _NOTHING:
                first, *more = several[symbol]
                out += (first + fresh, *more)
                fresh = 0
        return out

    return scan


SCANNERS = {"java": java, "python": python, "javascript": script, "typescript": script}
