"""The grammars of the dialects: that they are built, and what they take."""

import ast
import re
import subprocess
import sys

import pytest

from siftwell.llm.parsing import parses


@pytest.mark.parametrize("language", ["java", "python", "javascript", "typescript"])
def test_grammars_are_built(language):
    # In a process of its own, as filling in the parts of Python's rules once went round for ever at '@='.
    subprocess.run([sys.executable, "-c", f"from siftwell.llm.grammars import grammar; grammar({language!r})"], check=True, timeout=60)


@pytest.mark.parametrize("code", ["def f():\n    yield x\n", "def f():\n    yield\n    yield from g()\n    y = yield 1, 2\n    y @= yield\n", "def f():\n    yield = 1\n", "def f():\n    yield x = 1\n"])
def test_yield_stands_alone(code):
    try:
        ast.parse(code)
        expected = True
    except SyntaxError:
        expected = False
    assert parses(code, "python") is expected


SAMPLES = {
    "java": "void f(List<Map<String, T[]>> a) { int[] x = {1, 2,}; x[0] >>>= 3; if (a < b && c > d) { g((x) -> { return (T) y; }, A::new); } else for (var z : zs) try { } finally { } }",
    "python": "@d(1)\ndef f(a, *b, c=1):\n    x = {k: [v for v in w if v] for k, w in a}\n    if x:\n        yield f'{x!r}'\n\n    # note\n    else:\n        return (a,\n  b)\n",
    "javascript": "async f({a, b: [c = 1]}, ...d) { const r = `x${a ? `y${c}` : 'z'}` + c / 2\n return [1, 2].map(x => ({ x })) || /[/]'/g.test(r) }",
    "typescript": "private m<T extends A<B<C>>>(a?: (x: number) => void): a is F { let x = <T>y as { [k: string]: A | null }; return x!.z?.[1] / 2 }",
}


@pytest.mark.parametrize("language", SAMPLES)
def test_frontiers_and_scanners_as_the_plain_parser(language):
    from siftwell.llm import lexers
    from siftwell.llm.grammars import grammar

    lexer, rules = {"java": lexers.java, "python": lexers.python}.get(language, lexers.script), grammar(language)
    pieces = re.findall(r"\w+|\s+|[^\w\s]", SAMPLES[language])
    texts = [SAMPLES[language]] + ["".join(p) for i in range(len(pieces)) for p in (pieces[:i] + pieces[i + 1 :], pieces[: i + 1] + pieces[i:], pieces[:i] + pieces[i + 1 : i + 2] + pieces[i : i + 1] + pieces[i + 2 :], pieces[i:])]
    answers = set()
    for text in texts:
        tokens = lexer(text)
        numbers = None if tokens is None else [rules.kinds.get(t) for t, _ in tokens]
        expected = numbers is not None and None not in numbers and rules.accepts(numbers, [f for _, f in tokens] + [False], frozenset((rules.kinds.get("}", -1),)))
        assert parses(text, language) is expected, text
        answers.add(expected)
    assert answers == {True, False}


def test_frontiers_remember_insides_of_brackets_once():
    from siftwell.llm.frontiers import Frontiers
    from siftwell.llm.gll import Grammar

    g = Grammar("e = '(' e ')' e | 'a' | ;", "e")
    f, word = Frontiers(g), lambda s: [2 * g.kinds[c] for c in s]
    assert f.accepts(word("((a)a)(()a)")) and not f.accepts(word("((a)a")) and not f.accepts(word("a)")) and f.accepts([])
    size = f._size
    assert f.accepts(word("(" * 5000 + "a" + ")" * 5000)) and f._size < size + 20
    with pytest.raises(ValueError):
        Frontiers(Grammar("e = e 'a' | 'b' ;", "e"))
    with pytest.raises(ValueError):
        Frontiers(Grammar("e = '(' e | 'b' ')' ;", "e"))


def test_frontiers_are_forgotten_beyond_a_size():
    from siftwell.llm.frontiers import Frontiers
    from siftwell.llm.gll import Grammar

    g = Grammar("e = 'a' e | 'b' ;", "e")
    f = Frontiers(g, most=100)
    for n in (10, 500, 20, 500):
        assert f.accepts([2 * g.kinds["a"]] * n + [2 * g.kinds["b"]]) and not f.accepts([2 * g.kinds["a"]] * n)
        assert f._size < 5000


def test_words_of_typescript_are_names_in_javascript():
    assert parses("function f(out) { module.exports = out; const type = 1, { is } = out; return type / is }", "javascript")
    assert not parses("type A = B", "javascript") and parses("type A = B", "typescript")


def test_long_functions_need_no_more_steps_than_short_ones():
    from siftwell.llm.parsing import _reader

    line = "    total += items.get(name).stream().map(x -> x.price * 2 + (x.tax > 0 ? x.tax : 1)).sum();\n"
    assert parses("int f() {\n" + line * 2 + "}\n", "java")
    frontiers = _reader("java")[1]
    size = frontiers._size
    assert parses("int f() {\n" + line * 4000 + "}\n", "java")
    assert frontiers._size == size
