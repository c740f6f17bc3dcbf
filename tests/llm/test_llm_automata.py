"""Automata, tokenizer and parser against brute force and reference implementations."""

import ast
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.llm.automata import SuffixAutomaton
from siftwell.llm.parsing import parses

VOCABULARY = os.environ.get("BPE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.json")


@given(st.text("abc", max_size=30), st.text("abcd", max_size=30))
def test_longest_factors(source, text):
    got = SuffixAutomaton.of(source).matches(text)
    for end, length in enumerate(got):
        assert text[end - length + 1 : end + 1] in source
        assert length == end + 1 or text[end - length : end + 1] not in source


@given(st.lists(st.text("ab", min_size=1, max_size=6), min_size=1, max_size=8, unique=True), st.text("ab", max_size=20))
def test_all_words_ending_at_each_place(words, text):
    auto = SuffixAutomaton.of_all(words)
    state = length = 0
    for at, c in enumerate(text):
        while state and c not in auto.next[state]:
            state = auto.link[state]
            length = auto.length[state]
        if c in auto.next[state]:
            state, length = auto.next[state][c], length + 1
        found, s = set(), state
        while s > 0:
            if s in auto.final and auto.length[s] <= length:
                found.add(words[auto.final[s]])
            s = auto.link[s]
        assert found == {w for w in words if text[: at + 1].endswith(w)}


@pytest.fixture(scope="module")
def encoder():
    from siftwell.llm.bpe import Encoder

    if not os.path.exists(VOCABULARY):
        pytest.skip("no vocabulary here")
    with open(VOCABULARY, "rb") as file:
        return Encoder(file.read())


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    out = tokenizers.Tokenizer.from_file(VOCABULARY)
    out.encode_special_tokens = True
    return out


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(max_size=200), st.text("the aeiou n't\n 12é漢字😀<|>endoftx", max_size=200)))
def test_ids_are_those_of_the_library(encoder, library, text):
    assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["<|endoftext|>", "a" * 5000, "ab" * 4000, " " * 3000, "漢" * 2000, "\x1c\x1f x\x85y\u2028z", "don't we'll I've"])
def test_odd_texts(encoder, library, text):
    assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids


PYTHON = [
    "def f(a, *b, c=1, **d):\n    return a", "async def f():\n    await g()\n    async with a as b, c:\n        pass", "@x.y(1)\ndef f(self) -> dict[str, int]:\n    pass", "def f(x):\n  if (y := x) > 1: return y\n  else:\n    z = [i for i in x if i if not i]\n",
    "def f():\n    match x:\n        case {'a': 1, **r} if r: pass\n        case [1, *_] | None: pass\n", "def f():\n    try: a\n    except (A, B) as e: raise X from e\n    else: b\n    finally: c", "def f(): lambda *a, k=2: (yield)", "def f():\n    return f'{x!r:>{w}}' 'b'",
    "def f(:\n    pass", "def f():\npass", "def f():\n    x = = 1", "def f():\n    x = 'abc", "def f():\n    (a", "def f():\n        a\n    b", "def f():\n    if x\n        pass", "def f():\n<<<<<<< HEAD\n    a\n", "public int f() { return 1; }", "def f():\n    x = 08", "def f():\n    return\n  pass", "x ==== 1",
    "def f():\n    a = {1: 2, **b}\n    c = {*a, 1}\n    del a[1:2, ::3], b.c\n    global q\n    assert a, b\n    x: int = 3\n    a @= b ** -c if d else e", "def f(a, /, b, *, c): ...", "class A(B, metaclass=C):\n    x = 1\n    def g(self): pass\n", "def f():\n    '''doc\n  text'''\n    # note\n\n    return {'a': not x in y, 'b': x is not y}", "def f():\r\n    pass\r\n",
]


@pytest.mark.parametrize("code", PYTHON)
def test_python_as_the_interpreter_parses(code):
    try:
        ast.parse(code.replace("\r\n", "\n"))
        expected = True
    except SyntaxError:
        expected = False
    assert parses(code, "python") is expected


@pytest.mark.parametrize(
    "language, code, valid",
    [
        ("java", "@Override public <T extends A & B> List<Map<String, T[]>> f(final int a, String... b) throws X, Y { return (List<T>) g.<T>h(x -> x.y(), A::new)[1]; }", True),
        ("java", "Foo(int a) { super(a); this.b = a >>> 2 << 1; char c = '\\''; String s = \"\"\"\n x\"\"\"; }", True),
        ("java", "int f() { switch (x) { case 1 -> y(); case A a when a.b() -> { } default -> throw e; } return switch (z) { case 1: yield 2; default: yield 3; }; }", True),
        ("java", "void f() { for (int i = 0, j = 1; i < n; i++, j--) { } for (var x : xs) try (A a = b()) { } catch (X | Y e) { } finally { } do x++; while (x < 3); }", True),
        ("java", "void f() { if (a < b && c > d) int[] x = {1, 2}; }", False),
        ("java", "void f() { int[] x = {1, 2,}; Runnable r = () -> { }; a = b ? c : (int) -d; if (o instanceof P(int u, var v) && u > 1) { } }", True),
        ("java", "void f() { a + b; }", False),
        ("java", "void f() { x(; }", False),
        ("java", "void f() { String s = \"abc; }", False),
        ("java", "void f() { <<<<<<< HEAD\n a(); ======= \n b(); }", False),
        ("java", "void f() { a();", False),
        ("java", "def f(): pass", False),
        ("javascript", "async function* f({a, b: [c = 1, ...d]}, ...e) { for await (const x of y) yield* z; label: while (1) break label }", True),
        ("javascript", "const f = async (a, b) => ({ a, [b]: 1, get c() { return `x${`y${1}`}` }, ...d }), re = /[/\"']+\\/(?:a|b)/g", True),
        ("javascript", "static async *m(a = 1) { let x = a\n x++\n return x ?? y?.[1]?.(2) ** 3 }", True),
        ("javascript", "f(a) { if (a) return\n else throw new Error('x') }", True),
        ("javascript", "f(a) { let x = 1 let y = 2 }", False),
        ("javascript", "function f() { return {a: 1, }; ", False),
        ("javascript", "function f(a: string) { }", False),
        ("javascript", "f() { x = 'abc\n' }", False),
        ("typescript", "private async m<T extends A = B>(this: C, readonly?: string[], b = <const>1): Promise<Map<string, T[]>> { const x = y as unknown as D<E>; return x!.z satisfies F }", True),
        ("typescript", "const f = <T,>(a: (x: number) => void, b: { [k: string]: A | null }, c?: [a: B, ...d: E[]]): a is F => a?.b!", True),
        ("typescript", "m(a: string) { const b: string = ; }", False),
        ("typescript", "public String f(String a) { return a; }", False),
    ],
)
def test_brace_languages(language, code, valid):
    assert parses(code, language) is valid


def test_ambiguous_and_left_recursive_grammars():
    from siftwell.llm.gll import Grammar

    g = Grammar("e = e '+' e | e e | 'a' | ;", "e")
    kinds = g.kinds
    word = lambda s: [kinds[c] for c in s]
    assert g.accepts(word("a+a+aa")) and g.accepts(word("aaaa")) and g.accepts([]) and g.accepts(word("+")) and g.accepts(word("a+"))
    h = Grammar("s = 'a' s 'b' | 'c' ;", "s")
    assert h.accepts([h.kinds[c] for c in "aacbb"]) and not h.accepts([h.kinds[c] for c in "aacb"])
