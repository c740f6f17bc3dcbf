"""Cases that caps, prefixes or switches once lost, each by itself."""

import random

import numpy as np
import pytest

from siftwell.llm import pairs, sources_quality, spam
from siftwell.llm.automata import PhraseAutomaton, SuffixAutomaton


def _exact(reply, prompt, need=pairs.COPY_FACTOR):
    mark = bytearray(len(reply))
    for i in range(len(reply) - need + 1):
        if reply[i : i + need] in prompt:
            mark[i : i + need] = b"\x01" * need
    return sum(mark) / len(reply)


def test_coverage_is_exact_where_it_decides():
    rng = random.Random(3)
    for _ in range(300):
        prompt = "".join(rng.choice("abcde") for _ in range(rng.randrange(20, 200)))
        reply = ""
        while len(reply) < 60:
            at = rng.randrange(len(prompt))
            reply += prompt[at : at + rng.randrange(8, 16)] + rng.choice(["", "x", "yz"])
        share = _exact(reply, prompt)
        got = pairs.covered(reply, prompt)
        assert got == pytest.approx(share) or share < pairs.COPY_SHARE and got == 0.0


def test_a_copy_out_of_step_with_blocks_is_found():
    prompt = "thequickbrownfoxjumpsoverthelazydogwhileitrains"
    reply = "".join(prompt[i : i + 12] + "#" for i in range(0, 47, 12)).replace("#", "zq")
    assert pairs.covered(reply, prompt) == pytest.approx(_exact(reply, prompt)) and pairs.covered(reply, prompt) >= 0.8


@pytest.mark.parametrize("prompt, reply, copied", [("Why?", "why", True), ("Is the value of userInput checked here?", "yes", False), ("Is it?", "Is it", True)])
def test_short_replies(prompt, reply, copied):
    assert (pairs.covered(pairs._fold(reply), pairs._fold(prompt)) >= pairs.COPY_SHARE) is copied


@pytest.mark.parametrize(
    "text, refused",
    [
        ("Thank you for the question. It is a good one. I am sorry, but I cannot help with that.", True),
        ("I must decline. That is all. Thank you. Goodbye. See you. Bye.", True),
        ("The proxy cannot continue after a timeout and will not process the request.", False),
        ("The request is rejected by the filter before it reaches the sink.", False),
        ("I cannot comment on the second caller. The first one binds every value as a parameter, checks the length of the name, and logs what it removes, so the finding does not hold for any path that I can see in this file.", False),
        ("Leider kann ich dabei nicht helfen.", True),
        ("Je ne peux malheureusement pas vous aider.", True),
        ("No puedo ayudarle con eso.", True),
    ],
)
def test_refusals_anywhere(text, refused):
    assert pairs.refuses(text) is refused


def test_phrases_with_gaps():
    auto = PhraseAutomaton(["a ~2 b|c", "d e"])
    assert [auto.accepts(t.split()) for t in ("a b", "a x c", "a x y b", "a x y z b", "x d e", "d x e", "a a x y b", "")] == [True, True, True, False, True, False, True, False]
    assert SuffixAutomaton.of("abcbc").matches("xbcbca") == [0, 1, 2, 3, 4, 1]


_FINDING = "finding_no bigint, repo string, file_path string, code_snippet string, start_line int"
_CODE = [f"    result_{i} = transform(previous_{i}, window={i}, mode='strict')  # step {i} of the long pipeline" for i in range(9)]


def _kinds(spark, rows):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], _FINDING)
    return {(r.repo, r.file_path): r.kind for r in sources_quality.not_hand_written(frame).collect()}


def test_copies_with_different_findings_are_shared_subtrees(spark):
    rows = [
        *[("a", "x/y/kit/core.py", c, 50) for c in _CODE[:4]], ("a", "x/y/kit/more.py", _CODE[7], 50), ("a", "x/y/own.py", "def mine(): pass", 50),
        *[("b", "z/kit/core.py", c, 50) for c in _CODE[1:5]], ("b", "z/kit/more.py", _CODE[7], 50), ("b", "z/other.py", "def other(): pass", 50),
    ]
    assert _kinds(spark, rows) == {("a", "x/y/kit/core.py"): "shared subtree", ("a", "x/y/kit/more.py"): "shared subtree", ("b", "z/kit/core.py"): "shared subtree", ("b", "z/kit/more.py"): "shared subtree"}


def test_a_single_file_may_be_a_copy(spark):
    rows = [("a", "x/solo.py", "\n".join(_CODE[:3]), 50), ("b", "solo.py", "\n".join(_CODE[:3]), 90), ("b", "mine.py", "x = 1", 1)]
    assert _kinds(spark, rows) == {("a", "x/solo.py"): "shared subtree", ("b", "solo.py"): "shared subtree"}


def test_forks_short_snippets_and_other_names_are_no_copies(spark):
    fork = [(r, "k/solo.py", "\n".join(_CODE[:3]), 50) for r in ("a", "b")]
    assert _kinds(spark, fork) == {}
    assert _kinds(spark, [("a", "k/s.py", "x = read(y)", 50), ("b", "k/s.py", "x = read(y)", 50), ("b", "k/t.py", "z", 1)]) == {}
    assert _kinds(spark, [("a", "k/one.py", "\n".join(_CODE[:3]), 50), ("b", "k/two.py", "\n".join(_CODE[:3]), 50)]) == {}


def test_a_long_licence_does_not_hide_the_mark(spark):
    licence = "\n".join(f"// Line {i} of a licence text." for i in range(40))
    block = "/*\n" + "\n".join(f" * Line {i}." for i in range(400)) + "\n * This file is automatically generated. Do not edit.\n */\nclass A {}"
    assert _kinds(spark, [("a", "A.java", licence + "\n// Code generated by toolgen. DO NOT EDIT.\nclass A {}", 1), ("a", "B.java", block, 1), ("a", "C.java", "class C {\n" + "  int x;\n" * 9 + "  // Code generated by toolgen\n}", 1)]) == {("a", "A.java"): "generated", ("a", "B.java"): "generated"}


_PROSE = ["The guard stands before the loop and it checks the length of the value, so nothing is read past the end.", "In our view the handler is reached by every role, and the text is escaped when the page is written."]


def test_the_distance_decides_and_group_size_does_not(spark):
    ham = [f"{_PROSE[i % 2]} Case {i} is one of those that we looked at in the last round, and there was no reason to change it." for i in range(60)]
    bad = ["cheap scanner, best scanner, scanner price, scanner test, buy scanner, scanner deal, top scanner, scanner 2025", "\n".join(f"https://example.com/{i}/page-{i}" for i in range(12))]
    rows = list(enumerate([*ham, *bad]))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in spam.spam(frame).collect()) == [60, 61]
    many = spark.createDataFrame([(i * 1000 + k, t) for i, t in rows for k in range(6)], "doc_id bigint, text string")
    assert {r.doc_id // 1000 for r in spam.spam(many).collect()} == {60, 61}


def test_lists_in_scripts_without_blanks(spark):
    assert spam.features("扫描器、漏洞、价格、折扣、免费、下载、教程")[1][5] == 1.0
    assert spam.features("该常量只定义一次，之后不再修改。第 130 行拼接语句，第 23 行执行该语句。")[1][5] == 0.0


def test_distances_of_equal_documents_are_finite():
    model = {spam.ALL: (np.zeros(7), spam.FLOOR, np.eye(7))}
    distance, toward = spam.judge(np.zeros((3, 7)), np.array(["en", "de", spam.ALL], dtype=object), model)
    assert not distance.any() and not toward.any()


def test_masks_stay_in_the_alphabet():
    from siftwell.llm.credentials import Finder, mask

    text = 'api_key = "deadbeefcafe0123"\nsecret = "JBSWY3DPEHPK3PXP"\ntoken = "aB3-xY9_qL7zT0"'
    spans = Finder().find(text)
    assert mask(text, spans) == 'api_key = "aaaaaaaaaaaa0000"\nsecret = "XXXXX2XXXXXX2XXX"\ntoken = "xX0-xX0_xX0xX0"'
    assert Finder().find(mask(text, spans)) == []


def test_many_credentials_in_one_text_take_linear_time():
    import time

    from siftwell.llm.credentials import Finder, _lines

    def seconds(n):
        text = "\n".join(f"DB{i}_PASSWORD=s3cr3tValue{i}Zz" for i in range(n))
        began = time.perf_counter()
        found = list(_lines(text, Finder().find(text)))
        assert [line for _, line in found] == list(range(1, n + 1))
        return time.perf_counter() - began

    seconds(500)
    assert seconds(8000) < 8 * 4 * seconds(1000)
