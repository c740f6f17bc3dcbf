"""Exact byte-level BPE by dynamic programming over prefixes.

For every prefix of a pre-token there is exactly one token that its encoding ends with. The candidates
are the vocabulary entries ending at that position, listed by the suffix automaton of the vocabulary;
the right one is the candidate whose pair with the last token of the remaining prefix is compatible,
that is, no merge of a better rank would have crossed the border between the two. Back-pointers then
give the ids. The work is linear in the text; no merge queue and no quadratic rescans of long pre-tokens.
"""

from __future__ import annotations

import json

import regex

from siftwell.llm.automata import SuffixAutomaton

# The pre-token pattern published with the vocabulary. White space is spelled out as the
# Unicode property because Python's \s also has the separators U+001C to U+001F.
_SPACE = r"\p{White_Space}"
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{_SPACE}\p{{L}}\p{{N}}]+|{_SPACE}+(?!\P{{White_Space}})|{_SPACE}+"
)

_CACHE_WORDS, _CACHE_CHARS, _CACHE_PAIRS = 400_000, 48, 1_000_000


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in published vocabularies: printable Latin-1 as is, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        letters[chr(256 + n)] = b
    return letters


class Encoder:
    """``encode(text)`` -> ids. ``vocabulary`` is the content of a tokenizers JSON file of kind BPE, byte level."""

    def __init__(self, vocabulary: bytes) -> None:
        model = json.loads(vocabulary)["model"]
        letters = _byte_letters()
        raw = lambda word: bytes(letters[c] for c in word)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = model["vocab"]
        # Ranks stand in for ids inside: bytes first, then the merges in their order.
        self._left, self._right, self._id = list(range(256)), list(range(256)), []
        rank_of: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        by_byte = {letters[word]: number for word, number in ids.items() if len(word) == 1 and word in letters}
        self._id = [by_byte[b] for b in range(256)]
        self._pair: dict[int, int] = {}
        tokens = [bytes([b]) for b in range(256)]
        for left, right in merges:
            a, b = rank_of[raw(left)], rank_of[raw(right)]
            token = tokens[a] + tokens[b]
            if token not in rank_of:
                rank_of[token] = len(tokens)
                tokens.append(token)
                self._left.append(a)
                self._right.append(b)
                self._id.append(ids[left + right])
            self._pair.setdefault(a << 20 | b, rank_of[token])
        auto = SuffixAutomaton.of_all(tokens)
        self._next, self._link, self._length = auto.next, auto.link, auto.length
        # Nearest state at or above each state whose longest word is a token.
        order = sorted(range(len(auto.next)), key=auto.length.__getitem__)
        self._token = [-1] * len(order)
        self._near = [0] * len(order)
        for state in order[1:]:
            self._token[state] = auto.final.get(state, -1)
            self._near[state] = state if self._token[state] >= 0 else self._near[auto.link[state]]
        self._split = regex.compile(PATTERN).findall
        self._words: dict[str, tuple[int, ...]] = {}
        self._fits: dict[int, bool] = {}

    def _compatible(self, a: int, b: int) -> bool:
        """Would BPE keep the border between tokens ``a`` and ``b``? Undo their merges from the latest to the first."""
        key = a << 20 | b
        known = self._fits.get(key)
        if known is not None:
            return known
        if len(self._fits) > _CACHE_PAIRS:
            self._fits.clear()
        pair, left, right = self._pair, self._left, self._right
        limit, fits = 1 << 30, True
        while True:
            merged = pair.get(a << 20 | b)
            if merged is not None and merged < limit:
                fits = False
                break
            # The later of both tokens was made last; before that its half at the border stood there.
            if a > b:
                if a < 256:
                    break
                limit, a = a, right[a]
            else:
                if b < 256:
                    break
                limit, b = b + 1, left[b]
        self._fits[key] = fits
        return fits

    def _encode_word(self, word: str) -> tuple[int, ...]:
        data = word.encode("utf-8", "surrogatepass")
        nxt, link, length, near, token = self._next, self._link, self._length, self._near, self._token
        fits = self._compatible
        last: list[int] = []
        sizes: list[int] = []
        state = matched = 0
        for i, byte in enumerate(data):
            while state and byte not in nxt[state]:
                state = link[state]
                matched = length[state]
            state = nxt[state][byte]
            matched += 1
            at = near[state] if length[state] == matched else near[link[state]]
            while True:
                size, candidate = length[at], token[at]
                if size == i + 1 or fits(last[i - size], candidate):
                    break
                at = near[link[at]]
            last.append(candidate)
            sizes.append(size)
        out, i = [], len(data) - 1
        while i >= 0:
            out.append(self._id[last[i]])
            i -= sizes[i]
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        words, out = self._words, []
        for word in self._split(text):
            ids = words.get(word)
            if ids is None:
                ids = self._encode_word(word)
                if len(word) <= _CACHE_CHARS:
                    if len(words) >= _CACHE_WORDS:
                        words.clear()
                    words[word] = ids
            out.extend(ids)
        return out
