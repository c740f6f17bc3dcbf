"""Automata shared by the operators of this subpackage."""

from __future__ import annotations

from collections import deque
from collections.abc import Hashable, Iterable, Sequence


class SuffixAutomaton:
    """Suffix automaton of one or several sequences, inserted as a trie so that shared prefixes share states.

    The longest word of the state reached by an inserted sequence is that sequence itself, hence
    ``final`` (state -> label of the sequence) together with the suffix links lists every inserted
    sequence that ends at a position of a traversed text.
    """

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        self.final: dict[int, int] = {}

    def _state(self, length: int, link: int, arcs: dict) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, q: int, symbol: Hashable) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p != -1 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        return copy

    def extend(self, last: int, symbol: Hashable) -> int:
        """State after appending ``symbol`` to the word of ``last``."""
        q = self.next[last].get(symbol)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, symbol)
        cur, p = self._state(self.length[last] + 1, 0, {}), last
        while p != -1 and symbol not in self.next[p]:
            self.next[p][symbol] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][symbol]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, symbol)
        return cur

    @classmethod
    def of(cls, sequence: Iterable[Hashable]) -> "SuffixAutomaton":
        auto, last = cls(), 0
        for symbol in sequence:
            last = auto.extend(last, symbol)
        return auto

    @classmethod
    def of_all(cls, sequences: Sequence[Sequence[Hashable]]) -> "SuffixAutomaton":
        """Breadth-first over the trie of ``sequences``; ``final`` gets their positions."""
        trie: list[dict] = [{}]
        ends: dict[int, int] = {}
        for label, sequence in enumerate(sequences):
            node = 0
            for symbol in sequence:
                child = trie[node].get(symbol)
                if child is None:
                    child = len(trie)
                    trie[node][symbol] = child
                    trie.append({})
                node = child
            ends[node] = label
        auto, queue = cls(), deque([(0, 0)])
        while queue:
            node, state = queue.popleft()
            if node in ends:
                auto.final[state] = ends[node]
            for symbol, child in trie[node].items():
                queue.append((child, auto.extend(state, symbol)))
        return auto

    def matches(self, text: Iterable[Hashable]) -> list[int]:
        """For each position, the length of the longest factor of the sequences that ends there."""
        out, state, length = [], 0, 0
        for symbol in text:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if symbol in self.next[state]:
                state = self.next[state][symbol]
                length += 1
            else:
                length = 0
            out.append(length)
        return out


class KeywordAutomaton:
    """Keywords found in one pass over a text (Aho-Corasick), case folded by the caller."""

    def __init__(self, words: Iterable[str]) -> None:
        import ahocorasick

        self._auto = ahocorasick.Automaton()
        for word in words:
            self._auto.add_word(word, word)
        self._auto.make_automaton()

    def any(self, text: str) -> bool:
        return next(self._auto.iter(text), None) is not None

    def all(self, text: str) -> list[tuple[int, str]]:
        """(position after the match, keyword) of every match."""
        return [(end + 1, word) for end, word in self._auto.iter(text)]


class PhraseAutomaton:
    """Phrases over words, all in one deterministic automaton that is built as far as texts need it.

    A phrase is words and blanks: ``a|b`` either word, ``~3`` at most three words of any kind. Texts are sequences of
    words; a state is the set of places in phrases that may go on, and each move is computed once.
    """

    def __init__(self, phrases: Iterable[str]) -> None:
        # places: per place (words it takes or None for any, place after it); gaps are chains of places that may be left out.
        self._takes: list[frozenset[str] | None] = []
        self._next: list[tuple[int, ...]] = []
        starts: list[int] = []
        self._known: set[str] = set()
        for phrase in phrases:
            after: tuple[int, ...] = (-1,)
            for token in reversed(phrase.split()):
                if token.startswith("~"):
                    for _ in range(int(token[1:])):
                        after = (*after, self._place(None, after))
                else:
                    words = frozenset(token.split("|"))
                    self._known |= words
                    after = (self._place(words, after),)
            starts.extend(after)
        self._starts = frozenset(starts)
        self._states: dict[frozenset[int], int] = {self._starts: 0}
        self._sets: list[frozenset[int]] = [self._starts]
        self._moves: list[dict[str, int]] = [{}]

    def _place(self, takes: frozenset[str] | None, after: tuple[int, ...]) -> int:
        self._takes.append(takes)
        self._next.append(after)
        return len(self._takes) - 1

    def _move(self, state: int, word: str) -> int:
        """State after ``word``, -1 where a phrase ends."""
        reached = set(self._starts)
        for place in self._sets[state]:
            takes = self._takes[place]
            if takes is None or word in takes:
                if -1 in self._next[place]:
                    return -1
                reached.update(self._next[place])
        key = frozenset(reached)
        number = self._states.get(key)
        if number is None:
            number = self._states[key] = len(self._sets)
            self._sets.append(key)
            self._moves.append({})
        return number

    def accepts(self, words: Iterable[str]) -> bool:
        """Does some phrase stand in the sequence?"""
        known, moves, state = self._known, self._moves, 0
        for word in words:
            word = word if word in known else ""
            target = moves[state].get(word)
            if target is None:
                target = moves[state][word] = self._move(state, word)
            if target < 0:
                return True
            state = target
        return False
