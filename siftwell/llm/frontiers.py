"""Recognition by remembered frontiers: what all alternatives of a generalised LL parser have in common between two tokens.

A frontier is the set of (state, stack) pairs alive at a position. Stacks hang together by content and not by
position: a stack node is the set of (state to return to, node below) of its callers. So the frontier after a token is
a function of the frontier before it and of the token, and is computed once and remembered, as in a lazily built
automaton; functions of the same language share almost all of their frontiers. Where a bracket opens, its inside is
read over open places (``holes``) in the stacks' stead, which are filled in when it closes: what is inside a bracket is
remembered once for all places that brackets stand in, however deep.

The result is that of ``Grammar.accepts`` for every text. Two properties of a grammar are asked for, and checked: no rule
calls itself before a token (the stacks would not end), and brackets are closed in the rule that opens them.
"""

from __future__ import annotations

from collections.abc import Iterable

from siftwell.llm.gll import Grammar

#: Brackets of the dialects.
PAIRS = {"(": ")", "[": "]", "{": "}", "INDENT": "DEDENT", "HEAD": "TAIL"}
#: Pairs of state and stack, remembered at most; beyond that all is forgotten between two texts.
MOST = 1_000_000
_ROOT = 0


class _Frontier(dict):
    """(state, node) pairs, and what each symbol read so far leads to: a frontier, an opening, a closing, or None."""

    __slots__ = ("pairs", "owner")

    def __init__(self, pairs: frozenset[tuple[int, int]], owner: Frontiers) -> None:
        self.pairs, self.owner = pairs, owner

    def __missing__(self, symbol: int):
        out = self[symbol] = self.owner._step(self.pairs, symbol)
        return out


class _Opening:
    """An opened bracket: the frontier inside it, the nodes that stand in its holes, and the frontiers after its closings."""

    __slots__ = ("inside", "nodes", "after")

    def __init__(self, inside: _Frontier, nodes: list[set[int]]) -> None:
        self.inside, self.nodes, self.after = inside, nodes, {}


class Frontiers:
    """A symbol is twice the number of a token's kind, plus one where the token begins a line."""

    def __init__(self, grammar: Grammar, closers: Iterable[str] = ("}",), most: int = MOST) -> None:
        self.grammar, self.most = grammar, most
        kinds = grammar.kinds
        self._closers = frozenset(kinds[k] for k in closers if k in kinds)
        self._opens = {kinds[a]: kinds[b] for a, b in PAIRS.items() if a in kinds and b in kinds}
        self._closes = frozenset(self._opens.values())
        self._empty_rules = [self._nullable(omitted) for omitted in (False, True)]
        self._order = self._ranks()
        self._check_brackets()
        self._forget()

    def _nullable(self, omitted: bool) -> list[bool]:
        """Which rules may be empty, with or without places of omitted semicolons."""
        g = self.grammar
        rests, out = list(g._accept), [False] * len(g.entry)
        changed = True
        while changed:
            changed = False
            for s, moves in enumerate(g._moves):
                if not rests[s] and any((omitted if sym[0] == "a" else sym[0] == "n" and out[sym[1]]) and rests[t] for sym, t in moves.items()):
                    rests[s] = changed = True
            for r, s in enumerate(g.entry):
                if rests[s] and not out[r]:
                    out[r] = changed = True
        return out

    def _ranks(self) -> list[int]:
        """Rules in an order in which each stands before those that it may call before a token."""
        g = self.grammar
        calls: list[set[int]] = []
        for start in g.entry:
            todo, seen, called = [start], {start}, set()
            while todo:
                for (kind, *what), t in g._moves[todo.pop()].items():
                    if kind == "n":
                        called.add(what[0])
                    if (kind == "a" or kind == "n" and self._empty_rules[1][what[0]]) and t not in seen:
                        seen.add(t)
                        todo.append(t)
            calls.append(called)
        order, left = [], set(range(len(calls)))
        while left:
            free = [r for r in left if not any(r in calls[other] for other in left)]
            if not free:
                raise ValueError("grammar: a rule calls itself before a token")
            order += free
            left -= set(free)
        return order

    def _check_brackets(self) -> None:
        g = self.grammar
        for start in g.entry:
            depth, todo = {start: ()}, [start]
            while todo:
                s = todo.pop()
                open_ = depth[s]
                if g._accept[s] and open_:
                    raise ValueError("grammar: a rule leaves a bracket open")
                for (kind, *what), t in g._moves[s].items():
                    now = open_
                    if kind == "t" and what[0] in self._opens:
                        now = (*open_, self._opens[what[0]])
                    elif kind == "t" and what[0] in self._closes:
                        if open_[-1:] != (what[0],):
                            raise ValueError("grammar: a rule closes a bracket that it did not open")
                        now = open_[:-1]
                    if t not in depth:
                        depth[t] = now
                        todo.append(t)
                    elif depth[t] != now:
                        raise ValueError("grammar: brackets of a rule do not fit")

    def _forget(self) -> None:
        self._size = 0
        self._nodes: dict[frozenset, int] = {frozenset(): _ROOT}
        self._callers: list[tuple] = [()]
        self._known: dict[frozenset, _Frontier] = {}
        self._first = self._frontier(frozenset([(self.grammar.entry[self.grammar.start], _ROOT)]))

    def _frontier(self, pairs: frozenset[tuple[int, int]]) -> _Frontier:
        found = self._known.get(pairs)
        if found is None:
            found = self._known[pairs] = _Frontier(pairs, self)
            self._size += len(pairs)
        return found

    def _node(self, callers: set[tuple[int, int]]) -> int:
        key = frozenset(callers)
        found = self._nodes.get(key)
        if found is None:
            found = self._nodes[key] = len(self._callers)
            self._callers.append(tuple(key))
            self._size += len(key)
        return found

    def _step(self, pairs: frozenset[tuple[int, int]], symbol: int):
        g = self.grammar
        table, omit, first, entry, all_callers = g.table, g.omit, g._first, g.entry, self._callers
        kind = symbol >> 1
        omitted = symbol & 1 == 1 or kind == 0 or kind in self._closers
        empty = self._empty_rules[omitted]
        calls: dict[int, set[tuple[int, int]]] = {}
        shifted: set[tuple[int, int]] = set()
        ended = False
        self._size += 1

        def follow(todo: list[tuple[int, int]], new: bool) -> None:
            nonlocal ended
            seen = set(todo)

            def add(pair: tuple[int, int]) -> None:
                if pair not in seen:
                    seen.add(pair)
                    todo.append(pair)

            while todo:
                state, node = todo.pop()
                if omitted and omit[state] >= 0:
                    add((omit[state], node))
                target, pops, called = table[state].get(kind, (-1, False, ()))
                if target >= 0:
                    shifted.add((target, node))
                if pops and not new:  # a rule that is left where it was called was empty, which its caller saw to
                    if node == _ROOT:
                        ended = ended or kind == 0
                    for caller in all_callers[node]:
                        add(caller)
                for rule, back in called:
                    if empty[rule]:
                        add((back, node))
                    if kind in first[entry[rule]]:
                        calls.setdefault(rule, set()).add((back, node))

        follow(list(pairs), False)
        for rule in self._order:
            if rule in calls:
                follow([(entry[rule], self._node(calls[rule]))], True)
        if kind == 0:
            return ended
        if not shifted:
            return None
        if kind in self._opens:
            inside: dict[int, set[int]] = {}
            for target, node in shifted:
                inside.setdefault(target, set()).add(node)
            states = sorted(inside)
            return _Opening(self._frontier(frozenset((s, -1 - i) for i, s in enumerate(states))), [inside[s] for s in states])
        if kind in self._closes:
            return frozenset(shifted)
        return self._frontier(frozenset(shifted))

    def _fill(self, opening: _Opening, closed: frozenset[tuple[int, int]]) -> _Frontier:
        out = opening.after[closed] = self._frontier(frozenset((state, node) for state, hole in closed for node in opening.nodes[-1 - hole]))
        return out

    def accepts(self, symbols: Iterable[int]) -> bool:
        """Do the symbols (without end) derive from the start rule?"""
        if self._size > self.most:
            self._forget()
        here, open_ = self._first, []
        for symbol in symbols:
            there = here[symbol]
            if there.__class__ is _Frontier:
                here = there
            elif there is None:
                return False
            elif there.__class__ is _Opening:
                open_.append(there)
                here = there.inside
            else:
                opening = open_.pop()
                here = opening.after[there] if there in opening.after else self._fill(opening, there)
        return not open_ and here[0]
