"""Generalised LL recognition with a graph-structured stack, over grammars with regular right sides.

A grammar is text: ``name = right side ;`` with alternation ``|``, grouping, ``*``, ``+``, ``?``, quoted
terminals, terminals in upper case, and names of other rules. Each right side becomes a deterministic
automaton over terminals and rules, so loops and common prefixes cost no extra descriptors. A descriptor is
(state, stack node, position); a stack node is (rule, position), shared by all callers, which hang on it as
edges with the state to return to. One token of lookahead (first and follow sets) prunes calls and returns.
Any context-free grammar will do, ambiguous and left-recursive ones too; the time is cubic at worst and
linear on the deterministic stretches that programs mostly are.

``~`` in a right side matches nothing, where the token after it stands on a new line, closes a block or ends
the text (the place of an omitted semicolon).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

_LEX = re.compile(r"\s*(?:(?P<q>'[^']+')|(?P<n>[A-Za-z_]\w*)|(?P<p>[()|*+?=;~]))")
END = "<end>"


class Grammar:
    """Compiled rules. ``kinds`` maps terminals to numbers; unknown tokens have none and are rejected."""

    def __init__(self, text: str, start: str) -> None:
        self.kinds: dict[str, int] = {END: 0}
        rules = self._read(re.sub(r"(?m)#.*$", "", text))
        self.rules = {name: i for i, name in enumerate(rules)}
        # NFA over all rules: arcs[state] = [(symbol, target)], symbol None for an empty move, else ("t", kind), ("n", rule), ("a",).
        self._arcs: list[list[tuple]] = []
        dfas = [self._determinize(*self._nfa(tree)) for tree in rules.values()]
        self._link(dfas)
        self.start = self.rules[start]

    # --- reading -------------------------------------------------------------------------------------

    def _read(self, text: str) -> dict[str, tuple]:
        tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise ValueError(f"grammar: {text[at:at + 40]!r}")
            tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        rules, pos = {}, 0

        def alternatives() -> tuple:
            nonlocal pos
            options = [sequence()]
            while pos < len(tokens) and tokens[pos] == ("p", "|"):
                pos += 1
                options.append(sequence())
            return ("or", options)

        def sequence() -> tuple:
            nonlocal pos
            items = []
            while pos < len(tokens) and not (tokens[pos][0] == "p" and tokens[pos][1] in "|);"):
                kind, value = tokens[pos]
                pos += 1
                if (kind, value) == ("p", "("):
                    item = alternatives()
                    pos += 1
                elif kind == "q":
                    item = ("t", self.kinds.setdefault(value[1:-1], len(self.kinds)))
                elif kind == "n" and value.isupper():
                    item = ("t", self.kinds.setdefault(value, len(self.kinds)))
                elif kind == "n":
                    item = ("n", value)
                else:
                    item = ("a",)
                while pos < len(tokens) and tokens[pos][0] == "p" and tokens[pos][1] in "*+?":
                    item = (tokens[pos][1], item)
                    pos += 1
                items.append(item)
            return ("and", items)

        while pos < len(tokens):
            name = tokens[pos][1]
            pos += 2
            rules[name] = alternatives()
            pos += 1
        return rules

    # --- automata ------------------------------------------------------------------------------------

    def _nfa(self, tree: tuple) -> tuple[int, int]:
        arcs = self._arcs

        def new() -> int:
            arcs.append([])
            return len(arcs) - 1

        def build(node: tuple, a: int, b: int) -> None:
            kind = node[0]
            if kind == "or":
                for option in node[1]:
                    build(option, a, b)
            elif kind == "and":
                here = a
                for item in node[1]:
                    there = new()
                    build(item, here, there)
                    here = there
                arcs[here].append((None, b))
            elif kind in "*+?" and len(node) == 2 and isinstance(node[1], tuple):
                c, d = new(), new()
                arcs[a].append((None, c))
                build(node[1], c, d)
                arcs[d].append((None, b))
                if kind != "+":
                    arcs[a].append((None, b))
                if kind != "?":
                    arcs[d].append((None, c))
            else:
                arcs[a].append((node, b))

        a, b = new(), new()
        build(tree, a, b)
        return a, b

    def _closure(self, states: frozenset[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for symbol, target in self._arcs[todo.pop()]:
                if symbol is None and target not in seen:
                    seen.add(target)
                    todo.append(target)
        return frozenset(seen)

    def _determinize(self, a: int, b: int) -> tuple[list[dict], list[bool]]:
        first = self._closure(frozenset([a]))
        numbers, order, moves, accept = {first: 0}, [first], [], []
        for states in order:
            out: dict[tuple, set[int]] = {}
            for s in states:
                for symbol, target in self._arcs[s]:
                    if symbol is not None:
                        out.setdefault(symbol, set()).add(target)
            row = {}
            for symbol, targets in out.items():
                closed = self._closure(frozenset(targets))
                if closed not in numbers:
                    numbers[closed] = len(order)
                    order.append(closed)
                row[symbol] = numbers[closed]
            moves.append(row)
            accept.append(b in states)
        return moves, accept

    def _link(self, dfas: list[tuple[list[dict], list[bool]]]) -> None:
        offset, at = [], 0
        for moves, _ in dfas:
            offset.append(at)
            at += len(moves)
        rule_of, accept, moves_of = [], [], []
        for r, (moves, acc) in enumerate(dfas):
            for row, yes in zip(moves, acc):
                rule_of.append(r)
                accept.append(yes)
                moves_of.append({(s[0], self.rules[s[1]]) if s[0] == "n" else s: offset[r] + t for s, t in row.items()})
        n = len(rule_of)
        nullable, changed = [False] * len(dfas), True
        empty = list(accept)  # can the rest of the rule after this state be empty?
        while changed:
            changed = False
            for s in range(n - 1, -1, -1):
                if not empty[s] and any((sym[0] == "a" or sym[0] == "n" and nullable[sym[1]]) and empty[t] for sym, t in moves_of[s].items()):
                    empty[s] = changed = True
            for r in range(len(dfas)):
                if empty[offset[r]] and not nullable[r]:
                    nullable[r] = changed = True
        first: list[set[int]] = [set() for _ in range(n)]
        changed = True
        while changed:
            changed = False
            for s in range(n):
                size = len(first[s])
                for sym, t in moves_of[s].items():
                    if sym[0] == "t":
                        first[s].add(sym[1])
                    elif sym[0] == "a":
                        first[s] |= first[t]
                    else:
                        first[s] |= first[offset[sym[1]]]
                        if nullable[sym[1]]:
                            first[s] |= first[t]
                changed |= len(first[s]) != size
        follow: list[set[int]] = [{0} for _ in dfas]
        changed = True
        while changed:
            changed = False
            for s in range(n):
                for sym, t in moves_of[s].items():
                    if sym[0] == "n":
                        size = len(follow[sym[1]])
                        follow[sym[1]] |= first[t]
                        if empty[t]:
                            follow[sym[1]] |= follow[rule_of[s]]
                        changed |= len(follow[sym[1]]) != size
        # After an omitted semicolon anything may come: states reached over ~ make their rules' callers open.
        every = range(len(self.kinds))
        self.table: list[dict[int, tuple[int, bool, tuple]]] = []
        self.omit: list[int] = []
        for s in range(n):
            row = {}
            for k in every:
                target = moves_of[s].get(("t", k), -1)
                calls = tuple((sym[1], t) for sym, t in moves_of[s].items() if sym[0] == "n" and (k in first[offset[sym[1]]] or nullable[sym[1]]))
                pops = accept[s] and k in follow[rule_of[s]]
                if target >= 0 or calls or pops:
                    row[k] = (target, pops, calls)
            self.table.append(row)
            self.omit.append(moves_of[s].get(("a",), -1))
        self.entry = offset
        # For the second token of lookahead, found as texts ask for it.
        self._moves, self._first, self._follow, self._nullable, self._empty, self._rule_of, self._accept = moves_of, first, follow, nullable, empty, rule_of, accept
        self._narrow: dict[tuple[int, int, int], tuple[int, bool, tuple]] = {}
        self._second: dict[tuple[int, int], tuple[frozenset[int], bool]] = {}

        # What a state does with a kind where there is but one way: shift (the state after), return (-1), or calls in a row.
        self._ways: list[dict[int, int | tuple]] = []
        for s, row in enumerate(self.table):
            ways: dict[int, int | tuple] = {}
            if self.omit[s] < 0:
                for k, (target, pops, calls) in row.items():
                    if (target >= 0) + pops + len(calls) == 1:
                        way = target if target >= 0 else -1 if pops else self._row_of_calls(s, k)
                        if way is not None:
                            ways[k] = way
            self._ways.append(ways)

    def _row_of_calls(self, state: int, kind: int) -> tuple | None:
        """((rule, back), ...) of the calls that follow each other without a choice, and the state they lead to; None if they go round."""
        out, met = [], set()
        while state not in met:
            met.add(state)
            row = self.table[state].get(kind)
            if row is None or self.omit[state] >= 0 or row[0] >= 0 or row[1] or len(row[2]) != 1:
                return tuple(out), state
            out.append(row[2][0])
            state = self.entry[row[2][0][0]]
        return None

    def _after(self, state: int, kind: int) -> tuple[frozenset[int], bool]:
        """Kinds that may come second within a rule, where ``kind`` comes first from a state on, and whether the rule may end between."""
        known = self._second
        if (state, kind) in known:
            return known[state, kind]
        moves, first, empty, entry, nullable = self._moves, self._first, self._empty, self.entry, self._nullable
        found: dict[int, tuple[set[int], bool]] = {state: (set(), False)}
        changed = True
        while changed:  # rules may begin with each other: until nothing is added
            changed = False
            for s in list(found):
                kinds, ends = found[s]
                size, had = len(kinds), ends

                def read(t: int) -> tuple[set[int], bool]:
                    nonlocal changed
                    if (t, kind) in known:
                        return known[t, kind]
                    if t not in found:
                        found[t] = (set(), False)
                        changed = True
                    return found[t]

                for symbol, t in moves[s].items():
                    inner: tuple = (set(), False)
                    if symbol[0] == "t":
                        inner = (set(), symbol[1] == kind)
                    elif symbol[0] == "n" and kind in first[entry[symbol[1]]]:
                        inner = read(entry[symbol[1]])
                    kinds |= inner[0]
                    if inner[1]:
                        kinds |= first[t]
                        ends = ends or empty[t]
                    if symbol[0] == "a" or symbol[0] == "n" and nullable[symbol[1]]:
                        more, over = read(t)
                        kinds |= more
                        ends = ends or over
                found[s] = (kinds, ends)
                changed |= len(kinds) != size or ends != had
        for s, (kinds, ends) in found.items():
            known[s, kind] = (frozenset(kinds), ends)
        return known[state, kind]

    def _choice(self, state: int, kind: int, following: int) -> tuple[int, bool, tuple]:
        """The row of a state for a kind, without the alternatives that the kind after it rules out."""
        target, pops, calls = self.table[state][kind]
        beyond = self._follow[self._rule_of[state]]

        def fits(t: int) -> bool:
            return following in self._first[t] or self._empty[t] and following in beyond

        if target >= 0 and not fits(target):
            target = -1
        kept = []
        for rule, back in calls:
            kinds, ends = self._after(self.entry[rule], kind)
            # A rule that may be empty leaves the token to what follows; it is kept.
            if self._nullable[rule] or following in kinds or ends and fits(back):
                kept.append((rule, back))
        out = self._narrow[state, kind, following] = (target, pops, tuple(kept))
        return out

    # --- recognition ---------------------------------------------------------------------------------

    def accepts(self, tokens: Sequence[int], fresh: Sequence[bool] | None = None, closers: frozenset[int] = frozenset()) -> bool:
        """Do the token kinds (without end) derive from the start rule? ``fresh``: does a token begin a line?

        Positions are visited in order, so that wrong alternatives die at the token that rules them out. Where a state
        leaves a choice, the token after next narrows it. While only one descriptor is alive, it runs on without being
        queued, and its calls go on a plain stack (``frames``); at the first choice the frames become stack nodes,
        shared as ever.
        """
        table, omit, entry, narrow, ways = self.table, self.omit, self.entry, self._narrow, self._ways
        end = len(tokens)
        text = [*tokens, 0]
        width = end + 1
        root = self.start * width
        callers: dict[int, list[tuple[int, int]]] = {root: []}
        popped: dict[int, int] = {root: -1}  # the last position at which a node was left
        here, later = [(entry[self.start], root)], []
        seen: set[tuple[int, int]] = set()
        frames: list[tuple[int, int, int]] = []
        deepest, at = len(entry), 0
        built = 0  # the last position at which stack nodes were made
        while True:
            if not here:
                if not later or at == end:
                    return False
                here, later = later, here
                seen.clear()
                at += 1
            waiting = here.pop()
            if waiting in seen:
                continue
            seen.add(waiting)
            state, node = waiting
            pushed = 0  # calls since the last shift: more than there are rules go round in a circle
            while True:
                kind = text[at]
                alone = not here and not later
                if alone:
                    while True:
                        way = ways[state].get(kind)
                        if way is None:
                            break
                        if way.__class__ is tuple:
                            if built == at:
                                break
                            for rule, back in way[0]:
                                frames.append((rule, at, back))
                            state = way[1]
                        elif way >= 0:
                            state = way
                            at += 1
                            kind = text[at]
                            pushed = 0
                        elif frames:
                            state = frames.pop()[2]
                        else:
                            break
                    seen.clear()
                row = table[state].get(kind)
                skip = omit[state]
                if skip >= 0:
                    if not (kind == 0 or kind in closers or fresh is not None and fresh[at]):
                        skip = -1
                    elif row is None:
                        if (skip, node) in seen and not frames:
                            break
                        state = skip
                        continue
                if row is None:
                    break
                target, pops, calls = row
                if kind and (len(calls) > 1 or calls and (pops or target >= 0)):
                    target, pops, calls = narrow.get((state, kind, text[at + 1])) or self._choice(state, kind, text[at + 1])
                if skip < 0:
                    if not calls and not pops:
                        if target < 0:
                            break
                        if alone:
                            state = target
                            at += 1
                            pushed = 0
                            if seen:
                                seen.clear()
                            continue
                    elif alone and target < 0:
                        if not calls:
                            if frames:
                                state = frames.pop()[2]
                                continue
                            known = callers[node]
                            if len(known) == 1 and popped[node] != at:
                                popped[node] = at
                                state, node = known[0]
                                continue
                        elif not pops and len(calls) == 1:
                            rule, back = calls[0]
                            if rule * width + at not in callers:
                                pushed += 1
                                if pushed > deepest:
                                    break
                                frames.append((rule, at, back))
                                state = entry[rule]
                                continue
                # A choice: the frames become stack nodes.
                for rule, start, back in frames:
                    child = rule * width + start
                    if child in callers:
                        callers[child].append((back, node))
                    else:
                        callers[child] = [(back, node)]
                        popped[child] = -1
                    node = child
                    built = at
                frames.clear()
                if skip >= 0:
                    here.append((skip, node))
                if pops:
                    if node == root and at == end:
                        return True
                    if popped[node] != at:
                        popped[node] = at
                        here.extend(callers[node])
                for rule, back in calls:
                    child = rule * width + at
                    known = callers.get(child)
                    if known is None:
                        built = at
                        callers[child] = [(back, node)]
                        popped[child] = -1
                        here.append((entry[rule], child))
                    elif (back, node) not in known:
                        known.append((back, node))
                        if popped[child] == at:
                            here.append((back, node))
                if target >= 0:
                    later.append((target, node))
                break
            frames.clear()
