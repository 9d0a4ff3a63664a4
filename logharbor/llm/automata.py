"""Byte automata: rules compiled by subset construction and minimisation.

Rules are written in a small regular language over bytes: literals, classes,
groups, ``|``, ``?``, ``*``, ``+``, ``{m}``, ``{m,}`` and escapes (``\\xHH`` or a
quoted character).  Matching is leftmost-longest.
"""

from __future__ import annotations

import numpy as np

_ALL = frozenset(range(256))


class _Parser:
    """Syntax tree of a rule: ("set", bytes), ("cat", parts), ("alt", parts), ("many", part, low, high)."""

    def __init__(self, rule: str):
        self.rule, self.at = rule, 0

    def peek(self) -> str:
        return self.rule[self.at: self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.rule[self.at - 1]

    def tree(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("alt", options)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self):
        part = self.single()
        while self.peek() and self.peek() in "?*+{":
            sign = self.take()
            if sign == "{":
                close = self.rule.index("}", self.at)
                low, comma, high = self.rule[self.at: close].partition(",")
                self.at = close + 1
                part = ("many", part, int(low), (int(high) if high else None) if comma else int(low))
            else:
                part = ("many", part, int(sign == "+"), 1 if sign == "?" else None)
        return part

    def single(self):
        c = self.take()
        if c == "(":
            part = self.tree()
            self.take()
            return part
        if c == "[":
            return ("set", self.klass())
        if c == "\\":
            return ("set", frozenset([self.escape()]))
        return ("set", frozenset([ord(c)]))

    def escape(self) -> int:
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.rule[self.at - 2: self.at], 16)
        return ord(c)

    def klass(self) -> frozenset[int]:
        items: set[int] = set()
        while self.peek() != "]":
            c = self.take()
            low = self.escape() if c == "\\" else ord(c)
            if self.peek() == "-" and self.rule[self.at + 1] != "]":
                self.take()
                c = self.take()
                items.update(range(low, (self.escape() if c == "\\" else ord(c)) + 1))
            else:
                items.add(low)
        self.take()
        return frozenset(items)


def parse(rule: str):
    return _Parser(rule).tree()


def reverse(tree):
    """The tree of the reversed language."""
    kind = tree[0]
    if kind == "cat":
        return ("cat", [reverse(t) for t in reversed(tree[1])])
    if kind == "alt":
        return ("alt", [reverse(t) for t in tree[1]])
    if kind == "many":
        return ("many", reverse(tree[1]), tree[2], tree[3])
    return tree


def either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []
        self.arcs: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.arcs.append([])
        return len(self.free) - 1

    def add(self, tree, a: int) -> int:
        """Append the tree at state ``a``; returns the state behind it."""
        kind = tree[0]
        if kind == "set":
            b = self.state()
            self.arcs[a].append((tree[1], b))
            return b
        if kind == "cat":
            for part in tree[1]:
                a = self.add(part, a)
            return a
        if kind == "alt":
            end = self.state()
            for part in tree[1]:
                begin = self.state()
                self.free[a].append(begin)
                self.free[self.add(part, begin)].append(end)
            return end
        _, part, low, high = tree
        for _ in range(low):
            a = self.add(part, a)
        if high is None:
            loop = self.state()
            self.free[a].append(loop)
            self.free[self.add(part, loop)].append(loop)
            return loop
        for _ in range(high - low):
            skip, b = a, self.add(part, a)
            end = self.state()
            self.free[skip].append(end)
            self.free[b].append(end)
            a = end
        return a

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class Automaton:
    """Minimal deterministic automaton of several rules.

    ``classes`` maps a byte to its class; ``step[s + c]`` is the next state, states
    being multiples of the number of classes; states from ``mark`` on accept, and
    ``accepts[s]`` has the rules accepted there as a bit mask.  State ``dead`` (or
    None) accepts nothing ever again.
    """

    def __init__(self, trees: list, search: bool):
        nfa = _Nfa()
        start = nfa.state()
        if search:
            nfa.arcs[start].append((_ALL, start))
        ends = {}
        for k, tree in enumerate(trees):
            begin = nfa.state()
            nfa.free[start].append(begin)
            ends[nfa.add(tree, begin)] = k
        # bytes that no arc tells apart form a class
        group = np.zeros(256, np.int64)
        for s in {arc[0] for arcs in nfa.arcs for arc in arcs}:
            _, group = np.unique(group * 2 + np.isin(np.arange(256), list(s)), return_inverse=True)
        sample = [int(np.flatnonzero(group == c)[0]) for c in range(group.max() + 1)]
        # subset construction
        first = nfa.closure([start])
        number, table, todo = {first: 0}, [], [first]
        for states in todo:
            row = []
            arcs = [arc for s in states for arc in nfa.arcs[s]]
            for byte in sample:
                target = nfa.closure({t for chars, t in arcs if byte in chars})
                if target not in number:
                    number[target] = len(todo)
                    todo.append(target)
                row.append(number[target])
            table.append(row)
        masks = np.array([sum({1 << ends[s] for s in states if s in ends}) for states in todo])
        # Moore's refinement until the blocks are stable
        moves = np.array(table)
        _, block = np.unique(masks, return_inverse=True)
        while True:
            _, finer = np.unique(np.column_stack([block, block[moves]]), axis=0, return_inverse=True)
            finer = finer.ravel()
            if finer.max() == block.max():
                break
            block = finer
        heads = np.array([int(np.flatnonzero(block == b)[0]) for b in range(block.max() + 1)])
        # the start first, accepting states last
        rank = np.array(sorted(range(len(heads)), key=lambda b: (masks[heads[b]] != 0, heads[b])))
        new = np.empty(len(rank), np.int64)
        new[rank] = np.arange(len(rank))
        width = len(sample)
        self.width, self.size = width, len(rank)
        self.classes = bytes(group.astype(np.uint8))
        self.step = (new[block[moves[heads[rank]]]] * width).ravel().tolist()
        self.start = int(new[block[0]]) * width
        plain = int((masks[heads] == 0).sum())
        self.mark = plain * width
        self.accepts = {int(i) * width: int(masks[heads[rank[i]]]) for i in range(plain, len(rank))}
        quiet = [s for s in range(plain) if all(t == s * width for t in self.step[s * width: (s + 1) * width])]
        self.dead = quiet[0] * width if quiet and not search else None

    def hits(self, data: bytes) -> list[tuple[int, int]]:
        """One pass over the bytes: ``(position, rules)`` wherever a rule has a match that ends."""
        step, mark, s, found = self.step, self.mark, self.start, []
        for i, c in enumerate(data.translate(self.classes)):
            s = step[s + c]
            if s >= mark:
                found.append((i, self.accepts[s]))
        return found

    def longest(self, data: bytes) -> int:
        """Length of the longest prefix that is accepted, -1 if none."""
        step, mark, dead, s, best = self.step, self.mark, self.dead, self.start, -1
        if s >= mark:
            best = 0
        for i, c in enumerate(data):
            s = step[s + self.classes[c]]
            if s == dead:
                break
            if s >= mark:
                best = i + 1
        return best
