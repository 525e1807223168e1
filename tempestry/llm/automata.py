"""Byte automata: a small regular-expression parser, subset construction, minimisation, transition arrays.

Patterns are made of ASCII literals, escapes (\\x20, \\n, \\t, \\., \\-, ...), classes with ranges and negation,
groups, alternation and ? * + {m} {m,} {m,n}. Negated classes hold ASCII bytes only.
"""

from dataclasses import dataclass

import numpy as np

ESCAPES = {"n": 10, "t": 9, "r": 13, "f": 12, "v": 11}


class Nfa:
    """States with byte-set edges and empty edges; `accept` gives the rule that a state accepts."""

    def __init__(self):
        self.edges = []
        self.empty = []

    def state(self):
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1


class Parser:
    """Turns a pattern into a nested tuple tree."""

    def __init__(self, pattern, ignore_case=False):
        self.text, self.at, self.ignore_case = pattern, 0, ignore_case

    def peek(self):
        return self.text[self.at] if self.at < len(self.text) else ""

    def take(self):
        self.at += 1
        return self.text[self.at - 1]

    def parse(self):
        tree = self.alternatives()
        if self.at < len(self.text):
            raise ValueError(f"unexpected {self.peek()!r} at {self.at} in {self.text!r}")
        return tree

    def alternatives(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated(self.atom()))
        return ("then", parts)

    def repeated(self, tree):
        while self.peek() and self.peek() in "?*+{":
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None), "{": (None, None)}[mark := self.take()]
            if mark == "{":
                end = self.text.index("}", self.at)
                first, comma, last = self.text[self.at : end].partition(",")
                low, high = int(first), (int(last) if last else None) if comma else int(first)
                self.at = end + 1
            tree = ("times", tree, low, high)
        return tree

    def atom(self):
        char = self.take()
        if char == "(":
            tree = self.alternatives()
            if not self.peek():
                raise ValueError(f"missing ) in {self.text!r}")
            self.take()
            return tree
        if char == "[":
            return ("set", self.cased(self.members()))
        if char == ".":
            return ("set", frozenset(range(128)) - {10})
        return ("set", self.cased({self.escaped() if char == "\\" else self.ascii(char)}))

    def members(self):
        negated = self.peek() == "^"
        if negated:
            self.take()
        found, first = set(), True
        while first or self.peek() != "]":
            first = False
            low = self.one()
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.take()
                found |= set(range(low, self.one() + 1))
            else:
                found.add(low)
        self.take()
        return set(range(128)) - found if negated else found

    def one(self):
        char = self.take()
        return self.escaped() if char == "\\" else self.ascii(char)

    def escaped(self):
        char = self.take()
        if char == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ESCAPES.get(char) if char in ESCAPES else self.ascii(char)

    @staticmethod
    def ascii(char):
        if ord(char) > 127:
            raise ValueError("patterns are ASCII")
        return ord(char)

    def cased(self, found):
        if self.ignore_case:
            found = found | {b ^ 32 for b in found if chr(b).isalpha()}
        return frozenset(found)


def connect(nfa, tree, start):
    """Adds the tree's states after `start`; returns the state in which it has been matched."""
    kind = tree[0]
    if kind == "set":
        end = nfa.state()
        nfa.edges[start].append((tree[1], end))
        return end
    if kind == "then":
        for part in tree[1]:
            start = connect(nfa, part, start)
        return start
    if kind == "or":
        end = nfa.state()
        for option in tree[1]:
            nfa.empty[connect(nfa, option, start)].append(end)
        return end
    _, part, low, high = tree
    for _ in range(low):
        start = connect(nfa, part, start)
    if high is None:
        loop, end = nfa.state(), nfa.state()
        nfa.empty[start].append(loop)
        nfa.empty[connect(nfa, part, loop)].append(loop)
        nfa.empty[loop].append(end)
        return end
    end = nfa.state()
    for _ in range(high - low):
        nfa.empty[start].append(end)
        begin = nfa.state()
        nfa.empty[start].append(begin)
        start = connect(nfa, part, begin)
    nfa.empty[start].append(end)
    return end


@dataclass(frozen=True)
class Automaton:
    """A minimal complete deterministic automaton.

    States are numbered so that the accepting ones come last; state s reads byte b from table[256 * s + b],
    which is already multiplied by 256. masks[s] has bit r set where rule r is accepted; dead is the state
    without a way to acceptance, or -1.
    """

    table: tuple
    start: int
    accepting: int
    masks: tuple
    dead: int

    def longest(self, data, at, end):
        """End of the longest match that begins at `at`, or -1."""
        table, state, accepting, dead = self.table, self.start, self.accepting, self.dead
        best = at if state >= accepting else -1
        while at < end:
            state = table[state + data[at]]
            at += 1
            if state >= accepting:
                best = at
            elif state == dead:
                break
        return best

    def first_end(self, data, at, end):
        """End of the first match found reading on from `at`, or -1."""
        table, state, accepting = self.table, self.start, self.accepting
        while at < end:
            state = table[state + data[at]]
            at += 1
            if state >= accepting:
                return at
        return -1

    def earliest(self, data, end, limit):
        """Start of the longest match of a reversed pattern, read backwards from `end` down to `limit`."""
        table, state, accepting, dead = self.table, self.start, self.accepting, self.dead
        best, at = -1, end
        while at > limit:
            at -= 1
            state = table[state + data[at]]
            if state >= accepting:
                best = at
            elif state == dead:
                break
        return best

    def seen(self, data):
        """Mask of the rules with a match anywhere: the one pass over the bytes."""
        table, state, accepting, masks = self.table, self.start, self.accepting, self.masks
        found = 0
        for byte in data:
            state = table[state + byte]
            if state >= accepting:
                found |= masks[state >> 8]
        return found


def compile_patterns(patterns, search=False, reverse=False):
    """One automaton for (pattern, ignore_case) pairs. search: a match may begin at any byte."""
    nfa = Nfa()
    root = nfa.state()
    accept = {}
    starts = {root}
    for rule, (pattern, ignore_case) in enumerate(patterns):
        begin = nfa.state()
        end = connect(nfa, Parser(pattern, ignore_case).parse(), begin)
        if reverse:
            begin, end = end, begin
        starts.add(begin)
        accept[end] = accept.get(end, 0) | 1 << rule
    if reverse:
        nfa = turned(nfa)
    if search:
        nfa.edges[root].append((frozenset(range(256)), root))
        nfa.empty[root] += starts - {root}
    return minimal(*subsets(nfa, starts, accept))


def turned(nfa):
    back = Nfa()
    for _ in nfa.edges:
        back.state()
    for state, edges in enumerate(nfa.edges):
        for found, end in edges:
            back.edges[end].append((found, state))
        for end in nfa.empty[state]:
            back.empty[end].append(state)
    return back


def closure(nfa, states):
    found, todo = set(states), list(states)
    while todo:
        for end in nfa.empty[todo.pop()]:
            if end not in found:
                found.add(end)
                todo.append(end)
    return frozenset(found)


def subsets(nfa, starts, accept):
    """Subset construction: transition rows and the rule mask of each state."""
    numbers = {closure(nfa, starts): 0}
    todo, rows, masks = list(numbers), [], []
    while todo:
        members = todo.pop(0)
        targets = [set() for _ in range(256)]
        for state in members:
            for found, end in nfa.edges[state]:
                for byte in found:
                    targets[byte].add(end)
        row, known = [], {}
        for target in map(frozenset, targets):
            if target not in known:
                full = closure(nfa, target)
                if full not in numbers:
                    numbers[full] = len(numbers)
                    todo.append(full)
                known[target] = numbers[full]
            row.append(known[target])
        rows.append(row)
        masks.append(sum({1 << r for s in members for r in range(64) if accept.get(s, 0) >> r & 1}))
    return np.array(rows), np.array(masks, dtype=np.int64)


def minimal(rows, masks):
    """Merges states that no continuation tells apart (partition refinement), accepting ones last."""
    part = np.unique(masks, return_inverse=True)[1]
    while True:
        signature = np.column_stack([part, part[rows]])
        refined = np.unique(signature, axis=0, return_inverse=True)[1].reshape(-1)
        if refined.max() == part.max():
            break
        part = refined
    _, first = np.unique(part, return_index=True)
    order = np.argsort(masks[first] != 0, kind="stable")
    number = np.empty(len(first), dtype=np.int64)
    number[order] = np.arange(len(first))
    kept = first[order]
    table = number[part[rows[kept]]] * 256
    mask = masks[kept]
    own = np.arange(len(kept))[:, None] * 256
    dead = np.flatnonzero((table == own).all(axis=1) & (mask == 0))
    return Automaton(
        tuple(table.reshape(-1).tolist()),
        int(number[part[0]]) * 256,
        int((mask == 0).sum()) * 256,
        tuple(mask.tolist()),
        int(dead[0]) * 256 if len(dead) else -1,
    )
