"""Regular expressions as one deterministic automaton over bytes.

``compile_rules`` parses every rule, joins their position automata, builds the reachable subsets, and merges
equal states. Of the result a table of transitions by class of byte is left, and for every state the rules that
are under way in it and the rules of which a match ends there.

The syntax is literals, ``\\xHH``, other escaped characters, ``.`` (any byte but a line feed), classes with
ranges and ``^``, groups, ``|``, ``? * +``, ``{m}``, ``{m,}``, ``{m,n}`` and, in front, ``(?i)`` for ASCII letters of
either case. A pattern is ASCII and matches bytes; a match has at least one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


class _Parser:
    """Positions of a pattern: which bytes each takes, which begin and end a match, and which may follow which."""

    def __init__(self, pattern: str) -> None:
        self.fold = pattern.startswith("(?i)")
        self.rest = list(pattern[4:] if self.fold else pattern)[::-1]
        self.takes: list[frozenset[int]] = []
        self.follows: list[set[int]] = []
        nullable, self.first, self.last = self._either()
        if self.rest or nullable:
            raise ValueError(f"not a rule: {pattern!r}")

    def _peek(self) -> str:
        return self.rest[-1] if self.rest else ""

    def _either(self):
        nullable, first, last = self._chain()
        while self._peek() == "|":
            self.rest.pop()
            n, f, e = self._chain()
            nullable, first, last = nullable or n, first | f, last | e
        return nullable, first, last

    def _chain(self):
        whole = (True, frozenset(), frozenset())
        while self._peek() not in ("", "|", ")"):
            whole = self._after(whole, self._repeated())
        return whole

    def _after(self, a, b):
        for p in a[2]:
            self.follows[p] |= b[1]
        return a[0] and b[0], a[1] | b[1] if a[0] else a[1], a[2] | b[2] if b[0] else b[2]

    def _repeated(self):
        start = self.rest.copy()
        one = self._atom()
        size = len(start) - len(self.rest)
        while self._peek() and self._peek() in "?*+{":
            sign = self.rest.pop()
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(sign) or self._bounds()
            again = lambda: self._again(start, size)
            parts = [one] + [again() for _ in range(max(low, high or 1, 1) - 1)]
            whole = (True, frozenset(), frozenset())
            for i, part in enumerate(parts):
                if high is None and i == len(parts) - 1:
                    for p in part[2]:
                        self.follows[p] |= part[1]
                whole = self._after(whole, part if i < low else (True, *part[1:]))
            one = whole
        return one

    def _bounds(self):
        text = ""
        while (c := self.rest.pop()) != "}":
            text += c
        low, _, high = text.partition(",")
        return int(low), (int(high) if high else None) if "," in text else int(low)

    def _again(self, start: list[str], size: int):
        kept, self.rest = self.rest, start[len(start) - size :] if size else []
        part = self._atom()
        self.rest = kept
        return part

    def _atom(self):
        c = self.rest.pop()
        if c == "(":
            if self.rest[-2:][::-1] == ["?", ":"]:
                del self.rest[-2:]
            inner = self._either()
            self.rest.pop()
            return inner
        if c == "[":
            return self._position(self._class())
        return self._position(set(range(256)) - {10} if c == "." else {self._byte(c)})

    def _byte(self, c: str) -> int:
        if c != "\\":
            return ord(c)
        c = self.rest.pop()
        return int(self.rest.pop() + self.rest.pop(), 16) if c == "x" else ord(c)

    def _class(self) -> set[int]:
        found, none = set(), self._peek() == "^"
        if none:
            self.rest.pop()
        while (c := self.rest.pop()) != "]":
            low = high = self._byte(c)
            if self._peek() == "-" and self.rest[-2] != "]":
                self.rest.pop()
                high = self._byte(self.rest.pop())
            found |= set(range(low, high + 1))
        return set(range(256)) - found if none else found

    def _position(self, takes: set[int]):
        if self.fold:
            takes = takes | {b ^ 32 for b in takes if 65 <= b & ~32 <= 90}
        self.takes.append(frozenset(takes))
        self.follows.append(set())
        here = frozenset([len(self.takes) - 1])
        return False, here, here


@dataclass
class Automaton:
    """State 0 is the start. step[state, classes[byte]] is the next state, ends and live have a bit for each rule."""

    step: np.ndarray
    classes: np.ndarray
    ends: np.ndarray
    live: np.ndarray
    resets: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        #: bytes after which every state is the start, so what follows needs nothing of what came before
        self.resets = (self.step == 0).all(axis=0)[self.classes]

    def longest(self, data: bytes, start: int, stop: int) -> int:
        """End of the longest match of an anchored automaton at start; -1 if there is none."""
        state, end = 0, -1
        for at in range(start, stop):
            state = self.step[state, self.classes[data[at]]]
            if self.ends[state]:
                end = at + 1
            if not self.live[state]:
                break
        return end


def compile_rules(patterns: list[str], anchored: bool = False) -> Automaton:
    """The least automaton in which every pattern may begin at each byte, or only at the first one where anchored."""
    takes, follows, rule, first, last = [], [], [], set(), set()
    for r, pattern in enumerate(patterns):
        own, base = _Parser(pattern), len(takes)
        takes += own.takes
        follows += [{p + base for p in f} for f in own.follows]
        rule += [r] * len(own.takes)
        first |= {p + base for p in own.first}
        last |= {p + base for p in own.last}
    held = np.array([[b in t for b in range(256)] for t in takes])
    kinds, classes = np.unique(held, axis=1, return_inverse=True)
    taken = [frozenset(np.flatnonzero(kinds[:, k]).tolist()) for k in range(kinds.shape[1])]

    start = frozenset() if not anchored else frozenset([-1])
    number, todo, rows = {start: 0}, [start], []
    while len(rows) < len(todo):
        state = todo[len(rows)]
        open_ = set().union(*(follows[p] for p in state if p >= 0)) | (first if not anchored or -1 in state else set())
        row = []
        for kind in taken:
            after = frozenset(open_ & kind)
            if after not in number:
                number[after] = len(todo)
                todo.append(after)
            row.append(number[after])
        rows.append(row)
    bits = lambda some: sum(1 << r for r in {rule[p] for p in some})
    step = np.array(rows, dtype=np.int64)
    ends = np.array([bits(p for p in s if p in last) for s in todo], dtype=np.int64)
    live = np.array([bits(p for p in s if p >= 0) for s in todo], dtype=np.int64)
    return _least(step, classes.reshape(-1).astype(np.uint8), ends, live)


def _least(step: np.ndarray, classes: np.ndarray, ends: np.ndarray, live: np.ndarray) -> Automaton:
    """Equal states merged: groups by what a state says are split by the groups of their successors until none splits."""
    _, group = np.unique(np.stack([ends, live], axis=1), axis=0, return_inverse=True)
    group, many = group.reshape(-1), 0
    while many < (many := group.max() + 1):
        _, group = np.unique(np.column_stack([group, group[step]]), axis=0, return_inverse=True)
        group = group.reshape(-1)
    # the group of the start gets number 0
    order = np.argsort(np.arange(many) != group[0], kind="stable")
    place = np.empty(many, dtype=np.int64)
    place[order] = np.arange(many)
    group = place[group]
    one = np.zeros(many, dtype=np.int64)
    one[group[::-1]] = np.arange(len(group))[::-1]
    small = np.uint16 if many < 1 << 16 else np.int64
    return Automaton(group[step[one]].astype(small), classes, ends[one], live[one])


def states(machine: Automaton, data: np.ndarray, starts: np.ndarray, width: int = 512) -> np.ndarray:
    """The state after every byte of data, in which a text begins at each of starts (ascending, the first 0).

    The bytes are cut into lanes of about width bytes, after bytes that reset the automaton, and all lanes take a step
    at once. A run of many lanes without such a byte is cut anyhow: its lanes are first run from every state, which
    gives the state that each begins in, so time stays in proportion to the bytes for any text.
    """
    out = np.zeros(len(data), dtype=machine.step.dtype)
    if not len(data):
        return out
    fresh = np.zeros(len(data) + 1, dtype=bool)
    fresh[1:] = machine.resets[data]
    fresh[starts[starts < len(data)]] = True
    at = np.flatnonzero(fresh[:-1])
    keep = np.concatenate([[True], at[1:] // width != at[:-1] // width])
    lanes = at[keep]
    stops = np.append(lanes[1:], len(data))
    begin = np.zeros(len(lanes), dtype=machine.step.dtype)
    long = stops - lanes > 64 * width
    if long.any():
        more = [(lanes[~long], stops[~long], begin[~long])]
        for a, b in zip(lanes[long], stops[long]):
            cuts = np.arange(a, b, 16 * width)
            more.append((cuts, np.append(cuts[1:], b), _entered(machine, data, cuts, b)))
        lanes, stops, begin = (np.concatenate(part) for part in zip(*more))
    _run(machine, data, lanes, stops, begin, out)
    return out


def _run(machine: Automaton, data: np.ndarray, lanes: np.ndarray, stops: np.ndarray, state: np.ndarray, out: np.ndarray | None) -> np.ndarray:
    """Steps of all lanes from their states, long lanes first, so that those still running are in front; gives the last states."""
    order = np.argsort(lanes - stops, kind="stable")
    at, state = lanes[order].copy(), state[order].astype(np.int64)
    sizes = (stops - lanes)[order]
    running = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right") if len(sizes) else []
    flat, n = machine.step.reshape(-1), machine.step.shape[1]
    for k in running:
        here = at[:k]
        state[:k] = flat[state[:k] * n + machine.classes[data[here]]]
        if out is not None:
            out[here] = state[:k]
        here += 1
    last = np.empty(len(state), dtype=np.int64)
    last[order] = state
    return last


def _entered(machine: Automaton, data: np.ndarray, cuts: np.ndarray, stop: int, probe: int = 64) -> np.ndarray:
    """The state in which each of the lanes at cuts begins, when the first begins at the start.

    All states take a few bytes of every lane; they have mostly met by then, and only different ones go on.
    """
    many, stops = len(machine.step), np.append(cuts[1:], stop)
    begin = np.zeros(len(cuts), dtype=machine.step.dtype)
    for some in np.array_split(np.arange(len(cuts)), max(1, -(-len(cuts) * many // 1_000_000))):
        lane, states_ = np.repeat(some, many), np.tile(np.arange(many), len(some))
        middle = np.minimum(cuts + probe, stops)
        met = _run(machine, data, cuts[lane], middle[lane], states_, None)
        pairs, which = np.unique(lane * many + met, return_inverse=True)
        ends = _run(machine, data, middle[pairs // many], stops[pairs // many], pairs % many, None)[which.reshape(-1)].reshape(len(some), many)
        for row, k in enumerate(some[some < len(cuts) - 1]):
            begin[k + 1] = ends[row, begin[k]]
    return begin
