"""All occurrences of many strings in many texts: an Aho-Corasick automaton in flat arrays.

States are numbered level by level; an edge is a key (state, letter) in a sorted array, so a step of all texts of a batch at once is a binary
search. A state's link is the state of its longest proper suffix, its exit the nearest state on that way that ends a string.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_LETTERS = 1 << 21  # more than there are code points


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


@dataclass
class Automaton:
    keys: np.ndarray  # (state * _LETTERS + letter), ascending
    to: np.ndarray  # the state that an edge leads to
    link: np.ndarray
    exit: np.ndarray  # a state itself if it ends a string; 0: none
    string: np.ndarray  # the string that ends in a state, or -1

    def edge(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Where edges lead, -1 without one."""
        if not len(self.keys):
            return np.full(len(states), -1, np.int64)
        wanted = states * _LETTERS + letters
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.to[at], -1)

    def step(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The next state of each text."""
        states, out = states.copy(), np.zeros(len(states), np.int64)
        open_ = np.arange(len(states))
        while len(open_):
            to = self.edge(states[open_], letters[open_])
            out[open_] = np.maximum(to, 0)
            open_ = open_[(to < 0) & (states[open_] > 0)]
            states[open_] = self.link[states[open_]]
        return out

    def matches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, end, string) of every occurrence, by number; an end is the place after the last letter."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        letters, first = codes("".join(texts)), np.cumsum(sizes) - sizes
        by_size = np.argsort(-sizes, kind="stable")
        states, found = np.zeros(len(texts), np.int64), []
        for k in range(int(sizes.max(initial=0))):
            rows = by_size[: np.searchsorted(-sizes[by_size], -k, side="left")]  # texts longer than k
            states[rows] = self.step(states[rows], letters[first[rows] + k])
            at = self.exit[states[rows]]
            while (some := at > 0).any():
                rows, at = rows[some], at[some]
                found.append((rows, np.full(len(rows), k + 1), self.string[at]))
                at = self.exit[self.link[at]]
        return tuple(np.concatenate([f[j] for f in found]) if found else np.zeros(0, np.int64) for j in range(3))


def automaton(strings: list[str]) -> Automaton:
    """Of distinct strings that are not empty."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    letters, first = codes("".join(strings)), np.cumsum(sizes) - sizes
    at = np.zeros(len(strings), np.int64)  # the state of each string's first k letters
    keys, to, levels, ends, n = [], [], [], [], 1
    for k in range(int(sizes.max(initial=0))):
        rows = np.flatnonzero(sizes > k)
        level, state = np.unique(at[rows] * _LETTERS + letters[first[rows] + k], return_inverse=True)
        at[rows] = n + state
        keys.append(level)
        to.append(n + np.arange(len(level)))
        levels.append((n, level))
        done = rows[sizes[rows] == k + 1]
        ends.append((at[done], done))
        n += len(level)
    # parents have smaller numbers than their children, so the keys of the levels follow each other in order
    out = Automaton(*(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, to)), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64))
    for state, string in ends:
        out.string[state] = string
    for begin, level in levels:
        own = begin + np.arange(len(level))
        if begin > 1:
            out.link[own] = out.step(out.link[level // _LETTERS], level % _LETTERS)
        out.exit[own] = np.where(out.string[own] >= 0, own, out.exit[out.link[own]])
    return out
