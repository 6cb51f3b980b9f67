"""Weighted finite-state machines over word classes, and their composition.

A machine has numbered states; an arc reads a class and gives the next state, the marks it sets and its weight. Classes
without an arc take the state's default arc. Machines that read the same classes are composed into one whose states are
tuples; its arcs are built when first taken and remembered, so that only the part that texts reach is ever made.

Weights are log odds: along a path, and where arcs are composed, they are added; one is 0. The lexicon is a machine of one
state that reads words and writes classes, each of its arcs with the weight of its entry; composed with the grammar it
gives arcs from words to marks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

#: Word classes.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

#: Next state, marks, weight.
Arc = tuple[int, frozenset, float]
NONE: frozenset = frozenset()
ONE = 0.0


@dataclass
class Machine:
    arcs: dict[tuple[int, int], Arc]
    default: dict[int, Arc] = field(default_factory=dict)

    def step(self, state: int, symbol: int) -> Arc:
        got = self.arcs.get((state, symbol))
        return got if got is not None else self.default.get(state, (state, NONE, ONE))


def within(opens: int, marks: str, reach: int, on: tuple[int, ...]) -> Machine:
    """Marks each class of ``on`` that comes at most ``reach`` words after one of class ``opens``; reach 0: to the end."""
    arcs, default = {}, {}
    for s in range(max(reach, 1) + 1):
        arcs[s, opens] = (max(reach, 1), NONE, ONE)
        after = max(0, s - 1) if reach else s
        default[s] = (after, NONE, ONE)
        for c in on:
            if c != opens:
                arcs[s, c] = (after, frozenset([marks]) if s else NONE, ONE)
    return Machine(arcs, default)


def emits(symbol: int, mark: str, weight: float = ONE) -> Machine:
    return Machine({(0, symbol): (0, frozenset([mark]), weight)})


class Composed:
    def __init__(self, *machines: Machine):
        self.machines, self.known = machines, {}
        self.start = (0,) * len(machines)

    def step(self, state: tuple[int, ...], symbol: int) -> tuple[tuple[int, ...], frozenset, float]:
        got = self.known.get((state, symbol))
        if got is None:
            arcs = [m.step(s, symbol) for m, s in zip(self.machines, state, strict=True)]
            got = self.known[state, symbol] = (tuple(a[0] for a in arcs), frozenset().union(*(a[1] for a in arcs)), sum(a[2] for a in arcs))
        return got

    def read(self, symbols: list[int]) -> list[tuple[int, frozenset]]:
        """(position, marks) wherever marks are set."""
        return [(i, marks) for i, marks, _ in self.weighed([(x, ONE) for x in symbols])]

    def weighed(self, written: list[tuple[int, float]]) -> list[tuple[int, frozenset, float]]:
        """(position, marks, weight) wherever marks are set; ``written``: classes and weights of the arcs that wrote them."""
        state, out = self.start, []
        for i, (symbol, before) in enumerate(written):
            state, marks, weight = self.step(state, symbol)
            if marks:
                out.append((i, marks, before + weight))
        return out


@dataclass
class Lexicon:
    """The machine from words to classes: ``entry`` gives the weight of a word's arc to INSULT, 0 where it has none."""

    classes: dict[str, int]
    entry: Callable[[str], float]

    def step(self, word: str) -> tuple[int, float]:
        weight = self.entry(word)
        return (INSULT, weight) if weight else (self.classes.get(word, OTHER), ONE)


@dataclass
class Reader:
    """The lexicon composed with a grammar: reads words, gives (position, marks, weight)."""

    lexicon: Lexicon
    grammar: Composed

    def read(self, words: list[str]) -> list[tuple[int, frozenset, float]]:
        return self.grammar.weighed([self.lexicon.step(w) for w in words])


def grammar() -> Composed:
    """Insult and threat, each with what stands before it in its clause: a target, a negation, a report of speech.

    A threat weighs 1, as its words are fixed; what an insult weighs comes from the lexicon's arc.
    """
    said = (INSULT, THREAT)
    return Composed(emits(INSULT, "insult"), emits(THREAT, "threat", 1.0), within(TARGET, "target", 4, said), within(NEGATION, "negated", 3, said), within(REPORT, "reported", 0, said))
