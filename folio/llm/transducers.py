"""Weighted finite-state transducers over small alphabets, and their composition.

A machine is deterministic: in each state a symbol leads along one arc, which writes one symbol and carries a weight;
ending in a state adds that state's final weight. Weights are vectors, one number a feature, added along a
path; what each feature is worth is learned afterwards, so a machine need not be built anew for it.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable

import numpy as np


class Transducer:
    """``arcs[state][symbol] = (next, written, weight)``, ``final[state] = weight``; a weight names its features."""

    def __init__(self, start: Hashable, arcs: dict, final: dict):
        self.start, self.arcs, self.final = start, arcs, final

    @classmethod
    def grown(cls, start: Hashable, alphabet: Iterable[str], move: Callable, final: Callable) -> Transducer:
        """The machine of all states that ``move(state, symbol) -> (next, written)`` reaches."""
        arcs: dict = {}
        todo = [start]
        while todo:
            s = todo.pop()
            if s in arcs:
                continue
            arcs[s] = {a: (*move(s, a), ()) for a in alphabet}
            todo += [to for to, _, _ in arcs[s].values()]
        return cls(start, arcs, {s: tuple(final(s)) for s in arcs})

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this machine writes, ``other`` reads. Weights of both add up."""
        start = (self.start, other.start)
        arcs: dict = {}
        todo = [start]
        while todo:
            pair = todo.pop()
            if pair in arcs:
                continue
            s, t = pair
            arcs[pair] = {}
            for a, (s2, b, w) in self.arcs[s].items():
                t2, c, v = other.arcs[t][b]
                arcs[pair][a] = ((s2, t2), c, w + v)
                todo.append((s2, t2))
        return Transducer(start, arcs, {(s, t): self.final[s] + other.final[t] for s, t in arcs})


class Compiled:
    """A transducer as tables, for byte symbols: the sum of path and final weights of an input."""

    def __init__(self, machine: Transducer, features: list[str]):
        self.features = features
        number = {s: i for i, s in enumerate(machine.arcs)}
        vector = lambda names: np.bincount([features.index(n) for n in names], minlength=len(features)).astype(float)
        self.start = number[machine.start]
        self.next = [{ord(a): number[to] for a, (to, _, _) in arcs.items()} for arcs in machine.arcs.values()]
        self.paid = {(number[s], ord(a)): vector(w) for s, arcs in machine.arcs.items() for a, (_, _, w) in arcs.items() if w}
        self.final = [vector(machine.final[s]) for s in machine.arcs]

    def weigh(self, symbols: bytes) -> np.ndarray:
        s, step, paid, total = self.start, self.next, self.paid, None
        for x in symbols:
            if paid and (w := paid.get((s, x))) is not None:
                total = w if total is None else total + w
            s = step[s][x]
        return self.final[s] if total is None else total + self.final[s]
