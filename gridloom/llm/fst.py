"""Weighted finite-state transducers over small alphabets: arcs, composition, heaviest path.

A machine reads one label an arc, writes one label and adds the arc's weight; of all paths that read a sequence and
stop in a final state, the heaviest counts. There are no arcs without a label.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterable
from dataclasses import dataclass, field


@dataclass
class Fst:
    start: Hashable
    final: set = field(default_factory=set)
    arcs: dict[Hashable, dict[str, list[tuple[str, float, Hashable]]]] = field(default_factory=dict)

    def arc(self, state: Hashable, read: str, write: str, to: Hashable, weight: float = 0.0) -> None:
        self.arcs.setdefault(state, {}).setdefault(read, []).append((write, weight, to))

    def best(self, sequence: Iterable[list[str]]) -> tuple[float, list[str]] | None:
        """Weight and written labels of the heaviest path; each place of the sequence has one label or more to choose from."""
        paths: dict[Hashable, tuple[float, tuple]] = {self.start: (0.0, ())}
        for labels in sequence:
            after: dict[Hashable, tuple[float, tuple]] = {}
            for state, (weight, written) in paths.items():
                arcs = self.arcs.get(state, {})
                for label in labels:
                    for write, more, to in arcs.get(label, ()):
                        if to not in after or weight + more > after[to][0]:
                            after[to] = (weight + more, (written, write))
            paths = after
        ends = [paths[s] for s in paths if s in self.final]
        if not ends:
            return None
        weight, chain = max(ends, key=lambda e: e[0])
        written = []
        while chain:
            chain, label = chain
            written.append(label)
        return weight, written[::-1]


def compose(first: Fst, second: Fst) -> Fst:
    """The machine that hands what ``first`` writes to ``second``: states are pairs, weights add."""
    out = Fst((first.start, second.start))
    todo, seen = [out.start], {out.start}
    while todo:
        state = a, b = todo.pop()
        if a in first.final and b in second.final:
            out.final.add(state)
        for read, arcs in first.arcs.get(a, {}).items():
            for middle, weight, to in arcs:
                for write, more, then in second.arcs.get(b, {}).get(middle, ()):
                    pair = (to, then)
                    out.arc(state, read, write, pair, weight + more)
                    if pair not in seen:
                        seen.add(pair)
                        todo.append(pair)
    return numbered(out)


def numbered(machine: Fst) -> Fst:
    """The same machine with whole numbers as states."""
    states = {machine.start: 0}
    for state, arcs in machine.arcs.items():
        states.setdefault(state, len(states))
        for some in arcs.values():
            for _, _, to in some:
                states.setdefault(to, len(states))
    return Fst(0, {states[s] for s in machine.final if s in states}, {states[s]: {r: [(w, v, states[t]) for w, v, t in some] for r, some in arcs.items()} for s, arcs in machine.arcs.items()})
