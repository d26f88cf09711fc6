"""Deterministic weighted finite-state transducers over token classes, and their composition."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable

State = Hashable
#: (state, symbol) -> (next state, output symbol, weight)
Step = Callable[[State, str], tuple[State, str, float]]


class Transducer:
    """A machine that reads one symbol and writes one at each step; weights of a path are added."""

    def __init__(self, start: State, step: Step):
        self.start, self.step = start, step

    def __rshift__(self, after: Transducer) -> Transducer:
        """The composition: what self writes, `after` reads."""

        def step(state: State, symbol: str) -> tuple[State, str, float]:
            (a, b) = state
            a, middle, w = self.step(a, symbol)
            b, out, v = after.step(b, middle)
            return (a, b), out, w + v

        return Transducer((self.start, after.start), step)

    def compiled(self, alphabet: Iterable[str], most: int = 100_000) -> tuple[list[dict[str, tuple[int, str, float]]], dict]:
        """A table of all states that can be reached: table[state][symbol] = (next, output, weight)."""
        alphabet, number, table, todo = list(alphabet), {self.start: 0}, [], [self.start]
        for state in todo:
            row = {}
            for symbol in alphabet:
                to, out, weight = self.step(state, symbol)
                if to not in number:
                    if len(number) >= most:
                        raise ValueError("the composition has too many states")
                    number[to] = len(number)
                    todo.append(to)
                row[symbol] = (number[to], out, weight)
            table.append(row)
        return table, number


def window(trigger: str, reads: dict[str, str], reach: int | None, weight: float = 0.0, closes: Iterable[str] = ()) -> Transducer:
    """After a trigger, symbols in `reads` are rewritten: for the next `reach` symbols, or (None) until the clause ends.

    closes: symbols that end the window early. Everything else passes unchanged.
    """
    closing = set(closes)

    def step(left: State, symbol: str) -> tuple[State, str, float]:
        if symbol == "END" or symbol in closing:
            return 0, symbol, 0.0
        if symbol == trigger:
            return -1 if reach is None else reach, symbol, 0.0
        left_after = left if left == -1 else max(0, left - 1)
        if left and symbol in reads:
            return left_after, reads[symbol], weight
        return left_after, symbol, 0.0

    return Transducer(0, step)
