"""Small finite-state transducers over marked symbols, and their composition.

A letter of the tape is a symbol with marks.  A transducer reads a letter in a
state and gives the next state and the letter, possibly with more marks; in a
composition the second reads what the first writes.  ``compile_table`` lists the
states that can be reached from the start, so that a scan is one look-up per
letter.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from dataclasses import dataclass

OTHER, BREAK, COMMA, QUOTE, TARGET, NEGATION, REPORT, INTENT, VIOLENCE, INSULT = range(10)
SYMBOLS = range(10)

NEGATED, REPORTED, AIMED, MEANT = 16, 32, 64, 128
SYMBOL = 15
CORE = (INSULT, VIOLENCE)

# Words after a negation, a target or an intent, and after a match for its target, that it reaches.
NEGATION_REACH, TARGET_REACH, INTENT_REACH, AFTER_REACH = 3, 4, 4, 3

Step = Callable[[Hashable, int], tuple[Hashable, int]]


@dataclass(frozen=True)
class Transducer:
    start: Hashable
    step: Step

    def then(self, other: Transducer) -> Transducer:
        """The composition: ``other`` reads what this one writes."""

        def step(state: Hashable, letter: int) -> tuple[Hashable, int]:
            mine, theirs = state
            mine, letter = self.step(mine, letter)
            theirs, letter = other.step(theirs, letter)
            return (mine, theirs), letter

        return Transducer((self.start, other.start), step)


def reach(
    opens: int, words: int, mark: int, ends: tuple[int, ...], marked: tuple[int, ...] = CORE
) -> Transducer:
    """Marks such letters among the next ``words`` after a symbol; some symbols end the reach."""

    def step(left: int, letter: int) -> tuple[int, int]:
        symbol = letter & SYMBOL
        if symbol in ends:
            return 0, letter
        if symbol == opens:
            return words, letter
        return max(0, left - 1), letter | (mark if left and symbol in marked else 0)

    return Transducer(0, step)


def _reported(state: int, letter: int) -> tuple[int, int]:
    """0 outside, 1 after a reporting verb up to the end of the clause, 2 within quotation marks."""
    symbol = letter & SYMBOL
    if symbol == QUOTE:
        return (0 if state == 2 else 2), letter
    if symbol == BREAK:
        return 0, letter
    if symbol == REPORT and not state:
        return 1, letter
    return state, letter | (REPORTED if state and symbol in CORE else 0)


def _after(left: int, letter: int) -> tuple[int, int]:
    """Marks a target that follows a core letter closely: the match was aimed at it."""
    symbol = letter & SYMBOL
    if symbol in CORE:
        return AFTER_REACH, letter
    if symbol == BREAK:
        return 0, letter
    if symbol == TARGET and left:
        return 0, letter | AIMED
    return max(0, left - 1), letter


GRAMMAR = (
    Transducer(0, _reported)
    .then(reach(NEGATION, NEGATION_REACH, NEGATED, (BREAK, COMMA, QUOTE)))
    .then(reach(TARGET, TARGET_REACH, AIMED, (BREAK, QUOTE), (INSULT,)))
    .then(reach(INTENT, INTENT_REACH, MEANT, (BREAK, QUOTE), (VIOLENCE,)))
    .then(Transducer(0, _after))
)


def compile_table(machine: Transducer) -> list[list[tuple[int, int]]]:
    """For each state that can be reached, and each symbol: the next state and the letter written."""
    numbers, order, table = {machine.start: 0}, [machine.start], []
    for state in order:
        row = []
        for symbol in SYMBOLS:
            to, letter = machine.step(state, symbol)
            if to not in numbers:
                numbers[to] = len(order)
                order.append(to)
            row.append((numbers[to], letter))
        table.append(row)
    return table
