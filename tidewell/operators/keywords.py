"""What a search asks for, as a tree: the syntax of web search boxes.

Words are all asked for, quoted ones in a row, ``-`` before a word or a quote excludes it, ``or`` between two
takes either; it binds less than words side by side.  Other signs only part words.  Several terms are joined by or.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column


@dataclass(frozen=True)
class Asked:
    """``kind``: 'run' (the words in a row), 'all', 'any' or 'not' (of its one part)."""

    kind: str
    words: tuple[str, ...] = ()
    parts: tuple[Asked, ...] = ()

    def holds(self, run: Callable[[tuple[str, ...]], Column]) -> Column:
        """Whether a text has what is asked for, by whether it has runs of words."""
        if self.kind == "run":
            return run(self.words)
        each = [p.holds(run) for p in self.parts]
        return ~each[0] if self.kind == "not" else reduce(lambda a, b: a & b if self.kind == "all" else a | b, each)

    def holds_of_none(self) -> bool:
        """Whether a text without any of the words has what is asked for."""
        each = [p.holds_of_none() for p in self.parts]
        return {"run": False, "all": all(each), "any": any(each), "not": not any(each)}[self.kind]

    def every_word(self) -> list[str]:
        return sorted({*self.words, *(w for p in self.parts for w in p.every_word())})


def split_words(text: str) -> tuple[str, ...]:
    return tuple(w for w in re.split(r"[^\w]|_", text.lower()) if w)


def _joined(kind: str, parts: list[Asked]) -> Asked | None:
    """The parts as one; parts of the same kind are taken in."""
    flat = [x for p in parts for x in (p.parts if p.kind == kind else (p,))]
    return Asked(kind, parts=tuple(flat)) if len(flat) > 1 else flat[0] if flat else None


_OPERAND = re.compile(r'"([^"]*)"?|([^\s"!&|()]+)')
_OR = re.compile(r"or(?![\w-])(?=.*\S)", re.IGNORECASE | re.DOTALL)


def parsed(term: str) -> Asked | None:
    """One term; None if it asks for nothing."""
    either: list[list[Asked]] = [[]]
    at, negated, wants_operand = 0, False, True
    while at < len(term):
        sign = term[at]
        if sign.isspace() or (wants_operand and sign in "!&|()"):
            at += 1
        elif not wants_operand:
            # Between operands: or, else all are asked for.
            if found := _OR.match(term, at):
                either.append([])
                at = found.end()
            wants_operand = True
        elif sign == "-":
            negated, at = not negated, at + 1
        else:
            found = _OPERAND.match(term, at)
            if words := split_words(found[1] if found[1] is not None else found[2]):
                run = Asked("run", words)
                either[-1].append(Asked("not", parts=(run,)) if negated else run)
            at, negated, wants_operand = found.end(), False, False
    return _joined("any", [x for group in either if (x := _joined("all", group))])


def parsed_terms(terms: list[str]) -> Asked | None:
    """All terms, of which any is enough."""
    return _joined("any", [x for t in terms if (x := parsed(t))])
