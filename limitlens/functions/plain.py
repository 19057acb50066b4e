"""Patterns that are plain: alternatives of characters, character classes and word boundaries.

Every match of an alternative has the same length, so it can be told from the characters that stand
at a place, without a regex engine. Only ASCII patterns are plain, read as with ``REGEX_FLAGS``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

import pandas as pd
from pyspark.sql import Column, functions as F

#: Alternatives and characters of a plain pattern at most; others are left to the regex engine.
MOST, LONGEST = 64, 256
_SPECIAL = set(".^$*+?{}[]()|\\")
# Characters that stand for themselves, as far as no quantifier follows.
_RUN = re.compile(r"[A-Za-z0-9_ ]+(?![A-Za-z0-9_ *+?{])")
#: A place within one of a rule's alternatives is alternative * STEP + place.
STEP = 512
#: Columns of ``encoded``: lengths of the alternatives, their characters end to end with NUL for a class, place and
#: bytes of the run each is looked up by, places of classes with the 128 bits of their characters, places of boundaries.
ENCODED = "sizes array<int>, held string, anchors array<int>, keys array<int>, sets array<int>, low array<bigint>, high array<bigint>, bounds array<int>"
#: Bytes that alternatives are looked up by; a run has the largest that it is as long as.
KEYS = (1, 2, 3, 4, 6, 8)


class _NotPlain(Exception):
    pass


@dataclass(frozen=True)
class Plain:
    """One alternative, in lower case: a character or the characters of a class for each place; offsets of boundaries."""

    places: tuple[str | frozenset[str], ...]
    bounds: tuple[int, ...] = ()

    def __add__(self, other: Plain) -> Plain:
        return Plain(self.places + other.places, self.bounds + tuple(b + len(self.places) for b in other.bounds))

    def runs(self) -> list[tuple[int, str]]:
        """(offset, text) of its runs of single characters."""
        out: list[tuple[int, str]] = []
        for i, place in enumerate(self.places):
            if isinstance(place, str):
                if out and out[-1][0] + len(out[-1][1]) == i:
                    out[-1] = (out[-1][0], out[-1][1] + place)
                else:
                    out.append((i, place))
        return out


class _Reader:
    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        char = self.peek()
        if not char or not " " <= char <= "~":
            raise _NotPlain
        self.at += 1
        return char

    def alternation(self) -> list[Plain]:
        out = self.sequence()
        while self.peek() == "|":
            self.at += 1
            out += self.sequence()
        if len(out) > MOST:
            raise _NotPlain
        return out

    def sequence(self) -> list[Plain]:
        out = [Plain(())]
        while self.peek() and self.peek() not in "|)":
            options = self.atom()
            if self.peek() == "?":
                self.at += 1
                if any(o.bounds and not o.places for o in options):
                    raise _NotPlain
                options = [*options, Plain(())]
            if self.peek() and self.peek() in "*+?{":
                raise _NotPlain
            # The engine tries the first parts' first choices first.
            out = [a + b for a, b in product(out, options)]
            if len(out) > MOST or any(len(o.places) > LONGEST for o in out):
                raise _NotPlain
        return out

    def atom(self) -> list[Plain]:
        if run := _RUN.match(self.text, self.at):
            self.at = run.end()
            return [Plain(tuple(run.group().lower()))]
        char = self.take()
        if char == "\\":
            char = self.take()
            if char == "b":
                return [Plain((), (0,))]
            if char.isalnum():
                raise _NotPlain
            return [Plain((char,))]
        if char == "[":
            return [Plain((self.character_class(),))]
        if char == "(":
            if self.peek() == "?":
                self.at += 1
                if self.take() != ":":
                    raise _NotPlain
            inner = self.alternation()
            if self.take() != ")":
                raise _NotPlain
            return inner
        if char in _SPECIAL:
            raise _NotPlain
        return [Plain((char.lower(),))]

    def character_class(self) -> frozenset[str]:
        out: set[str] = set()
        while (char := self.take()) != "]" or not out:
            if char == "\\":
                char = self.take()
                if char.isalnum():
                    raise _NotPlain
            elif char in "[]^&" or (char == "-" and self.peek() != "]"):
                raise _NotPlain
            last = char
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.at += 1
                last = self.take()
                if not (char.isalnum() and last.isalnum() and char <= last):
                    raise _NotPlain
            out.update(chr(c).lower() for c in range(ord(char), ord(last) + 1))
        return frozenset(out)


def plain_alternatives(pattern: str | None) -> list[Plain] | None:
    """The alternatives of a plain pattern, first choice first; None for any other pattern."""
    reader = _Reader(pattern or "")
    try:
        found = reader.alternation()
    except _NotPlain:
        return None
    return found if reader.at == len(reader.text) and all(a.runs() for a in found) else None


def encoded(pattern: Column, needs: Column) -> Column:
    """``ENCODED`` of the plain ones among patterns every match of which holds ``needs``; ``sizes`` is null for others."""

    @F.pandas_udf(f"struct<{', '.join(x.replace(' ', ':', 1) for x in ENCODED.split(', '))}>")
    def parts(patterns: pd.Series, needed: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_encoded(*x) for x in zip(patterns, needed)], columns=[x.split()[0] for x in ENCODED.split(", ")], dtype=object)

    return parts(pattern, needs)


def _encoded(pattern: str | None, needs: str | None) -> tuple:
    found = plain_alternatives(pattern)
    runs = [a.runs() for a in found or []]
    if found is None or (needs and not all(any(needs.lower() in run for _, run in own) for own in runs)):
        return (None,) * 8
    held = "".join(p if isinstance(p, str) else "\0" for a in found for p in a.places)
    longest = [max(own, key=lambda x: len(x[1])) for own in runs]
    classes = [(k * STEP + i, sum(1 << ord(c) for c in p)) for k, a in enumerate(found) for i, p in enumerate(a.places) if not isinstance(p, str)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return (
        [len(a.places) for a in found], held, [at for at, _ in longest], [max(k for k in KEYS if k <= len(run)) for _, run in longest],
        [at for at, _ in classes], [signed(x & (1 << 64) - 1) for _, x in classes], [signed(x >> 64) for _, x in classes],
        [k * STEP + b for k, a in enumerate(found) for b in a.bounds],
    )
