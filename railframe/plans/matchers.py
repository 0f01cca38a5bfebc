"""Matchers: what a refinement asks of a value, and what can be proven about two of them.

Answers are True (proven), False (disproven) or None (unknown); unknown never licenses a rewrite.
"""

from __future__ import annotations

import datetime
import decimal
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: kind -> the kinds that it is one of.
KINDS = {
    "string": {"string"},
    "symbol": {"symbol"},
    "integer": {"integer", "numeric"},
    "float": {"float", "numeric"},
    "decimal": {"decimal", "numeric"},
    "numeric": {"numeric"},
    "true": {"true", "boolean"},
    "false": {"false", "boolean"},
    "boolean": {"boolean"},
    "nil": {"nil"},
    "date": {"date"},
    "time": {"time"},
    "array": {"array"},
    "hash": {"hash"},
    "range": {"range"},
}

#: kind -> the name in messages.
NAMES = {"string": "String", "symbol": "Symbol", "integer": "Integer", "float": "Float", "decimal": "BigDecimal", "numeric": "Numeric", "true": "TrueClass", "false": "FalseClass", "boolean": "Boolean", "nil": "NilClass", "date": "Date", "time": "Time", "array": "Array", "hash": "Hash", "range": "Range"}


def kind_of(value: Any) -> str | None:
    """The kind of a Python value."""
    if value is None:
        return "nil"
    if isinstance(value, bool):
        return "true" if value else "false"
    for kind, types in (("integer", int), ("float", float), ("decimal", decimal.Decimal), ("string", str), ("time", datetime.datetime), ("date", datetime.date), ("array", (list, tuple)), ("hash", dict)):
        if isinstance(value, types):
            return kind
    return None


def is_a(kind: str | None, other: str) -> bool:
    return kind is not None and other in KINDS.get(kind, {kind})


def shown(value: Any) -> str:
    """A value as messages have it."""
    if value is None:
        return "nil"
    if isinstance(value, bool):
        return str(value).lower()
    return f'"{value}"' if isinstance(value, str) else str(value)


def literal(value: Any) -> Column:
    return F.array(*map(F.lit, value)) if isinstance(value, (list, tuple)) else F.lit(value)


def every(answers: list[bool | None]) -> bool | None:
    if any(a is False for a in answers):
        return False
    return True if all(a is True for a in answers) else None


class Matcher:
    def matches(self, value: Any) -> bool | None:
        return None

    def column(self, c: Column) -> Column:
        raise NotImplementedError

    def message(self) -> str:
        raise NotImplementedError

    def within(self, other: Matcher) -> bool | None:
        return True if self == other else None

    def meets(self, other: Matcher) -> bool | None:
        """Whether a value can match both."""
        return True if self == other else None


@dataclass(frozen=True)
class Kind(Matcher):
    name: str

    def matches(self, value):
        return is_a(kind_of(value), self.name)

    def message(self):
        return f"Must be a {NAMES[self.name]}"

    def within(self, other):
        if isinstance(other, Kind):
            return is_a(self.name, other.name)
        return None

    def meets(self, other):
        if isinstance(other, Kind):
            return is_a(self.name, other.name) or is_a(other.name, self.name)
        return other.meets(self) if isinstance(other, (Equal, OneOf, Between, Pattern)) else None


@dataclass(frozen=True)
class Equal(Matcher):
    value: Any

    def matches(self, value):
        return self.value == value and isinstance(self.value, bool) == isinstance(value, bool)

    def column(self, c):
        return c.eqNullSafe(literal(self.value))

    def message(self):
        return f"Must be equal to {self.value if self.value is not None else ''}"

    def within(self, other):
        if self == other:
            return True
        if isinstance(other, Kind) and other.name != "numeric" and kind_of(self.value) in ("integer", "float", "decimal"):
            return False if other.name not in KINDS["integer"] | KINDS["float"] | KINDS["decimal"] else None  # 5 == 5.0
        if isinstance(other, (Equal, OneOf, Between, Kind)):
            return other.matches(self.value)
        return other.matches(self.value) if isinstance(other, Pattern) and isinstance(self.value, str) else None

    def meets(self, other):
        if isinstance(other, Kind) and is_a(kind_of(self.value), "numeric"):
            return is_a(other.name, "numeric")
        return other.matches(self.value) if not isinstance(other, Custom) else None


@dataclass(frozen=True)
class OneOf(Matcher):
    values: tuple

    def matches(self, value):
        return any(Equal(v).matches(value) for v in self.values)

    def column(self, c):
        null = c.isNull() if any(v is None for v in self.values) else F.lit(False)
        rest = [v for v in self.values if v is not None]
        return F.coalesce(c.isin(*rest), F.lit(False)) | null if rest else null

    def message(self):
        return f"Must be included in [{', '.join(map(shown, self.values))}]"

    def within(self, other):
        if isinstance(other, OneOf):
            return every([other.matches(v) for v in self.values])
        return every([Equal(v).within(other) for v in self.values]) if isinstance(other, (Kind, Between, Pattern)) else None

    def meets(self, other):
        answers = [Equal(v).meets(other) for v in self.values]
        return True if any(answers) else (None if None in answers else False)


@dataclass(frozen=True)
class Between(Matcher):
    """An interval; None: open on that side. exclusive: without its end."""

    low: Any = None
    high: Any = None
    exclusive: bool = False

    def matches(self, value):
        try:
            above = self.low is None or value >= self.low
            return above and (self.high is None or (value < self.high if self.exclusive else value <= self.high))
        except TypeError:
            return False

    def column(self, c):
        parts = [] if self.low is None else [c >= F.lit(self.low)]
        if self.high is not None:
            parts.append(c < F.lit(self.high) if self.exclusive else c <= F.lit(self.high))
        out = c.isNotNull()
        for p in parts:
            out = out & p
        return out

    def message(self):
        dots = "..." if self.exclusive else ".."
        return f"Must be within {'' if self.low is None else self.low}{dots}{'' if self.high is None else self.high}"

    def ends(self):
        return [v for v in (self.low, self.high) if v is not None]

    def within(self, other):
        if isinstance(other, Between):
            try:
                low = other.low is None or (self.low is not None and self.low >= other.low)
                high = other.high is None or (self.high is not None and (self.high < other.high or self.high == other.high and (self.exclusive or not other.exclusive)))
            except TypeError:
                return None
            return low and high
        # A bound of one kind of number admits numbers of the others.
        return every([is_a(kind_of(v), other.name) for v in self.ends()]) if isinstance(other, Kind) and self.ends() and not is_a(kind_of(self.ends()[0]), "numeric") else None

    def meets(self, other):
        if isinstance(other, Between):
            found = intersected(self, other)
            return None if found is None else found != EMPTY
        if isinstance(other, Kind):
            ends = [kind_of(v) for v in self.ends()]
            return None if not ends else any(is_a(k, other.name) or is_a(k, "numeric") and is_a(other.name, "numeric") for k in ends)
        return other.meets(self) if isinstance(other, (Equal, OneOf)) else None


@dataclass(frozen=True)
class Pattern(Matcher):
    """A regular expression, found anywhere; ^ and $ stand at line ends, as in the reference's language."""

    source: str

    def matches(self, value):
        return isinstance(value, str) and re.search(self.source, value, re.MULTILINE) is not None

    def column(self, c):
        return F.coalesce(c.rlike(f"(?m){self.source}"), F.lit(False))

    def message(self):
        return f"Must match /{self.source}/"

    def within(self, other):
        if isinstance(other, Kind):
            return other.name == "string" or None
        return True if self == other else None

    def meets(self, other):
        if isinstance(other, Kind):
            return other.name in ("string", "symbol")
        return other.meets(self) if isinstance(other, (Equal, OneOf)) else None


@dataclass(frozen=True)
class Custom(Matcher):
    """A predicate from Column to boolean Column: opaque to the algebra, open to Catalyst."""

    test: Callable[[Column], Column]
    said: str = "is invalid"

    def column(self, c):
        return F.coalesce(self.test(c), F.lit(False))

    def message(self):
        return self.said


EMPTY = OneOf(())


def intersected(a: Matcher, b: Matcher) -> Matcher | None:
    """One matcher for both: sets and sets, intervals and intervals; EMPTY if nothing matches, None if unknown."""
    if isinstance(a, OneOf) and isinstance(b, OneOf):
        return OneOf(tuple(v for v in a.values if b.matches(v)))
    if isinstance(a, Between) and isinstance(b, Between):
        try:
            low = a.low if b.low is None or (a.low is not None and a.low >= b.low) else b.low
            ends = [(x.high, not x.exclusive) for x in (a, b) if x.high is not None]
            high, closed = min(ends) if ends else (None, True)
            if low is not None and high is not None and (low > high or low == high and not closed):
                return EMPTY
        except TypeError:
            return None
        return Between(low, high, not closed)
    return None


def matcher(raw: Any) -> Matcher:
    """A matcher from a Python value: matcher, pattern, set, slice (half open), callable on Columns, or literal."""
    if isinstance(raw, Matcher):
        return raw
    if isinstance(raw, re.Pattern):
        return Pattern(raw.pattern)
    if isinstance(raw, (set, frozenset)):
        return OneOf(tuple(sorted(raw, key=lambda v: (str(type(v)), str(v)))))
    if isinstance(raw, range):
        return Between(raw.start, raw.stop, True)
    if isinstance(raw, slice):
        return Between(raw.start, raw.stop, raw.stop is not None)
    return Custom(raw) if callable(raw) else Equal(raw)
