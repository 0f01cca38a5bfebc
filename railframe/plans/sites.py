"""Places inside arrays and maps that a lambda cannot serve: steps in Python, which Spark refuses there, and types that hold
themselves, which go on in another job.

A type with such places is lowered for an element as any other, several times: for each step in Python once to find what it
is given (the arguments of all elements, as an array of the array's shape), which the step then makes its results of in one
call, outside the lambda; and a last time, where every place takes its result from those, by the element's index.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cells import Cell, Out, let, staged

Element = Callable[[Column, Column], Out]


class Lift:
    """One lowering of the type of an array's elements. results: what the places so far made of this element."""

    def __init__(self, results: list[Column], target: int | None):
        self.results, self.target = results, target
        self.visited = 0
        self.given: Column | None = None
        self.place: tuple[Any, bool, int] | None = None  # the step, whether it takes JSON, and how deep it stands


_LIFTS: list[Lift] = []


def python_result(step: Any, given: Column, in_json: bool) -> Column:
    """struct<v, ok, e> of a step in Python for struct<v, ok>, where the type is lowered now."""
    if not _LIFTS:
        return staged(step.column(staged(given), in_json=in_json))
    lift = _LIFTS[-1]
    n = lift.visited
    lift.visited += 1
    if n < len(lift.results):
        return lift.results[n]
    if n == lift.target:
        lift.given, lift.place = given, (step, in_json, 0)
    return F.lit(None).cast(step.made)


def each(array: Column, element: Element) -> tuple[Column, Out]:
    """The array with struct<v, ok, e> in place of its elements, and what the type makes of one (for its column type only).

    element(x, i) lowers the type for the element x with the index i."""
    return inner(array, element) if _LIFTS else outermost(array, element)


def outermost(array: Column, element: Element) -> tuple[Column, Out]:
    results: list[Column] = []

    def mapped(target: int | None, take: Callable[[Lift, Out], Column]) -> tuple[Column, Lift, Out]:
        seen = []

        def body(x: Column, i: Column, own: list[Column]) -> Column:
            lift = Lift([F.get(r, i) for r in own], target)
            _LIFTS.append(lift)
            try:
                o = element(x, i)
                taken = take(lift, o)
            finally:
                _LIFTS.pop()
            seen.append((lift, o))
            return taken

        if not results:
            made = F.transform(array, lambda x, i: body(x, i, []))
        else:  # bound outside of the lambda, in which no step in Python may stand
            names = [f"r{n}" for n in range(len(results))]
            packed = F.struct(array.alias("x"), *(r.alias(n) for r, n in zip(results, names)))
            made = let(packed, lambda s: F.transform(s["x"], lambda x, i: body(x, i, [s[n] for n in names])))
        return (made, *seen[-1])

    _, lift, _ = mapped(None, lambda lift, o: F.lit(0))
    for n in range(lift.visited):
        given, lift, _ = mapped(n, lambda lift, o: lift.given)
        step, in_json, depth = lift.place
        results.append(staged(step.column(staged(given), depth + 1, in_json)))
    made, _, o = mapped(None, lambda lift, o: o.whole())
    return staged(made), o


def inner(array: Column, element: Element) -> tuple[Column, Out]:
    lift = _LIFTS[-1]
    outer, start = lift.results, lift.visited
    seen = []

    def body(x: Column, i: Column, take: Callable[[Out], Column]) -> Column:
        lift.results, lift.visited = outer[:start] + [F.get(r, i) for r in outer[start:]], start
        try:
            o = element(x, i)
            seen.append(o)
            return take(o)
        finally:
            lift.results = outer

    before = lift.given
    made = F.transform(array, lambda x, i: body(x, i, lambda o: o.whole()))
    if lift.given is not before:  # the place that is looked for is in here
        lift.given = F.transform(array, lambda x, i: body(x, i, lambda o: lift.given))
        step, in_json, depth = lift.place
        lift.place = step, in_json, depth + 1
    return made, seen[0]


# --- types that hold themselves ---------------------------------------------------------------

#: A value where a type that holds itself is not unrolled further.
PENDING = "array<struct<key:string,path:string,which:int,value:variant>>"


class Found:
    """The values at which a lowering stops. makes: what makes the types that go on there."""

    def __init__(self):
        self.columns: list[Column] = []
        self.makes: list[Callable] = []

    def at(self, make: Callable, path: Column, c: Cell) -> None:
        if make not in self.makes:
            self.makes.append(make)
        which = self.makes.index(make)
        own = F.struct(key(which, path).alias("key"), path.alias("path"), F.lit(which).alias("which"), c.value.alias("value"))
        self.columns.append(F.when(c.some(), F.array(own)).otherwise(F.array()).cast(PENDING))

    def column(self) -> Column:
        return F.concat(*self.columns) if self.columns else F.array().cast(PENDING)


_FOUND: list[Found] = []


def key(which: int, path: Column) -> Column:
    return F.concat(F.lit(f"{which}:"), path)


@contextmanager
def finding(found: Found):
    _FOUND.append(found)
    try:
        yield found
    finally:
        _FOUND.pop()


def found_now() -> Found | None:
    return _FOUND[-1] if _FOUND else None


def found_in(array: Column, element: Element) -> Out:
    """Note the values that an array's elements stop at; what an element's type makes, for its column type only."""
    found = _FOUND[-1]
    outer, found.columns = found.columns, []
    seen = []

    def body(x: Column, i: Column) -> Column:
        found.columns = []
        seen.append(element(x, i))
        return found.column()

    lists = F.transform(array, body)
    own, found.columns = found.columns, outer
    if own:
        found.columns = [*outer, F.coalesce(F.flatten(lists), F.array().cast(PENDING))]
    return seen[-1]

