"""Pipelines: steps one after another, with middleware around those that come later."""

from __future__ import annotations

import copy
from collections.abc import Callable
from typing import Any

from ..functions.udf import python_step
from ..plans import nodes as N
from ..plans.export import JSON, data_type


class Pipeline(N.Type):
    """step: unchecked, step_checked: with the check of a sequence. around(fn): fn(type) gives the wrapped later step.

    Subclasses may set class_around and override prepare_step."""

    class_around: tuple[Callable[[N.Type], N.Type], ...] = ()

    def __init__(self, inner: N.Type | None = None, arounds: tuple = ()):
        self.inner = inner or N.Any()
        self.arounds = arounds

    def __eq__(self, other):
        return type(self) is type(other) and self.inner == other.inner

    def __hash__(self):
        return hash(self.inner)

    @property
    def input_type(self):
        return self.inner.input_type

    @property
    def output_type(self):
        return self.inner.output_type

    @property
    def preserving(self):
        return self.inner.preserving

    def children(self):
        return (self.inner,)

    def rebuilt(self, children):
        return type(self)(children[0], self.arounds)

    def lower(self, c, path):
        return self.inner.lower(c, path)

    def prepare_step(self, t: N.Type) -> N.Type:
        return t

    def _step(self, t: Any, fn: Callable | None, checked: bool) -> Pipeline:
        made = N.wrap(t) if fn is None else N.wrap(t).transform(N.Any(), fn)
        made = self.prepare_step(made)
        for around in (*self.class_around, *self.arounds):
            made = N.wrap(around(made))
        return type(self)(self.inner >> made if checked else N.Seq(self.inner, made) if not isinstance(self.inner, N.Any) else made, self.arounds)

    def step(self, t: Any, fn: Callable | None = None) -> Pipeline:
        return self._step(t, fn, False)

    def step_checked(self, t: Any, fn: Callable | None = None) -> Pipeline:
        return self._step(t, fn, True)

    def around(self, fn: Callable[[N.Type], N.Type]) -> Pipeline:
        return type(self)(self.inner, (*self.arounds, fn))


class Step(N.Type):
    """A typed step as a class: set takes and gives, and write apply, a function of Columns. Its input is checked before and
    what it gives after; steps with equal state are equal.

    class Doubled(Step):
        takes, gives = Integer, Integer
        def apply(self, c): return c * 2

    in_python: apply gets and gives single values in Python; what it raises of the classes in rescued is an error.
    """

    takes: Any = N.Any()
    gives: Any = N.Any()
    guaranteed = False
    in_python = False
    rescued: tuple[type[BaseException], ...] = ()

    def apply(self, c):
        raise NotImplementedError

    def as_convert(self) -> N.Convert:
        fn = python_step(self.apply, data_type(N.wrap(self.gives)), self.rescued) if self.in_python else self.apply
        return N.Convert(N.wrap(self.takes), N.wrap(self.gives), fn, type(self).__name__, self.guaranteed)

    def rescuing(self, *classes: type[BaseException]) -> Step:
        made = copy.copy(self)
        made.rescued = tuple(dict.fromkeys((*self.rescued, *classes)))
        return made

    def __eq__(self, other):
        return type(self) is type(other) and vars(self) == vars(other)

    def __hash__(self):
        return hash((type(self), tuple(sorted(map(str, vars(self).items())))))

    def __repr__(self):
        return type(self).__name__

    @property
    def input_type(self):
        return N.wrap(self.takes).input_type

    @property
    def output_type(self):
        return N.wrap(self.gives).output_type

    def children(self):
        return ()

    def lower(self, c, path):
        return self.as_convert().lower(c, path)


@JSON.on(Pipeline)
def _pipeline_schema(t, defs):
    return JSON.visit(t.inner, defs)


@JSON.on(Step)
def _step_schema(t, defs):
    return JSON.visit(t.as_convert(), defs)
