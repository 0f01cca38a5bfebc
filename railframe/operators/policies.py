"""Named combinators: a registry by name and kind, or by a method that values answer."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import functions as F

from ..functions import scalars
from ..plans import matchers as M
from ..plans import nodes as N
from ..plans.cells import Out, step
from ..plans.relation import kinds

_POLICIES: dict[str, list[tuple[str | None, Callable]]] = {}
_NONE = object()


def policy(name: str, for_type: str | None = None, helper: bool = False) -> Callable:
    """Register a function of (type, argument) under a name: for all types, for a kind, or for kinds with a method.

    helper: types get a method of that name."""

    def register(fn: Callable) -> Callable:
        _POLICIES.setdefault(name, []).insert(0, (for_type, fn))
        if helper and not hasattr(N.Type, name):
            setattr(N.Type, name, lambda self, *args: applied(self, name, *args))
        return fn

    return register


def applied(t: N.Type, name: str, arg: Any = _NONE) -> N.Type:
    own = kinds(t)

    def fits(wanted: str | None) -> bool:
        if wanted is None:
            return True
        if own is None:
            return False
        if wanted in M.KINDS:
            return all(M.is_a(k, wanted) for k in own)
        return all(wanted in scalars.CAPABILITIES.get(k, ()) for k in own)

    if name not in _POLICIES:
        raise KeyError(f"no policy {name}")
    # Those for a kind come before the general one.
    for wanted, fn in sorted(_POLICIES[name], key=lambda p: p[0] is None):
        if fits(wanted):
            made = fn(t) if arg is _NONE else fn(t, arg)
            data = () if arg is _NONE else ((name, tuple(arg) if isinstance(arg, list) else arg),)
            return N.Wrap(made, "policy", name, data)
    raise N.TypeMismatch(f"policy {name} is not for {t!r}")


def quoted(values: Any) -> str:
    return f"[{', '.join(map(M.shown, values))}]"


@policy("options", "array")
def _options_array(t, values):
    return t.check(lambda c: F.forall(c, lambda x: x.isin(*values)), f"must be included in {quoted(values)}")


@policy("options")
def _options(t, values):
    if isinstance(values, (list, tuple)):
        return t.check(M.OneOf(tuple(values)).column, f"must be included in {quoted(values)}")
    return t[values]


@policy("excluded_from", "array")
def _excluded_array(t, values):
    return t.check(lambda c: ~F.exists(c, lambda x: x.isin(*values)), f"must not be included in {quoted(values)}")


@policy("excluded_from")
def _excluded(t, values):
    return t.check(lambda c: ~M.OneOf(tuple(values)).column(c), f"must not be included in {quoted(values)}")


@policy("present")
def _present(t):
    return Present(t)


class Present(N.Refine):
    """Not empty, if the value can be; else not null. White space is present."""

    def __init__(self, base: N.Type):
        super().__init__(base, M.Custom(lambda c: c.isNotNull(), "must be present"))

    def rebuilt(self, children):
        return Present(children[0])

    def lower(self, c, path):
        def of(o: Out) -> Out:
            n = scalars.attribute("size", o.value, o.dtype)
            return N.judged_by(o, o.value.isNotNull() if n is None else F.coalesce(n > 0, F.lit(False)), path, "must be present")

        return step(self.base.lower(c, path), of)


@policy("nullable")
def _nullable(t):
    return N.Gate("nil") | t


@policy("respond_to")
def _respond_to(t, names):
    wanted = frozenset([names] if isinstance(names, str) else names)
    return N.Meet(t, N.Capability(wanted)) if not isinstance(t, N.Any) else N.Capability(wanted)


@policy("default")
def _default(t, v):
    made = N.Generate(v, t.output_type) if callable(v) else N.Static(v)
    return N.Choice(N.Seq(N.Undefined(), made), t)


@policy("rescue")
def _rescue(t, exceptions=()):
    """Exceptions of these classes (one or several) that a step in Python inside t raises are errors of its value, with their
    text; others fail the job. Conversions of Columns are try_ functions and raise nothing."""
    classes = exceptions if isinstance(exceptions, tuple) else (exceptions,)
    for c in classes:
        if not (isinstance(c, type) and issubclass(c, BaseException)):
            raise TypeError(f"{c!r} is not a class of exceptions")

    def guarded(x: N.Type) -> N.Type:
        if isinstance(x, N.Convert) and getattr(x.fn, "in_python", False):
            return N.Convert(x.inp, x.out, x.fn.rescuing(*classes), x.name, x.guaranteed)
        if isinstance(x, N.Check) and getattr(x.matcher, "in_python", False):
            return N.Check(x.base, x.matcher.rescuing(*classes), x.message)
        if isinstance(x, N.Deferred):
            return N.Deferred(lambda: N.transformed(x.target(), guarded), x.max_depth)
        return x.rescuing(*classes) if hasattr(x, "rescuing") else x

    return N.transformed(t, guarded) if classes else t


@policy("split", "string")
def _split(t, separator=","):
    return N.Convert(t, N.Array(N.Gate("string")), lambda c: scalars.split(c, separator), "split", guaranteed=True)
