"""Type expressions: immutable trees of small types, each of which lowers to Columns.

A type consumes a cell and gives the value it makes of it, whether that is valid, and the errors. Sequences stop at the
first failure, choices try the original value again, containers gather all errors.
"""

from __future__ import annotations

import math
import re
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any as Obj

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars
from . import matchers as M
from . import sites
from .cells import ERRORS, LIGHT, TAGS, VARIANT, Cell, Out, bound, both, common, conj, family, fitted, gated, has_tag, in_lambda, let, no_errors, one_error, projected, staged, step


class TypeMismatch(TypeError):
    """A composition that can never pass, found when it is built."""


def prefix(path: Column) -> Column:
    """What names below a path begin with; the path stands in it once."""
    return F.concat_ws(".", F.array_remove(F.array(path), ""), F.lit(""))


def below(path: Column, start: Column, names: str = "") -> Column:
    """path, with its names told apart from what they begin with, so that names below it need not be made of the whole again."""
    vars(path)["_below"] = start, names
    return path


def at(path: Column, name: str) -> Column:
    start, names = vars(path).get("_below") or (prefix(path), "")
    names += f".{name}" if names else name
    return below(F.concat(start, F.lit(names)), start, names)


def quoted(values: Obj) -> str:
    return f"[{', '.join(map(M.shown, values))}]"


class Type:
    """What all type expressions can do."""

    # --- what relation.py and lowering ask -------------------------------------------------
    @property
    def input_type(self) -> Type:
        return self

    @property
    def output_type(self) -> Type:
        return self

    @property
    def preserving(self) -> bool:
        """Whether a valid value comes out as it went in."""
        return False

    def children(self) -> tuple[Type, ...]:
        return ()

    def rebuilt(self, children: tuple[Type, ...]) -> Type:
        return self

    def lower(self, c: Cell, path: Column) -> Out:
        raise NotImplementedError

    # --- composition ------------------------------------------------------------------------
    def __rshift__(self, other: Obj) -> Type:
        from . import relation

        return relation.sequence(self, wrap(other, self))

    def __truediv__(self, other: Obj) -> Type:
        return Seq(self, wrap(other, self))

    def __or__(self, other: Obj) -> Type:
        from . import relation

        return relation.choice(self, wrap(other))

    def __and__(self, other: Obj) -> Type:
        from . import relation

        return relation.meet(self, wrap(other))

    def __invert__(self) -> Type:
        return self.not_()

    def __getitem__(self, raw: Obj) -> Type:
        from . import relation

        return relation.refined(self, M.OneOf(raw) if isinstance(raw, tuple) else M.matcher(raw))

    match = __getitem__

    # --- the lattice ------------------------------------------------------------------------
    def __le__(self, other: Obj) -> bool:
        from . import relation

        return relation.subtype(self, wrap(other))

    def __lt__(self, other: Obj) -> bool:
        return self <= other and not self >= other

    def __ge__(self, other: Obj) -> bool:
        from . import relation

        return relation.subtype(wrap(other), self)

    def __gt__(self, other: Obj) -> bool:
        return self >= other and not self <= other

    # --- refinements and conversions --------------------------------------------------------
    def value(self, v: Obj) -> Type:
        return self[M.Equal(v)]

    def where(self, **attributes: Obj) -> Type:
        out: Type = self
        for name, raw in attributes.items():
            from . import relation

            out = relation.with_attribute(out, name, M.OneOf(raw) if isinstance(raw, tuple) else M.matcher(raw))
        return out

    def with_(self, **attributes: Obj) -> Type:
        warnings.warn("with_ is an old name of where", DeprecationWarning, stacklevel=2)
        return self.where(**attributes)

    def check(self, test: Callable[[Column], Column], message: str = "did not pass the check") -> Type:
        return Check(self, test, message)

    def not_(self, other: Obj = None) -> Type:
        inner = self if other is None else wrap(other)
        out = inner.inner if isinstance(inner, Not) and inner.message is None else Not(inner)
        return out if other is None else self >> out

    def invalid(self, errors: str) -> Type:
        return Not(self, errors)

    def transform(self, target: Obj, fn: Callable[[Column], Column] | str | None = None) -> Type:
        """Map a valid value with a function of Columns (or a named coercion), then check the target."""
        if fn is None and isinstance(target, str):
            return coerced(self, target)
        target = wrap(target)
        if isinstance(fn, str):
            _, dtype = scalars.COERCIONS[fn]
            made = {scalars.LONG: Gate("integer"), scalars.DOUBLE: Gate("float"), scalars.STRING: Gate("string")}.get(dtype)
            if made is not None and made <= target:
                return Convert(self, target, None, fn, guaranteed=True)
            if made is not None and not target <= made:
                raise TypeMismatch(f"{fn} never gives {target!r}")
            return Convert(self, target, None, fn)
        if fn is None:
            raise TypeError("a function from Column to Column is needed")
        return Convert(self, target, fn, getattr(fn, "__name__", "function"))

    def build(self, target: Obj, fn: Callable[[Column], Column]) -> Type:
        """Make an object: target may be a type or a Spark DataType of what fn makes."""
        return Convert(self, Foreign(target) if isinstance(target, T.DataType) else wrap(target), fn, getattr(fn, "__name__", "build"))

    def invoke(self, method: str | list[str], *args: Obj) -> Type:
        out: Type = self
        for m in [method] if isinstance(method, str) else method:
            if m not in scalars.METHODS:
                raise TypeMismatch(f"no method {m}")
            out = Invoke(out, m, args)
        return out

    def static(self, v: Obj) -> Type:
        if not isinstance(v, (str, int, float, bool, type(None))) and M.kind_of(v) not in ("decimal", "date", "time", "array"):
            raise TypeError("a static value must be a constant")
        if not Static(v) <= self.output_type:
            raise TypeMismatch(f"{v!r} is not a {self!r}")
        return Static(v)

    def generate(self, make: Callable[[], Column]) -> Type:
        return Seq(Generate(make, self.output_type), self)

    def defer(self) -> Type:
        return Deferred(lambda: self)

    def metadata(self, **data: Obj) -> Type:
        return Wrap(self, "metadata", "metadata", tuple(sorted(data.items(), key=lambda kv: kv[0])))

    def as_node(self, name: str, **data: Obj) -> Type:
        return Wrap(self, "label", name, tuple(data.items()))

    def named(self, name: str) -> Type:
        """The type under a name that messages, definitions and diagrams use; a name it had before goes."""
        return Wrap(self.inner if isinstance(self, Wrap) and self.role == "name" else self, "name", name)

    def pipeline(self) -> Obj:
        from ..operators.pipeline import Pipeline

        return Pipeline(self)

    # --- policies ---------------------------------------------------------------------------
    def policy(self, *names: str, **policies: Obj) -> Type:
        from ..operators import policies as P

        out: Type = self
        for name in names:
            out = P.applied(out, name)
        for name, arg in policies.items():
            out = P.applied(out, name, arg)
        return out

    def options(self, values: Obj) -> Type:
        return self.policy(options=values)

    def excluded_from(self, values: Obj) -> Type:
        return self.policy(excluded_from=values)

    def present(self) -> Type:
        return self.policy("present")

    def nullable(self) -> Type:
        return self.policy("nullable")

    def default(self, v: Obj) -> Type:
        return self.policy(default=v)

    def split(self, separator: str = ",") -> Type:
        return self.policy(split=separator)

    def rescue(self, *exceptions: type[BaseException]) -> Type:
        return self.policy(rescue=exceptions)

    # --- Columns ----------------------------------------------------------------------------
    def accepts(self, c: Column, dtype: T.DataType) -> Column:
        """Whether a column's values are valid."""
        return self.lower(Cell(c, dtype), F.lit("")).ok

    def to_json_schema(self, root: bool = False) -> dict:
        from .export import json_schema

        return json_schema(self, root)

    def to_mermaid(self, direction: str = "LR") -> str:
        from .export import mermaid

        return mermaid(self, direction)

    def to_struct_type(self) -> T.DataType:
        from .export import data_type

        return data_type(self)

    def collected_metadata(self) -> dict:
        from .export import metadata

        return metadata(self)


def wrap(raw: Obj, left: Type | None = None) -> Type:
    """A type from a Python value: dict (record), list (array), Python type, pattern, callable on Columns, literal."""
    if isinstance(raw, Type):
        return raw
    if hasattr(raw, "operand"):  # encoders and codecs choose their direction by where they stand
        return raw.operand(left)
    if isinstance(raw, type) and hasattr(raw, "schema") and hasattr(raw.schema, "lower"):
        return StructOf(raw)
    if isinstance(raw, dict):
        return record(raw)
    if isinstance(raw, list):
        return Array(wrap(raw[0]) if raw else Any())
    named = {str: "string", int: "integer", float: "float", bool: "boolean", type(None): "nil", dict: "hash", list: "array"}
    if isinstance(raw, type):
        import datetime
        import decimal

        named |= {decimal.Decimal: "decimal", datetime.date: "date", datetime.datetime: "time"}
        if raw not in named:
            raise TypeMismatch(f"{raw!r} has no column type")
        return Gate(named[raw])
    if callable(raw):
        return Convert(Any(), Any(), raw, getattr(raw, "__name__", "function"), guaranteed=True)
    return Refine(Any(), M.matcher(raw)) if isinstance(raw, (re.Pattern, set, frozenset, range, slice, M.Matcher)) else Equals(raw)


# --- tops, bottoms, leaves --------------------------------------------------------------------


@dataclass(frozen=True)
class Any(Type):
    preserving = True

    def lower(self, c, path):
        return Out(c.value, F.lit(True), no_errors, c.dtype, True, c.present, weight=c.weight, fields=c.fields)


@dataclass(frozen=True)
class Never(Type):
    preserving = True

    def lower(self, c, path):
        return gated(c, False, path, "Never")


@dataclass(frozen=True)
class Undefined(Type):
    """Passes only where there is no value at all."""

    preserving = True

    def lower(self, c, path):
        ok = not c.present if isinstance(c.present, bool) else ~c.present
        return gated(c, ok, path, "Must be undefined")


@dataclass(frozen=True)
class Gate(Type):
    """Values of one kind."""

    kind: str
    preserving = True

    def lower(self, c, path):
        said = M.Kind(self.kind).message()
        if c.present is False:
            return gated(c, False, path, said)
        here = c.here() if not isinstance(c.present, bool) else None
        if isinstance(c.dtype, T.VariantType):
            _, dtype = TAGS.get(self.kind, (r"^$", T.NullType()))
            ok = has_tag(c.around(), self.kind, c.place)
            value = F.lit(None) if self.kind == "nil" else F.when(ok, c.taken(dtype.simpleString()))
            if self.kind in ("true", "false"):
                ok = F.coalesce(ok & (value == (self.kind == "true")), F.lit(False))
            return gated(c, ok, path, said, value, dtype)
        kind = family(c.dtype)
        if self.kind == "nil":
            return gated(c, c.value.isNull() if here is None else here & c.value.isNull(), path, said)
        if self.kind in ("true", "false") and kind == "boolean":
            return gated(c, F.coalesce(c.value == (self.kind == "true"), F.lit(False)), path, said)
        if not (M.is_a(kind, self.kind) or (kind, self.kind) in (("string", "symbol"), ("range", "hash"))):
            return gated(c, False, path, said)
        return gated(c, True if c.row else c.value.isNotNull(), path, said)


@dataclass(frozen=True)
class Foreign(Type):
    """A Spark type for which there is no kind, as what build makes."""

    dtype: T.DataType
    preserving = True

    def lower(self, c, path):
        return gated(c, c.value.isNotNull() if c.dtype == self.dtype else False, path, f"Must be a {self.dtype.simpleString()}")


@dataclass(frozen=True)
class Equals(Type):
    """One literal, whatever its type."""

    literal: Obj
    preserving = True

    def lower(self, c, path):
        said = M.Equal(self.literal).message()
        kind = M.kind_of(self.literal)
        if c.present is False:
            return gated(c, False, path, said)
        if isinstance(c.dtype, T.VariantType):
            inner = Gate("numeric" if M.is_a(kind, "numeric") else kind).lower(c, path)
            return gated(c, inner.ok & F.coalesce(inner.value == F.lit(self.literal), F.lit(False)) if self.literal is not None else inner.ok, path, said, inner.value, inner.dtype)
        own = family(c.dtype)
        same = self.literal is None or M.is_a(own, "numeric") and M.is_a(kind, "numeric") or own == kind or own == "boolean" and kind in ("true", "false")
        return gated(c, M.Equal(self.literal).column(c.value) if same else False, path, said)


@dataclass(frozen=True)
class Static(Type):
    literal: Obj
    input_type = Any()

    @property
    def dtype(self) -> T.DataType:
        return _dtype_of(self.literal)

    def lower(self, c, path):
        return Out(M.literal(self.literal), F.lit(True), no_errors, _dtype_of(self.literal), True)


def _dtype_of(v: Obj) -> T.DataType:
    kind = M.kind_of(v)
    if kind == "array":
        return T.ArrayType(_dtype_of(v[0]) if v else T.StringType())
    return T.BooleanType() if kind in ("true", "false") else TAGS[kind][1] if kind else T.StringType()


@dataclass(frozen=True)
class Generate(Type):
    """A value from a function without arguments, such as uuid; once for each row."""

    make: Callable[[], Column]
    of: Type = Any()
    input_type = Any()

    @property
    def output_type(self):
        return self.of

    def lower(self, c, path):
        from .export import data_type

        return Out(self.make(), F.lit(True), no_errors, data_type(self.of), True)


# --- refinements ------------------------------------------------------------------------------


def applied_matcher(m: M.Matcher, o: Out, path: Column) -> Out:
    """A matcher on a value that passed so far; the errors are the failing step's."""
    if isinstance(m, M.Kind):
        return after(o, Gate(m.name), path)
    if isinstance(m, M.Equal):
        return after(o, Equals(m.value), path)
    return step(o, lambda i: tested(m, i, path))


def tested(m: M.Matcher, o: Out, path: Column) -> Out:
    if isinstance(o.dtype, T.VariantType):
        kinds = {M.kind_of(v) for v in (m.values if isinstance(m, M.OneOf) else m.ends() if isinstance(m, M.Between) else [""])}
        kind = "numeric" if kinds and all(M.is_a(k, "numeric") for k in kinds) else next(iter(kinds), "string")
        before, g = o, Gate(kind or "string").lower(o.cell(), path)
        o = Out(g.value, o.ok & g.ok, lambda: before.errors, g.dtype, both(o.known, g.known), o.present, weight=o.weight + g.weight)
    if isinstance(m, M.Pattern) and family(o.dtype) != "string" or isinstance(m, (M.OneOf, M.Between)) and not comparable(m, o.dtype):
        return gated(o.cell(), False, path, m.message())
    if isinstance(m, M.OneOf) and not m.values:
        return gated(o.cell(), False, path, m.message())
    return judged_by(o, m.column(o.value), path, m.message())


def judged_by(o: Out, test: Column, path: Column, message: str) -> Out:
    """o where test holds too."""

    def errors() -> Column:
        own = F.when(test, no_errors()).otherwise(one_error(path, message))
        return own if o.known else F.when(~o.ok, o.errors).otherwise(own)

    return Out(o.value, test if o.known else o.ok & test, errors, o.dtype, False if o.known is False else None, o.present, weight=2 * o.weight)


def comparable(m: M.OneOf | M.Between, dtype: T.DataType) -> bool:
    kinds = {M.kind_of(v) for v in (m.values if isinstance(m, M.OneOf) else m.ends())} - {"nil"}
    own = family(dtype)
    fits = lambda k: k == own or M.is_a(k, "numeric") and M.is_a(own, "numeric") or own == "boolean" and k in ("true", "false") or {k, own} == {"date", "time"}
    return all(map(fits, kinds))


def after(o: Out, t: Type, path: Column) -> Out:
    """t on the value that o made; where o failed, o's value and errors."""
    return o if o.known is False else step(o, lambda i: followed(i, t, path), in_columns(t))


def followed(o: Out, t: Type, path: Column) -> Out:
    n = t.lower(o.cell(), path)
    if o.known:
        return n
    dtype = n.dtype if not isinstance(n.dtype, T.NullType) else o.dtype
    ok = o.ok if n.known else n.ok if n.known is False else o.ok & n.ok
    return Out(n.value, ok, lambda: F.when(~o.ok, o.errors).otherwise(n.errors), dtype, False if n.known is False else None, n.present, n.fields, weight=2 * o.weight + n.weight)


def in_columns(t: Type, opened: tuple = ()) -> bool:
    """Whether a type is made of Column functions only, and none of them runs in Python."""
    if isinstance(t, Deferred):
        return t.make in opened or in_columns(t.target(), (*opened, t.make))
    own = (t, getattr(t, "fn", None), t.matcher if isinstance(t, Check) else None)
    return not any(getattr(x, "in_python", False) for x in own) and all(in_columns(c, opened) for c in t.children())


def holds_itself(t: Type) -> bool:
    return isinstance(t, Deferred) or any(map(holds_itself, t.children()))


def looked_up(t: Type) -> bool:
    """Whether results are looked up by the path of a value, so that it is needed for more than errors."""
    return isinstance(t, Deferred) and t.judged is not None or any(map(looked_up, t.children()))


def ran(step: Obj, i: Out) -> Column:
    """What a step in Python makes of a value: struct<v, ok, e>."""
    if isinstance(i.dtype, T.VariantType):
        return sites.python_result(step, F.struct(F.to_json(i.value).alias("v"), i.ok.alias("ok")), True)
    return sites.python_result(step, F.struct(i.judged()["v"].alias("v"), i.judged()["ok"].alias("ok")) if i.known is None else F.struct(i.value.alias("v"), i.ok.alias("ok")), False)


def element_errors(pairs: Column, own: Column) -> Column:
    return F.coalesce(F.flatten(F.transform(pairs, lambda s: s["e"])), own)


@dataclass(frozen=True)
class Refine(Type):
    base: Type
    matcher: M.Matcher

    @property
    def input_type(self):
        return self.base.input_type

    @property
    def output_type(self):
        return self if self.base.preserving else Refine(self.base.output_type, self.matcher)

    @property
    def preserving(self):
        return self.base.preserving

    def children(self):
        return (self.base,)

    def rebuilt(self, children):
        return Refine(children[0], self.matcher)

    def lower(self, c, path):
        return applied_matcher(self.matcher, self.base.lower(c, path), path)


@dataclass(frozen=True)
class Check(Refine):
    """A predicate of the user on the value, with its message."""

    base: Type
    matcher: Callable[[Column], Column]
    message: str

    @property
    def output_type(self):
        return self if self.base.preserving else Check(self.base.output_type, self.matcher, self.message)

    def rebuilt(self, children):
        return Check(children[0], self.matcher, self.message)

    def lower(self, c, path):
        o = self.base.lower(c, path)
        if not getattr(self.matcher, "in_python", False) or o.known is False:
            return applied_matcher(M.Custom(self.matcher, self.message), o, path)
        r = ran(self.matcher, o)
        test = F.coalesce(r["ok"] & r["v"], F.lit(False))
        said = lambda: F.when(~o.ok, o.errors).when(test, no_errors()).otherwise(one_error(path, F.coalesce(r["e"], F.lit(self.message))))
        return Out(o.value, o.ok & test, said, o.dtype, None, o.present, weight=10 * LIGHT)


@dataclass(frozen=True)
class Attr(Refine):
    """A matcher on an attribute of the value, such as its size; a value without it fails."""

    base: Type
    matcher: M.Matcher
    name: str

    @property
    def output_type(self):
        return self if self.base.preserving else Attr(self.base.output_type, self.matcher, self.name)

    def rebuilt(self, children):
        return Attr(children[0], self.matcher, self.name)

    def lower(self, c, path):
        said = f"must have {self.name} that {self.matcher.message()[0].lower()}{self.matcher.message()[1:]}"

        def of(o: Out) -> Out:
            found = scalars.attribute(self.name, o.value, o.dtype)
            if found is None:
                return after(o, Never(), path) if o.known is not True else gated(o.cell(), False, path, said)
            return judged_by(o, F.coalesce(self.matcher.column(found), F.lit(False)), path, said)

        return step(self.base.lower(c, path), of)


# --- logic ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Not(Type):
    inner: Type
    message: str | None = None
    preserving = True

    def children(self):
        return (self.inner,)

    def rebuilt(self, children):
        return Not(children[0], self.message)

    def lower(self, c, path):
        i = self.inner.lower(c, path)
        return gated(c, not i.known if i.known is not None else ~i.ok, path, self.message or f"must not be {self.inner!r}")


@dataclass(frozen=True)
class Seq(Type):
    """left, then right on what left made."""

    left: Type
    right: Type

    @property
    def input_type(self):
        return self.left.input_type

    @property
    def output_type(self):
        from . import relation

        if not self.right.preserving:
            return self.right.output_type
        found = relation.met(self.left.output_type, self.right)
        return self.right if type(found) is Seq else found

    def children(self):
        return self.left, self.right

    def rebuilt(self, children):
        return Seq(*children)

    def lower(self, c, path):
        return after(self.left.lower(c, path), self.right, path)


@dataclass(frozen=True)
class Meet(Seq):
    """Two filters on one value."""

    preserving = True

    @property
    def input_type(self):
        return self.left.input_type

    @property
    def output_type(self):
        return self

    def rebuilt(self, children):
        return Meet(*children)


@dataclass(frozen=True)
class Choice(Type):
    """left, or else right on the original value."""

    left: Type
    right: Type

    @property
    def input_type(self):
        return Choice(self.left.input_type, self.right.input_type)

    @property
    def output_type(self):
        return self if self.preserving else Choice(self.left.output_type, self.right.output_type)

    @property
    def preserving(self):
        return self.left.preserving and self.right.preserving

    def children(self):
        return self.left, self.right

    def rebuilt(self, children):
        return Choice(*children)

    def lower(self, c, path):
        a = self.left.lower(c, path)
        if a.known:
            return a
        b = self.right.lower(c, path)
        if a.known is None and b.known is not False and a.weight + b.weight > LIGHT and in_columns(self):
            return bound([a, b], self.either)
        return self.either(a, b)

    def either(self, a: Out, b: Out) -> Out:
        none_of_both = lambda test: F.when(test, no_errors()).otherwise(F.concat(a.errors, b.errors))
        weight = a.weight + b.weight
        if a.known is False:
            return Out(b.value, b.ok, no_errors if b.known else lambda: none_of_both(b.ok), b.dtype, b.known, b.present, b.fields, weight=weight)
        if b.known is False:
            return Out(a.value, a.ok, lambda: none_of_both(a.ok), a.dtype, None, a.present, a.fields, weight=weight)
        null = isinstance(self.left, Gate) and self.left.kind == "nil"  # its value has no type of its own
        dtype = b.dtype if null else common(a.dtype, b.dtype)
        value = F.when(~a.ok & b.ok, b.value) if null else F.when(a.ok, fitted(a.value, a.dtype, dtype)).when(b.ok, fitted(b.value, b.dtype, dtype))
        present = True if a.present is True and b.present is True else F.when(a.ok, a.cell().here()).otherwise(b.cell().here())
        return Out(value, F.lit(True) if b.known else a.ok | b.ok, no_errors if b.known else lambda: none_of_both(a.ok | b.ok), dtype, True if b.known else None, present, weight=weight)


# --- conversions ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Convert(Type):
    """Check the input, map it, check what came out (unless that is guaranteed)."""

    inp: Type
    out: Type
    fn: Callable[[Column], Column] | None
    name: str
    guaranteed: bool = False

    @property
    def input_type(self):
        return self.inp.input_type

    @property
    def output_type(self):
        return self.out.output_type

    def children(self):
        return self.inp, self.out

    def rebuilt(self, children):
        return Convert(*children, self.fn, self.name, self.guaranteed)

    def lower(self, c, path):
        i = self.inp.lower(c, path)
        return i if i.known is False else step(i, lambda o: self.mapped(o, path), in_columns(self))

    def mapped(self, i: Out, path: Column) -> Out:
        from .export import data_type

        dtype = data_type(self.out)
        if getattr(self.fn, "in_python", False):
            return self.mapped_in_python(i, path)
        if self.fn is None:
            raw, made = scalars.COERCIONS[self.name][0](i.value, i.dtype), scalars.COERCIONS[self.name][1] or i.dtype
        else:
            raw, made = self.fn(i.value), inferred(self.fn, i.dtype) if isinstance(self.out, Any) else dtype if not isinstance(dtype, T.NullType) else i.dtype
        raw = raw if i.known else F.when(i.ok, raw)
        mapped = Out(raw, i.ok, lambda: i.errors, made, i.known, weight=2 * i.weight)
        return mapped if self.guaranteed and isinstance(self.out, Any) else after(mapped, Gate_of(self.out, made) if self.guaranteed else self.out, path)

    def mapped_in_python(self, i: Out, path: Column) -> Out:
        r = ran(self.fn, i)
        ok = F.coalesce(r["ok"], F.lit(False))
        said = lambda: F.when(~i.ok, i.errors).when(ok, no_errors()).otherwise(one_error(path, F.coalesce(r["e"], F.lit("no result"))))
        mapped = Out(r["v"], ok, said, self.fn.dtype, None, weight=10 * LIGHT)
        return mapped if isinstance(self.out, Any) else after(mapped, self.out, path)


def inferred(fn: Callable[[Column], Column], dtype: T.DataType) -> T.DataType:
    """The type of what a function of Columns makes of a column, of which nothing is declared: Spark says it, without a job."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return dtype
    return spark.createDataFrame([], T.StructType([T.StructField("v", dtype)])).select(fn(F.col("v"))).schema[0].dataType


def Gate_of(out: Type, made: T.DataType) -> Type:
    """What remains to check of a guaranteed result: that there is one, as try_ functions give null for what they cannot convert."""
    return Gate(family(made)) if family(made) else out


@dataclass(frozen=True)
class Invoke(Type):
    """A named method of the value; what it gives is not declared."""

    inp: Type
    method: str
    args: tuple = ()

    @property
    def input_type(self):
        return self.inp.input_type

    @property
    def output_type(self):
        kept = ("downcase", "upcase", "strip", "reverse", "uniq", "sort", "except", "filter", "transform_values", "transform_keys", "succ", "abs", "*", "+", "%")
        return base_of(self.inp.output_type) if self.method in kept else Any()

    def children(self):
        return (self.inp,)

    def rebuilt(self, children):
        return Invoke(children[0], self.method, self.args)

    def lower(self, c, path):
        i = self.inp.lower(c, path)
        return i if i.known is False else step(i, self.called)

    def called(self, i: Out) -> Out:
        raw = scalars.METHODS[self.method](i.value, i.dtype, *self.args)
        made = i.dtype
        if self.method in ("size", "length", "year", "month", "day"):
            made = T.IntegerType()
        elif self.method == "extract":
            made = T.StringType()
        elif self.method in ("first", "last", "[]") and isinstance(i.dtype, (T.ArrayType, T.MapType, T.StructType)):
            made = i.dtype.elementType if isinstance(i.dtype, T.ArrayType) else i.dtype.valueType if isinstance(i.dtype, T.MapType) else i.dtype[self.args[0]].dataType
        elif self.method in ("keys", "values"):
            made = T.ArrayType(i.dtype.keyType if self.method == "keys" else i.dtype.valueType)
        elif self.method == "except" and isinstance(i.dtype, T.StructType):
            made = T.StructType([f for f in i.dtype if f.name not in self.args])
        return Out(raw if i.known else F.when(i.ok, raw), i.ok, lambda: i.errors, made, i.known, i.present, weight=2 * i.weight)


def base_of(t: Type) -> Type:
    """A type without its refinements."""
    while isinstance(t, (Refine, Wrap)):
        t = t.base if isinstance(t, Refine) else t.inner
    return t


def coerced(t: Type, name: str) -> Type:
    """The shorthand transform("to_i")."""
    if name in ("to_r", "to_c", "to_proc"):
        raise TypeMismatch(f"{name}: Spark has no such type")
    if name not in scalars.COERCIONS:
        raise TypeMismatch(f"no conversion {name}")
    base = base_of(t.output_type)
    if isinstance(base, Gate) and name not in scalars.CAPABILITIES.get(base.kind, {name}) and base.kind not in ("numeric", "array", "hash"):
        raise TypeMismatch(f"{base!r} has no {name}")
    targets = {"to_s": Gate("string"), "to_sym": Gate("symbol"), "to_i": Gate("integer"), "to_f": Gate("float"), "to_a": Gate("array"), "to_h": Gate("hash")}
    return Convert(t, targets[name], None, name, guaranteed=True)


# --- containers -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Key:
    name: str
    optional: bool = False


@dataclass(frozen=True)
class Record(Type):
    """Declared fields, then typed keys (first match wins), then the catch-all; other keys are dropped. All errors are gathered."""

    fields: tuple[tuple[Key, Type], ...] = ()
    typed: tuple[tuple[Type, Type], ...] = ()
    rest: Type | None = None

    @property
    def output_type(self):
        if all(t.output_type is t for t in self.children()):
            return self
        return Record(tuple((k, t.output_type) for k, t in self.fields), tuple((k, t.output_type) for k, t in self.typed), self.rest and self.rest.output_type)

    @property
    def closed(self) -> Record:
        return Record(self.fields, self.typed, Never())

    def children(self):
        return (*(t for _, t in self.fields), *(t for _, t in self.typed), *([self.rest] if self.rest else []))

    def rebuilt(self, children):
        n, m = len(self.fields), len(self.typed)
        return Record(tuple((k, c) for (k, _), c in zip(self.fields, children)), tuple((k, c) for (k, _), c in zip(self.typed, children[n:])), children[n + m] if self.rest else None)

    def at_key(self, name: str) -> Type | None:
        return next((t for k, t in self.fields if k.name == name), None)

    def to_h(self) -> dict[str, Type]:
        return {k.name + "?" * k.optional: t for k, t in self.fields}

    def __add__(self, other: Obj) -> Record:
        other = wrap(other)
        own = {k.name: (k, t) for k, t in self.fields} | {k.name: (k, t) for k, t in other.fields}
        return Record(tuple(own.values()), tuple(dict([*self.typed, *other.typed]).items()), other.rest or self.rest)

    def tagged_by(self, key: str, *variants: Obj) -> Type:
        return Tagged(key, tuple(map(wrap, variants)))

    def filtered(self) -> Type:
        return FilteredRecord(self)

    def symbolized(self) -> Type:
        """Keys are text in Spark; the record stays as it is."""
        return self

    def parts(self, c: Cell, path: Column) -> dict[str, Out]:
        out = {}
        for k, t in self.fields:
            cell = c.field(k.name)
            if k.optional and cell.present is False:
                continue
            o = t.lower(cell, at(path, k.name))
            if k.optional and not isinstance(cell.present, bool):
                here = cell.present
                own = o
                o = Out(F.when(here, own.value), ~here | own.ok, lambda own=own, here=here: F.when(here, own.errors).otherwise(no_errors()), own.dtype, True if own.known else None, here, weight=2 * own.weight)
            out[k.name] = o
        return out | self.others(c, path)

    def others(self, c: Cell, path: Column) -> dict[str, Out]:
        """Fields that are not declared. A struct's are known when planning; a map's tail becomes the field _."""
        rules = [*self.typed, *([(Any(), self.rest)] if self.rest else [])]
        if not rules:
            return {}
        names = [k.name for k, _ in self.fields]
        if isinstance(c.dtype, T.StructType):
            out = {}
            for name in c.dtype.names:
                t = next((t for k, t in rules if name not in names and matches_key(k, name)), None)
                if t is not None:
                    out[name] = t.lower(c.field(name), at(path, name))
            return out
        tail = F.map_filter(c.value if isinstance(c.dtype, T.MapType) else c.value.try_cast("map<string,variant>"), lambda k, v: ~k.isin(*names) if names else F.lit(True))
        valued = c.dtype.valueType if isinstance(c.dtype, T.MapType) else VARIANT
        if sites.found_now() and any(holds_itself(t) for _, t in rules) or not all(in_columns(t) for _, t in rules):
            return {"_": self._tail_by_place(tail, valued, rules, path)}
        with in_lambda():
            types = [t.lower(Cell(F.lit(None).cast(valued), valued), path) for _, t in rules]
        dtype = types[0].dtype
        for o in types[1:]:
            dtype = common(dtype, o.dtype)

        def chosen(k: Column, v: Column, take: Callable[[Out], Column], nothing: Column) -> Column:
            with in_lambda():
                return chosen_of(k, v, take, nothing)

        def chosen_of(k: Column, v: Column, take: Callable[[Out], Column], nothing: Column) -> Column:
            column = nothing
            for key, t in reversed(rules):
                applies = key.lower(Cell(k, T.StringType()), path)
                o = t.lower(Cell(v, valued), F.concat(path, F.when(path == "", F.lit("")).otherwise(F.lit(".")), k))
                column = take(o) if applies.known else F.when(applies.ok, take(o)).otherwise(column)
            return column

        matched = lambda k: (F.lit(True) if self.rest else _any([key.lower(Cell(k, T.StringType()), path).ok for key, _ in self.typed]))
        kept = F.map_filter(tail, lambda k, v: matched(k))
        value = F.transform_values(kept, lambda k, v: chosen(k, v, lambda o: fitted(o.value, o.dtype, dtype), F.lit(None).cast(dtype)))
        ok = F.coalesce(F.forall(F.map_entries(kept), lambda e: chosen(e["key"], e["value"], lambda o: o.ok, F.lit(True))), F.lit(True))
        errors = lambda: F.coalesce(F.flatten(F.transform(F.map_entries(kept), lambda e: chosen(e["key"], e["value"], lambda o: o.errors, no_errors()))), no_errors())
        return {"_": Out(value, ok, errors, T.MapType(T.StringType(), dtype), weight=LIGHT)}

    def _tail_by_place(self, tail: Column, valued: T.DataType, rules: list[tuple[Type, Type]], path: Column) -> Out:
        """The tail as others() gives it, where its types hold steps in Python, or themselves."""

        def entry(e: Column, i: Column) -> Out:
            where = F.concat(path, F.when(path == "", F.lit("")).otherwise(F.lit(".")), e["key"])
            with in_lambda():
                cases = [(k.lower(Cell(e["key"], T.StringType()), path).ok, t.lower(Cell(e["value"], valued), where)) for k, t in rules]
            dtype = cases[0][1].dtype
            for _, o in cases[1:]:
                dtype = common(dtype, o.dtype)
            value, ok, said = F.lit(None).cast(dtype), F.lit(True), no_errors()
            for applies, o in reversed(cases):
                value, ok, said = F.when(applies, fitted(o.value, o.dtype, dtype)).otherwise(value), F.when(applies, o.ok).otherwise(ok), F.when(applies, o.errors).otherwise(said)
            made = T.StructType([T.StructField("key", T.StringType(), False), T.StructField("value", dtype)])
            return Out(F.struct(e["key"].alias("key"), value.alias("value")), ok, said, made)

        own = F.map_filter(tail, lambda k, v: F.lit(True) if self.rest else _any([key.lower(Cell(k, T.StringType()), path).ok for key, _ in self.typed]))
        entries = F.map_entries(own)
        if sites.found_now():
            sites.found_in(entries, entry)
            return Out(own, F.lit(True), no_errors, T.MapType(T.StringType(), valued))
        pairs, o = sites.each(entries, entry)
        ok = F.coalesce(F.forall(pairs, lambda s: s["ok"]), F.lit(True))
        return Out(F.map_from_entries(F.transform(pairs, lambda s: s["v"])), ok, lambda: element_errors(pairs, no_errors()), T.MapType(T.StringType(), o.dtype["value"].dataType), weight=10 * LIGHT)

    def lower(self, c, path):
        g = Gate("hash").lower(c, path)
        if g.known is False:
            return gated(c, False, path, "must be a Hash")
        # An object's fields are taken from the object itself, so that null and absent stay apart.
        if not self.fields and not self.typed and self.rest is None:
            return Out(c.value, g.ok, lambda: g.errors, c.dtype, g.known, c.present, weight=g.weight, fields=c.fields)
        parts = self.parts(c, path)
        ok, known = conj(list(parts.values()))
        stored = {k: o for k, o in parts.items() if o.present is not False}
        dtype = T.StructType([T.StructField(k, o.dtype) for k, o in stored.items()])
        value = F.struct(*(o.value.alias(k) for k, o in stored.items())) if stored else F.struct()
        errors = lambda: F.concat(*(o.errors for o in parts.values())) if parts else no_errors()
        weights = [o.weight for o in parts.values()]
        if g.known:
            return Out(value, ok, errors, dtype, known, c.present, stored, weight=max(weights, default=1))
        return Out(F.when(g.ok, value), g.ok & ok, lambda: F.when(g.ok, errors()).otherwise(one_error(path, "must be a Hash")), dtype, False if known is False else None, c.present, weight=g.weight + sum(weights))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def matches_key(key: Type, name: str) -> bool:
    """Whether a key type admits a name, when planning."""
    if isinstance(key, Refine) and not isinstance(key, (Check, Attr)):
        return matches_key(key.base, name) and bool(key.matcher.matches(name))
    if isinstance(key, Equals):
        return key.literal == name
    return isinstance(key, Any) or isinstance(key, Gate) and key.kind in ("string", "symbol")


def record(raw: dict) -> Record:
    """A record from a dict: names (with ? at the end: optional), typed keys (types, patterns), and _ for the catch-all."""
    fields, typed, rest = [], [], None
    for k, v in raw.items():
        if k == "_":
            rest = wrap(v)
        elif isinstance(k, Key):
            fields.append((k, wrap(v)))
        elif isinstance(k, str):
            fields.append((Key(k.removesuffix("?"), k.endswith("?")), wrap(v)))
        else:
            typed.append((Gate("string")[k] if isinstance(k, re.Pattern) else wrap(k), wrap(v)))
    return Record(tuple(fields), tuple(typed), rest)


@dataclass(frozen=True)
class FilteredRecord(Type):
    """A record without the fields that are not valid: those are null."""

    inner: Record

    def children(self):
        return (self.inner,)

    def rebuilt(self, children):
        return FilteredRecord(children[0])

    @property
    def output_type(self):
        return Record(tuple((Key(k.name, True), t.output_type) for k, t in self.inner.fields), self.inner.typed, self.inner.rest)

    def lower(self, c, path):
        g = Gate("hash").lower(c, path)
        if g.known is False:
            return gated(c, False, path, "must be a Hash")
        parts = {k: o for k, o in self.inner.parts(c, path).items() if o.known is not False and o.present is not False}
        dtype = T.StructType([T.StructField(k, o.dtype) for k, o in parts.items()])
        kept = {k: Out(F.when(o.ok, o.value), F.lit(True), no_errors, o.dtype, True, weight=2 * o.weight) for k, o in parts.items()}
        value = F.struct(*(o.value.alias(k) for k, o in kept.items()))
        weight = max((o.weight for o in kept.values()), default=1) if g.known else g.weight + sum(o.weight for o in kept.values())
        return Out(value if g.known else F.when(g.ok, value), g.ok, lambda: g.errors, dtype, g.known, c.present, kept if g.known else None, weight=weight)


@dataclass(frozen=True)
class Tagged(Type):
    """One of several records, chosen by a literal field."""

    key: str
    variants: tuple[Record, ...]

    def __post_init__(self):
        for v in self.variants:
            if not isinstance(v, Record) or not isinstance(base_of(v.at_key(self.key)), (Equals, Static)):
                raise TypeMismatch(f"each variant needs a literal {self.key}")

    def children(self):
        return self.variants

    def rebuilt(self, children):
        return Tagged(self.key, children)

    def tags(self) -> list:
        return [base_of(v.at_key(self.key)).literal for v in self.variants]

    def lower(self, c, path):
        g = Gate("hash").lower(c, path)
        if g.known is False:
            return gated(c, False, path, "must be a Hash")
        tag = c.field(self.key)
        cases = [(Equals(x).lower(tag, path).ok, v.parts(c, path)) for x, v in zip(self.tags(), self.variants)]
        names: dict[str, T.DataType] = {}
        for _, parts in cases:
            for k, o in parts.items():
                names[k] = common(names[k], o.dtype) if k in names else o.dtype
        ok = F.lit(False)
        fields = {k: F.lit(None).cast(d) for k, d in names.items()}
        for test, parts in reversed(cases):
            good, _ = conj(list(parts.values()))
            ok = F.when(test, good).otherwise(ok)
            fields = {k: F.when(test, fitted(parts[k].value, parts[k].dtype, d) if k in parts else F.lit(None).cast(d)).otherwise(fields[k]) for k, d in names.items()}

        def errors() -> Column:
            said = one_error(at(path, self.key), f"expected :{self.key} to be one of {', '.join(map(M.shown, self.tags()))}")
            for test, parts in reversed(cases):
                said = F.when(test, F.concat(*(o.errors for o in parts.values()))).otherwise(said)
            return said if g.known else F.when(g.ok, said).otherwise(g.errors)

        dtype = T.StructType([T.StructField(k, d) for k, d in names.items()])
        weight = len(cases) * c.weight + sum(o.weight for _, parts in cases for o in parts.values())
        outs = {k: Out(v, F.lit(True), no_errors, names[k], weight=weight) for k, v in fields.items()}
        value = F.struct(*(v.alias(k) for k, v in fields.items()))
        if g.known:
            return Out(value, ok, errors, dtype, None, c.present, outs, weight=weight)
        return Out(F.when(g.ok, value), g.ok & ok, errors, dtype, None, c.present, weight=g.weight + weight * len(names))


def elements(c: Cell) -> tuple[Cell, Out]:
    """The array in a cell and whether it is one."""
    g = Gate("array").lower(c, F.lit(""))
    return Cell(g.value, g.dtype, c.present, weight=g.weight), g


@dataclass(frozen=True)
class Array(Type):
    """Every element through one type; errors by index. Where an element fails its place in the value is null."""

    of: Type = field(default_factory=Any)

    @property
    def output_type(self):
        return self if self.of.output_type is self.of else Array(self.of.output_type)

    @property
    def preserving(self):
        return self.of.preserving

    def children(self):
        return (self.of,)

    def rebuilt(self, children):
        return Array(children[0])

    def filtered(self) -> Type:
        return FilteredArray(self)

    def concurrent(self) -> Type:
        """Spark runs rows in parallel; the elements of a row keep their order."""
        return self

    def stream(self) -> Type:
        return Stream(self.of)

    def _element(self, x: Column, dtype: T.DataType, path: Column) -> Out:
        with in_lambda():
            return self.of.lower(Cell(x, dtype), path)

    def lower(self, c, path):
        a, g = elements(c)
        if g.known is False:
            return gated(c, False, path, "must be an Array")
        el = a.dtype.elementType
        indexed = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        place = lambda x, i: self._element(x, el, indexed(i))
        if sites.found_now() and holds_itself(self.of):
            sites.found_in(a.value, place)
            return Out(a.value, g.ok, no_errors, a.dtype, None, c.present)
        if not in_columns(self.of) or looked_up(self.of):
            pairs, o = sites.each(a.value, place)
            said = lambda: F.when(g.ok, element_errors(pairs, no_errors())).otherwise(one_error(path, "must be an Array"))
            return Out(F.transform(pairs, lambda s: F.when(s["ok"], s["v"])), g.ok & F.coalesce(F.forall(pairs, lambda s: s["ok"]), F.lit(False)), said, T.ArrayType(o.dtype), None, c.present, weight=10 * LIGHT)

        def errors() -> Column:
            own = F.transform(a.value, lambda x, i: self._element(x, el, indexed(i)).errors)
            return F.when(g.ok, F.coalesce(F.flatten(own), no_errors())).otherwise(one_error(path, "must be an Array"))

        known = self.__dict__.setdefault("_known", {})  # what an element's type makes of a column type

        def element(x: Column) -> Out:
            o = self._element(x, el, path)
            known[el] = o.dtype, o.weight
            return o

        all_ok = lambda: F.coalesce(F.forall(a.value, lambda x: element(x).ok), F.lit(False))

        def judged() -> Column:
            """Each element is judged once; what comes out is taken from the pairs of value and validity."""
            pairs = F.transform(a.value, lambda x: element(x).judged())
            return let(pairs, lambda p: F.struct(F.transform(p, lambda s: F.when(s["ok"], s["v"])).alias("v"), F.coalesce(F.forall(p, lambda s: s["ok"]), F.lit(False)).alias("ok")))

        seen = el in known
        first = None if seen else all_ok() if self.of.preserving else judged()
        made, weight = known[el]
        if self.of.preserving and made == el:
            return Out(a.value, (lambda: g.ok & all_ok()) if seen else g.ok & first, errors, a.dtype, None, c.present, weight=2 * a.weight + weight)
        out = Out(lambda: out.judged()["v"], lambda: out.judged()["ok"], errors, T.ArrayType(made), None, c.present, weight=10 * LIGHT, judged=judged if seen or self.of.preserving else lambda: first)
        return out


@dataclass(frozen=True)
class FilteredArray(Type):
    """The valid elements only."""

    inner: Array

    def children(self):
        return (self.inner,)

    def rebuilt(self, children):
        return FilteredArray(children[0])

    @property
    def output_type(self):
        return self.inner.output_type

    def concurrent(self) -> Type:
        return self

    def lower(self, c, path):
        a, g = elements(c)
        if g.known is False:
            return gated(c, False, path, "must be an Array")
        el, seen = a.dtype.elementType, []
        if sites.found_now() and holds_itself(self.inner):
            sites.found_in(a.value, lambda x, i: self.inner._element(x, el, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
            return Out(a.value, g.ok, no_errors, a.dtype, None, c.present)
        if not in_columns(self.inner) or looked_up(self.inner):
            pairs, o = sites.each(a.value, lambda x, i: self.inner._element(x, el, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
            return Out(F.transform(F.filter(pairs, lambda s: s["ok"]), lambda s: s["v"]), g.ok, lambda: g.errors, T.ArrayType(o.dtype), g.known, c.present, weight=10 * LIGHT)

        def element(x: Column) -> Out:
            seen.append(self.inner._element(x, el, path))
            return seen[-1]

        pairs = F.transform(a.value, lambda x: element(x).judged())
        value = F.transform(F.filter(pairs, lambda s: s["ok"]), lambda s: s["v"])
        return Out(value, g.ok, lambda: g.errors, T.ArrayType(seen[0].dtype), g.known, c.present, weight=10 * LIGHT)


@dataclass(frozen=True)
class Map(Type):
    """Every key through one type and every value through another."""

    keys: Type
    values: Type

    @property
    def output_type(self):
        return Map(self.keys.output_type, self.values.output_type)

    @property
    def preserving(self):
        return self.keys.preserving and self.values.preserving

    def children(self):
        return self.keys, self.values

    def rebuilt(self, children):
        return Map(*children)

    def filtered(self) -> Type:
        return FilteredMap(self)

    def _entry(self, e: Column, d: T.MapType, path: Column) -> tuple[Out, Out]:
        where = F.concat(path, F.lit("["), e["key"].cast("string"), F.lit("]"))
        with in_lambda():
            return self.keys.lower(Cell(e["key"], d.keyType), where), self.values.lower(Cell(e["value"], d.valueType), where)

    def _whole(self, e: Column, d: T.MapType, path: Column) -> Out:
        """An entry, struct<key, value>, of the lowered key and value."""
        k, v = self._entry(e, d, path)
        ok, _ = conj([k, v])
        return Out(F.struct(k.value.alias("key"), v.value.alias("value")), ok, lambda: F.concat(k.errors, v.errors), T.StructType([T.StructField("key", k.dtype, False), T.StructField("value", v.dtype)]))

    def _made(self, d: T.MapType, path: Column) -> T.MapType:
        blank = F.struct(F.lit(None).cast(d.keyType).alias("key"), F.lit(None).cast(d.valueType).alias("value"))
        k, v = self._entry(blank, d, path)
        return T.MapType(k.dtype, v.dtype)

    def lower(self, c, path, drop: bool = False):
        g = Gate("hash").lower(c, path)
        if g.known is False or isinstance(g.dtype, T.StructType):
            return gated(c, False, path, "must be a Hash")
        d = g.dtype
        entries = F.map_entries(g.value)
        if sites.found_now() and holds_itself(self):
            sites.found_in(entries, lambda e, i: self._whole(e, d, path))
            return Out(g.value, g.ok, no_errors, d, None, c.present)
        if not in_columns(self):
            pairs, o = sites.each(entries, lambda e, i: self._whole(e, d, path))
            good = lambda: F.coalesce(F.forall(pairs, lambda s: s["ok"]), F.lit(False))
            value = F.map_from_entries(F.transform(F.filter(pairs, lambda s: s["ok"]), lambda s: s["v"]))
            made = T.MapType(o.dtype["key"].dataType, o.dtype["value"].dataType)
            if drop:
                return Out(value, g.ok, lambda: g.errors, made, g.known, c.present, weight=10 * LIGHT)
            said = lambda: F.when(g.ok, element_errors(pairs, no_errors())).otherwise(one_error(path, "must be a Hash"))
            return Out(F.when(good(), value), g.ok & good(), said, made, None, c.present, weight=10 * LIGHT)
        made = self._made(d, path)
        good = lambda e: conj(list(self._entry(e, d, path)))[0]

        def judged(e: Column) -> Column:
            k, v = self._entry(e, d, path)
            return F.struct(k.value.alias("key"), v.value.alias("value"), conj([k, v])[0].alias("ok"))

        def errors() -> Column:
            own = F.transform(entries, lambda e: F.concat(*(o.errors for o in self._entry(e, d, path))))
            return F.when(g.ok, F.coalesce(F.flatten(own), no_errors())).otherwise(one_error(path, "must be a Hash"))

        if not drop and self.preserving and made == d:
            ok = F.coalesce(F.forall(entries, good), F.lit(False))
            return Out(g.value, g.ok & ok, errors, made, None, c.present, weight=LIGHT)
        made_of = lambda p: F.map_from_entries(F.transform(F.filter(p, lambda s: s["ok"]), lambda s: F.struct(s["key"], s["value"])))
        if drop:
            return Out(made_of(F.transform(entries, judged)), g.ok, lambda: g.errors, made, g.known, c.present, weight=10 * LIGHT)
        fine = lambda p: F.coalesce(F.forall(p, lambda s: s["ok"]), F.lit(False))
        pairs = let(F.transform(entries, judged), lambda p: F.struct(F.when(fine(p), made_of(p)).alias("v"), fine(p).alias("ok")))
        return Out(pairs["v"], pairs["ok"], errors, made, None, c.present, weight=10 * LIGHT, judged=lambda: pairs)


@dataclass(frozen=True)
class FilteredMap(Type):
    """The valid entries only."""

    inner: Map

    def children(self):
        return (self.inner,)

    def rebuilt(self, children):
        return FilteredMap(children[0])

    @property
    def output_type(self):
        return self.inner.output_type

    def lower(self, c, path):
        return self.inner.lower(c, path, drop=True)


@dataclass(frozen=True)
class Tuple(Type):
    """A list of fixed length, each place with its type; the value is a struct _0, _1 and so on."""

    of: tuple[Type, ...]

    @property
    def output_type(self):
        return Tuple(tuple(t.output_type for t in self.of))

    @property
    def preserving(self):
        return all(t.preserving for t in self.of)

    def children(self):
        return self.of

    def rebuilt(self, children):
        return Tuple(children)

    def lower(self, c, path):
        n = len(self.of)
        if isinstance(c.dtype, T.StructType):
            g, sized = Out(c.value, c.value.isNotNull(), no_errors(), c.dtype), F.lit(len(c.dtype) == n)
            cells = [c.field(x) for x in c.dtype.names][:n]
        else:
            a, g = elements(c)
            if g.known is False:
                return gated(c, False, path, "must be an Array")
            sized = F.coalesce(F.size(a.value) == n, F.lit(False))
            cells = [Cell(F.get(a.value, F.lit(i)), a.dtype.elementType, weight=a.weight) for i in range(n)]
        outs = [t.lower(x, F.concat(path, F.lit(f"[{i}]"))) for i, (t, x) in enumerate(zip(self.of, cells))]
        ok, _ = conj(outs)
        dtype = T.StructType([T.StructField(f"_{i}", o.dtype) for i, o in enumerate(outs)])
        value = F.when(g.ok & sized, F.struct(*(o.value.alias(f"_{i}") for i, o in enumerate(outs))))
        errors = lambda: F.when(~g.ok, one_error(path, "must be an Array")).when(~sized, one_error(path, f"must have the same size, {n}")).otherwise(F.concat(*(o.errors for o in outs)))
        return Out(value, g.ok & sized & ok, errors, dtype, None, c.present, weight=g.weight + sum(o.weight for o in outs))


@dataclass(frozen=True)
class Interval(Type):
    """A struct of from, to and exclusive whose ends are of one type; a null end is open."""

    of: Type
    preserving = True

    def children(self):
        return (self.of,)

    def rebuilt(self, children):
        return Interval(children[0])

    def lower(self, c, path):
        if not (isinstance(c.dtype, T.StructType) and family(c.dtype) == "range"):
            return gated(c, False, path, "must be a Range")
        ends = [(c.field(end), self.of.lower(c.field(end), at(path, end))) for end in ("from", "to")]
        here = c.value.isNotNull()
        ok = here
        for e, o in ends:
            ok = ok & (e.value.isNull() | o.ok)

        def errors() -> Column:
            low, high = (F.when(e.value.isNull(), no_errors()).otherwise(o.errors) for e, o in ends)
            return F.when(here, F.when(F.size(low) > 0, low).otherwise(high)).otherwise(one_error(path, "must be a Range"))

        return Out(c.value, F.coalesce(ok, F.lit(False)), errors, c.dtype, None, c.present, weight=c.weight + sum(o.weight for _, o in ends))


@dataclass(frozen=True)
class Capability(Type):
    """Values that answer all of the named methods."""

    names: frozenset[str]
    preserving = True

    def __add__(self, other: Capability) -> Capability:
        return Capability(self.names | other.names)

    def __and__(self, other: Obj) -> Type:
        return Capability(self.names & other.names) if isinstance(other, Capability) else super().__and__(other)

    def kinds(self) -> list[str]:
        return [k for k, own in scalars.CAPABILITIES.items() if self.names <= own]

    def lower(self, c, path):
        said = f"must respond to [{', '.join(f':{n}' for n in sorted(self.names))}]"
        if isinstance(c.dtype, T.VariantType):
            return gated(c, _any([Gate(k).lower(c, path).ok for k in self.kinds() if k in TAGS]), path, said)
        if family(c.dtype) not in self.kinds():
            return gated(c, c.value.isNull() if "nil" in self.kinds() else False, path, said)
        return gated(c, True if c.row else c.value.isNotNull(), path, said)


@dataclass(frozen=True)
class Stream(Type):
    """Elements one by one: the rows of a batch or streaming DataFrame, or an array's after explode."""

    of: Type
    only_valid: bool = False

    def children(self):
        return (self.of,)

    def rebuilt(self, children):
        return Stream(children[0], self.only_valid)

    def filtered(self) -> Stream:
        return Stream(self.of, True)

    @property
    def input_type(self):
        return Capability(frozenset({"each"}))

    def lower(self, c, path):
        return (FilteredArray if self.only_valid else Array)(Array(self.of) if self.only_valid else self.of).lower(c, path)


@dataclass(frozen=True)
class Deferred(Type):
    """A type that is named before it is made, so that it can hold itself. Columns have finite types: it is unrolled
    max_depth times. Values that nest deeper are invalid; or, if max_depth is None, they are found by operators.deep, which
    judges them level by level, and looked up in `judged`, by the number of the type in `makes` and their path."""

    make: Callable[[], Obj]
    max_depth: int | None = 8
    depth: int = 0
    judged: Column | None = field(default=None, compare=False)
    makes: tuple[Callable, ...] = field(default=(), compare=False)

    #: Levels that are unrolled at once where max_depth is None; and in jobs, where the type holds itself at one place, in no list.
    UNROLLED, IN_LINE = 3, 8

    def target(self) -> Type:
        return wrap(self.make())

    @property
    def output_type(self):
        return self

    def known_by(self, judged: Column, makes: list[Callable]) -> Deferred:
        return Deferred(self.make, self.max_depth, self.depth, judged, tuple(makes))

    def lower(self, c, path):
        if self.depth >= (self.max_depth or self.unrolled()):
            return self.beyond(c, path)
        if c.present is False or isinstance(c.dtype, T.NullType):
            return gated(c, False, path, "must be a Hash")
        if self.max_depth is None and self.depth and isinstance(c.dtype, T.VariantType) and c.inside is None:  # the next levels are taken from it, many times
            c = Cell(staged(c.value), c.dtype, c.present)
        own = {"judged": self.judged, "makes": self.makes}
        deeper = transformed(self.target(), lambda t: Deferred(t.make, t.max_depth, self.depth + 1, **own) if isinstance(t, Deferred) else t)
        o = deeper.lower(c, path)
        if not isinstance(c.dtype, T.VariantType):
            return o
        if self.judged is None or not self.depth or o.known is not None:
            return Out(c.value, o.ok, lambda: o.errors, c.dtype, o.known, c.present, weight=o.weight)
        # The level around reads it for itself and for its errors.
        ok = projected(o.ok)
        return Out(c.value, ok, lambda: o.errors, c.dtype, None, c.present, weight=1 if ok is not o.ok else o.weight)

    def unrolled(self) -> int:
        """Fewer levels where a type holds itself at several places or in lists, so that plans do not grow with a power of them."""
        places = max(1, counted(self.target()))
        in_jobs = self.judged is not None or sites.found_now() is not None
        if places == 1:
            return self.IN_LINE if in_jobs else self.UNROLLED
        return max(1, int(self.UNROLLED / (1 + math.log2(places))))

    def beyond(self, c: Cell, path: Column) -> Out:
        if self.max_depth is not None or not isinstance(c.dtype, T.VariantType):
            return gated(c, False, path, f"nested deeper than {self.depth}")
        found = sites.found_now()
        if found is not None:
            found.at(self.make, path, c)
        if self.judged is None:
            return gated(c, False, path, f"nested deeper than {self.depth}")
        r = F.element_at(self.judged, sites.key(self.makes.index(self.make), path)) if self.make in self.makes else F.lit(None).cast(f"struct<ok:boolean,errors:{ERRORS}>")
        return Out(c.value, F.coalesce(r["ok"], F.lit(False)), lambda: F.coalesce(r["errors"], one_error(path, "must be a Hash")), c.dtype, None, c.present, weight=LIGHT)


def counted(t: Type) -> int:
    """At how many places a type holds types that are named before they are made; those in a list are lowered twice."""
    own = 1 if isinstance(t, Deferred) else sum(map(counted, t.children()))
    return 2 * own if isinstance(t, (Array, Map)) else own


@dataclass(frozen=True)
class Wrap(Type):
    """A policy, metadata or a label around a type: of no effect on values."""

    inner: Type
    role: str
    name: str
    data: tuple = ()

    @property
    def input_type(self):
        return self.inner.input_type

    @property
    def output_type(self):
        return self.inner.output_type

    @property
    def preserving(self):
        return self.role in ("label", "name") and self.inner.preserving

    def __repr__(self):
        return self.name if self.role == "name" else f"{self.inner!r}.{self.role}({self.name!r})"

    def children(self):
        return (self.inner,)

    def rebuilt(self, children):
        return Wrap(children[0], self.role, self.name, self.data)

    def lower(self, c, path):
        return self.inner.lower(c, path)

    def __getattr__(self, name):
        # filtered, stream and others of the type inside
        if name.startswith("_") or name in ("inner", "role", "data"):
            raise AttributeError(name)
        return getattr(self.inner, name)


@dataclass(frozen=True)
class StructOf(Type):
    """A struct class: its schema, after the steps that come first."""

    cls: Obj

    @property
    def output_type(self):
        return self.cls.schema.output_type

    def children(self):
        return (self.cls.schema,)

    def lower(self, c, path):
        return self.cls.whole().lower(c, path)


def transformed(t: Type, change: Callable[[Type], Type]) -> Type:
    """The tree with change applied bottom-up; a node is kept as it is if nothing below it changed."""
    own = t.children()
    new = tuple(transformed(c, change) for c in own)
    return change(t if all(a is b for a, b in zip(own, new)) else t.rebuilt(new))


def decorate(t: Type, change: Callable[[Type], Type]) -> Type:
    return transformed(t, change)
