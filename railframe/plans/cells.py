"""What lowering passes along: an input cell, and the columns that a type makes of it."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, replace
from itertools import count, groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ERRORS = "array<struct<path:string,message:string>>"
#: Columns that grow beyond so many leaves are bound before more than one step reads them.
LIGHT = 32
VARIANT = T.VariantType()

FAMILIES = [
    ("string", T.StringType),
    ("integer", (T.ByteType, T.ShortType, T.IntegerType, T.LongType)),
    ("float", (T.FloatType, T.DoubleType)),
    ("decimal", T.DecimalType),
    ("boolean", T.BooleanType),
    ("date", T.DateType),
    ("time", (T.TimestampType, T.TimestampNTZType)),
    ("array", T.ArrayType),
    ("hash", (T.StructType, T.MapType)),
    ("nil", T.NullType),
]

#: kind -> the tags that schema_of_variant gives it (Decimal tags also hold JSON's fractions), and what it is taken out as.
TAGS = {
    "string": (r"^STRING", T.StringType()),
    "symbol": (r"^STRING", T.StringType()),
    "integer": (r"^(TINYINT|SMALLINT|INT|BIGINT)", T.LongType()),
    "float": (r"^(DOUBLE|FLOAT|DECIMAL)", T.DoubleType()),
    "decimal": (r"^DECIMAL", T.DecimalType(38, 18)),
    "numeric": (r"^(TINYINT|SMALLINT|INT|BIGINT|DOUBLE|FLOAT|DECIMAL)", T.DoubleType()),
    "boolean": (r"^BOOLEAN", T.BooleanType()),
    "true": (r"^BOOLEAN", T.BooleanType()),
    "false": (r"^BOOLEAN", T.BooleanType()),
    "date": (r"^DATE", T.DateType()),
    "time": (r"^TIMESTAMP", T.TimestampType()),
    "array": (r"^ARRAY", T.ArrayType(VARIANT)),
    "hash": (r"^OBJECT", T.MapType(T.StringType(), VARIANT)),
    "nil": (r"^VOID", T.NullType()),
}


def has_tag(value: Column, kind: str, place: str = "$") -> Column:
    """Whether what stands at a place in a VARIANT is of a kind; never null. schema_of_variant goes through all that a value holds, so
    objects and arrays are told by a cast that reads no field of theirs, and only scalars are taken out and asked for their schema."""
    is_object, is_array = (F.try_variant_get(value, place, shape).isNotNull() for shape in ("struct<>", "array<struct<>>"))
    if kind in ("hash", "array"):
        return is_object if kind == "hash" else is_array
    if kind != "nil" and kind not in TAGS:
        return F.lit(False)
    own = value if place == "$" else F.try_variant_get(value, place, "variant")
    told = F.coalesce(F.is_variant_null(own) if kind == "nil" else F.schema_of_variant(own).rlike(TAGS[kind][0]), F.lit(False))
    return told if kind == "nil" and place == "$" else F.when(is_object | is_array, F.lit(False)).otherwise(told)


def family(dtype: T.DataType) -> str | None:
    """The kind of a column's values; None for VARIANT, whose values tell."""
    if isinstance(dtype, T.StructType) and {"from", "to"} <= set(dtype.names) <= {"from", "to", "exclusive"}:
        return "range"
    return next((k for k, types in FAMILIES if isinstance(dtype, types)), None)


@dataclass(frozen=True)
class Cell:
    """A value on its way through a type. present: whether there is a value at all, which null does not tell."""

    value: Column
    dtype: T.DataType
    present: Column | bool = True
    #: Of the row of a DataFrame: its columns are the fields.
    row: bool = False
    #: About how many leaves the value's expression has.
    weight: int = 1
    #: Of a record that was just made: its fields.
    fields: dict[str, Out] | None = None
    #: Of a VARIANT inside another: that other, and the place in it. To take a VARIANT out is to copy all that it holds.
    inside: Column | None = None
    place: str = "$"

    def around(self) -> Column:
        return self.value if self.inside is None else self.inside

    def taken(self, dtype: str) -> Column:
        """A VARIANT as a type, straight from the value that it stands in."""
        return F.try_variant_get(self.around(), self.place, dtype)

    def some(self) -> Column:
        """Whether the value is not null; a VARIANT inside another is copied for it only where it is a scalar."""
        if self.inside is None:
            return self.value.isNotNull()
        return has_tag(self.inside, "hash", self.place) | has_tag(self.inside, "array", self.place) | self.value.isNotNull()

    def field(self, name: str) -> Cell:
        """A field of a struct, map, VARIANT object or row."""
        if self.fields is not None and name in self.fields:
            own = self.fields[name]
            return Cell(own.value, own.dtype, own.present, weight=own.weight)
        if isinstance(self.dtype, T.StructType):
            if name not in self.dtype.names:
                return absent()
            return Cell(F.col(f"`{name}`") if self.row else self.value.getField(name), self.dtype[name].dataType, weight=1 if self.row else self.weight)
        if isinstance(self.dtype, T.MapType):
            return Cell(F.element_at(self.value, F.lit(name)), self.dtype.valueType, F.coalesce(F.map_contains_key(self.value, F.lit(name)), F.lit(False)), weight=self.weight + 1)
        place = f"{self.place}['{name}']"
        found = Cell(F.try_variant_get(self.around(), place, "variant"), VARIANT, weight=self.weight + 1, inside=self.around(), place=place)
        return replace(found, present=found.some())

    def here(self) -> Column:
        return F.lit(self.present) if isinstance(self.present, bool) else self.present


def absent() -> Cell:
    return Cell(F.lit(None), T.NullType(), False)


class Out:
    """The value, whether it is valid (never null, free of error work so that it can be pushed down), and the errors.

    Each may be given as a function: a column is built when somebody reads it. judged and whole: structs that hold value
    and ok (v, ok), or those and the errors (v, ok, e), where these columns come out of one. origin: what a bound result
    was made of, and how, so that the next step may go into the same binding."""

    def __init__(
        self,
        value: Column | Callable[[], Column],
        ok: Column | Callable[[], Column],
        errors: Column | Callable[[], Column],
        dtype: T.DataType,
        known: bool | None = None,
        present: Column | bool = True,
        fields: dict[str, Out] | None = None,
        weight: int = 2,
        judged: Callable[[], Column] | None = None,
        whole: Callable[[], Column] | None = None,
        origin: tuple[list[Out], Callable[..., Out], int] | None = None,
    ):
        self.dtype, self.present, self.fields, self.weight, self.origin = dtype, present, fields, weight, origin
        #: What ok is for all rows, as far as the plan tells.
        self.known = known
        self._made = {"value": value, "ok": ok, "errors": errors, "judged": judged or self._judged, "whole": whole or self._whole}

    def _read(self, name: str) -> Column:
        if not isinstance(self._made[name], Column):
            self._made[name] = self._made[name]()
        return self._made[name]

    value, ok, errors = (property(lambda self, name=name: self._read(name)) for name in ("value", "ok", "errors"))

    def _judged(self) -> Column:
        return F.struct(self.value.alias("v"), self.ok.alias("ok"))

    def _whole(self) -> Column:
        return F.struct(self.value.alias("v"), self.ok.alias("ok"), self.errors.alias("e"))

    def judged(self) -> Column:
        return self._read("judged")

    def whole(self) -> Column:
        return self._read("whole")

    def cell(self) -> Cell:
        return Cell(self.value, self.dtype, self.present, weight=self.weight, fields=self.fields)


class Stages:
    """Columns that a lowering wants to be projected before its own. Each may read those of lower levels, so a result that is
    read more than once is made once, in generated code. binds: not for steps in Python only, but for every large result."""

    def __init__(self, taken: list[str], binds: bool):
        self.taken, self.binds = set(taken), binds
        self.level, self.columns = 0, []
        #: Whether a result was too large to be written as often as it is read.
        self.large = False

    def deeper(self) -> int:
        self.level += 1
        return self.level

    def put(self, c: Column, level: int) -> Column:
        name = next(n for n in (f"__step{i}" for i in count(len(self.columns))) if n not in self.taken)
        self.taken.add(name)
        self.columns.append((level, name, c))
        return F.col(name)

    def on(self, df: DataFrame) -> DataFrame:
        """df with the columns, a projection for each level."""
        for _, own in groupby(sorted(self.columns, key=lambda x: x[0]), key=lambda x: x[0]):
            df = df.withColumns({name: c for _, name, c in own})
        return df


#: Those of the lowering now; None inside a lambda, whose elements no projection before can hold.
_STAGES: list[Stages | None] = []


@contextmanager
def stages(made: Stages | None):
    _STAGES.append(made)
    try:
        yield made
    finally:
        _STAGES.pop()


def in_lambda():
    return stages(None)


def staged(c: Column) -> Column:
    """A column of a projection before, where there is one."""
    now = _STAGES[-1] if _STAGES else None
    return now.put(c, now.deeper()) if now else c


def projected(c: Column) -> Column:
    """A result that is read more than once: a column of a projection before, where large results stand there."""
    now = _STAGES[-1] if _STAGES else None
    if now is None:
        return c
    now.large = True
    return now.put(c, now.deeper()) if now.binds else c


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value written and computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def bound(outs: list[Out], then: Callable[..., Out]) -> Out:
    """then(*outs), which may read them as often as it likes: they are written once.

    So the text of a chain of steps grows with the number of steps, and does not multiply. Steps go into one binding until
    that is large itself."""
    now = _STAGES[-1] if _STAGES else None
    if now is not None:
        now.large = True
    if now is not None and now.binds:
        level = now.deeper()
        return then(*(before_all(o, now, level) for o in outs))
    if len(outs) == 1 and outs[0].origin is not None and outs[0].origin[2] <= LIGHT:
        (outs, before, _), last = outs[0].origin, then
        then = lambda *parts: last(before(*parts))
    names = [f"_{n}" for n in range(len(outs))]

    def inside(s: Column, with_errors: bool) -> Out:
        parts = [(s[n], o) for n, o in zip(names, outs)]
        with in_lambda():
            return then(*(Out(p["v"], F.lit(True) if o.known else p["ok"], p["e"] if with_errors else no_errors, o.dtype, o.known, o.present, weight=1) for p, o in parts))

    r = inside(F.lit(None), False)  # for its type only
    carried = isinstance(r.present, Column) and not any(r.present is o.present for o in outs)

    def judge(s: Column) -> Column:
        o = inside(s, False)
        return F.struct(o.value.alias("v"), o.ok.alias("ok"), o.present.alias("p")) if carried else o.judged()

    def judged() -> Column:
        return let(F.struct(*(o.judged().alias(n) for n, o in zip(names, outs))), judge)

    def whole() -> Column:
        return let(F.struct(*(o.whole().alias(n) for n, o in zip(names, outs))), lambda s: inside(s, True).whole())

    made = Out(lambda: made.judged()["v"], F.lit(r.known) if r.known is not None else lambda: made.judged()["ok"], lambda: made.whole()["e"], r.dtype, r.known, r.present, weight=10 * LIGHT, judged=judged, whole=whole, origin=(outs, then, r.weight))
    if carried:
        made.present = made.judged()["p"]
    return made


def before_all(o: Out, now: Stages, level: int) -> Out:
    """o in columns of a projection before; each is there if it is read."""
    present = now.put(o.present, level) if isinstance(o.present, Column) else o.present
    return Out(lambda: now.put(o.value, level), F.lit(True) if o.known else lambda: now.put(o.ok, level), lambda: now.put(o.errors, level), o.dtype, o.known, present, weight=1)


def step(o: Out, then: Callable[[Out], Out], plain: bool = True) -> Out:
    """then(o), bound first where o is large. Not plain: a function that must not stand in a lambda, such as Python's."""
    return bound([o], then) if o.weight > LIGHT and plain else then(o)


def no_errors() -> Column:
    return F.array().cast(ERRORS)


def one_error(path: Column, message: str | Column) -> Column:
    said = F.lit(message) if isinstance(message, str) else message
    return F.array(F.struct(path.alias("path"), said.alias("message"))).cast(ERRORS)


def gated(c: Cell, ok: Column | bool, path: Column, message: str | Column, value: Column | None = None, dtype: T.DataType | None = None) -> Out:
    """A cell that passes where ok; a Python bool is known when planning."""
    known = ok if isinstance(ok, bool) else None
    test = F.lit(ok) if isinstance(ok, bool) else ok
    errors = no_errors if known else lambda: one_error(path, message) if known is False else F.when(test, no_errors()).otherwise(one_error(path, message))
    return Out(c.value if value is None else value, test, errors, dtype or c.dtype, known, c.present, weight=2 * c.weight)


def both(a: bool | None, b: bool | None) -> bool | None:
    return False if a is False or b is False else True if a and b else None


def conj(outs: list[Out]) -> tuple[Column, bool | None]:
    """Whether all are valid."""
    known: bool | None = True
    test: Column | None = None
    for o in outs:
        known = both(known, o.known)
        if o.known is not True:
            test = o.ok if test is None else test & o.ok
    return F.lit(known) if known is not None else test, known


def as_variant(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.VariantType):
        return value
    if isinstance(dtype, (T.StructType, T.MapType, T.ArrayType)):
        return F.to_variant_object(value)
    return value.cast("variant")


def common(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type of a column that holds values of both; VARIANT for those of different families."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    x, y = family(a), family(b)
    if x == y and x in ("integer", "float"):
        return T.LongType() if x == "integer" else T.DoubleType()
    if {x, y} <= {"integer", "float", "decimal"}:
        return T.DoubleType() if "float" in (x, y) else a if x == "decimal" else b
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(common(a.elementType, b.elementType))
    return VARIANT


def fitted(value: Column, dtype: T.DataType, to: T.DataType) -> Column:
    if dtype == to:
        return value
    return as_variant(value, dtype) if isinstance(to, T.VariantType) and not isinstance(dtype, T.NullType) else value.cast(to)
