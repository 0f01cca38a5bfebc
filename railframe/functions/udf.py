"""Steps in Python for what Columns cannot express. Spark runs a UDF on every row whatever stands around it, so the guard
goes in beside the value, and what a step raises comes out as data only for the exceptions that it rescues.

A step stands anywhere in a type, inside arrays and maps too (plans/sites.py): the lists of an Arrow batch are opened, the
step is called on the flat values, and the lists are closed again by their lengths.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def each(fn: Callable, values: list, rescue: tuple[type[BaseException], ...]) -> tuple[list, list]:
    """fn on every value: what it made, and what it raised."""
    made, said = [], []
    for v in values:
        try:
            made.append(fn(v))
            said.append(None)
        except rescue as e:
            made.append(None)
            said.append(str(e))
    return made, said


def together(fn: Callable, values: pa.Array, rescue: tuple[type[BaseException], ...]) -> tuple[list, list]:
    """fn on all values at once. Where it raises what is rescued, it is called on either half again, so that the values at
    fault are found by calls that grow with their number, and all others are made."""
    if not len(values):
        return [], []
    try:
        made = fn(values)
        made = made.to_pylist() if isinstance(made, (pa.Array, pa.ChunkedArray)) else list(made)
    except rescue as e:
        if len(values) == 1:
            return [None], [str(e)]
        half = len(values) // 2
        a, b = together(fn, values[:half], rescue), together(fn, values[half:], rescue)
        return a[0] + b[0], a[1] + b[1]
    if len(made) != len(values):
        raise ValueError(f"a step in Python gave {len(made)} values for {len(values)}")
    return made, [None] * len(values)


def opened(a: pa.Array, depth: int) -> tuple[pa.Array, list[pa.Array]]:
    """The values inside `depth` levels of lists, and the lengths of the lists of each level (null: no list)."""
    lengths = []
    for _ in range(depth):
        lengths.append(pc.list_value_length(a))
        a = a.flatten()
    return a, lengths


def closed(values: pa.Array, lengths: list[pa.Array]) -> pa.Array:
    """The inverse of opened."""
    for n in reversed(lengths):
        ends = pc.cumulative_sum(pc.fill_null(n, 0)).cast(pa.int32())
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
        values = pa.ListArray.from_arrays(offsets, values, mask=pc.is_null(n))
    return values


class PythonStep:
    """A function of Columns whose work is done in Python; see python_step and batch_step."""

    in_python = True

    def __init__(self, fn: Callable, dtype: T.DataType, rescue: tuple[type[BaseException], ...], batch: bool):
        self.fn, self.dtype, self.rescue, self.batch = fn, dtype, rescue, batch
        self.__name__ = getattr(fn, "__name__", type(fn).__name__)
        #: What it makes of struct<v, ok>: e is what it raised.
        self.made = T.StructType([T.StructField("v", dtype), T.StructField("ok", T.BooleanType()), T.StructField("e", T.StringType())])

    def __eq__(self, other: Any) -> bool:
        return isinstance(other, PythonStep) and (self.fn, self.dtype, self.rescue, self.batch) == (other.fn, other.dtype, other.rescue, other.batch)

    def __hash__(self) -> int:
        return hash((self.fn, self.rescue, self.batch))

    def rescuing(self, *classes: type[BaseException]) -> PythonStep:
        return PythonStep(self.fn, self.dtype, tuple(dict.fromkeys((*self.rescue, *classes))), self.batch)

    def column(self, given: Column, depth: int = 0, in_json: bool = False) -> Column:
        """What the step makes of struct<v, ok> inside `depth` levels of arrays; where not ok, it is not called. in_json: v is
        the JSON text of a VARIANT, which the step gets as Python's value."""
        fn, rescue, batch = self.fn, self.rescue, self.batch
        fields = [pa.field("v", to_arrow_type(self.dtype)), pa.field("ok", pa.bool_()), pa.field("e", pa.string())]
        returned: T.DataType = self.made
        for _ in range(depth):
            returned = T.ArrayType(returned)

        def run(a: pa.Array, _: pa.Array) -> pa.Array:
            flat, lengths = opened(a, depth)
            v, ok = (flat.flatten() if len(flat) else [pa.array([], f.type) for f in flat.type])[:2]
            ok = pc.fill_null(ok, False)
            own = v.filter(ok)
            if in_json:
                own = [None if x is None else json.loads(x) for x in own.to_pylist()]
            if batch:
                made, said = together(fn, own if isinstance(own, pa.Array) else pa.array(own), rescue)
            else:
                made, said = each(fn, own if isinstance(own, list) else own.to_pylist(), rescue)
            places = pc.cumulative_sum(ok.cast(pa.int64()))
            places = pc.if_else(ok, pc.subtract(places, 1), pa.scalar(None, pa.int64()))
            said = pa.array(said, pa.string()).take(places)
            parts = [pa.array(made, fields[0].type).take(places), pc.and_(ok, pc.is_null(said)), said]
            return closed(pa.StructArray.from_arrays(parts, fields=fields), lengths)

        # Not deterministic for Spark: so it neither writes the call into each of its readers nor makes it twice. The second
        # argument keeps a given column apart, as it is read twice: Spark does not find calls on nested lambdas.
        return F.arrow_udf(run, returnType=returned).asNondeterministic()(given, F.isnull(given))

    def __call__(self, c: Column) -> Column:
        """On a column of its own, outside types: null where the value is null, or the step raised what it rescues."""
        return self.column(F.struct(c.alias("v"), c.isNotNull().alias("ok")))["v"]


def python_step(fn: Callable, dtype: T.DataType, rescue: tuple[type[BaseException], ...] = ()) -> PythonStep:
    """For transform, build and check: fn is called on each valid value, outside and inside arrays and maps. An exception of
    the classes that it rescues is an error of the value, with its text; any other fails the job."""
    return PythonStep(fn, dtype, tuple(rescue), False)


def batch_step(fn: Callable, dtype: T.DataType, rescue: tuple[type[BaseException], ...] = ()) -> PythonStep:
    """As python_step, but fn is called on an Arrow array of many valid values, of all rows and lists of a batch together, and
    gives as many: an Arrow array, a numpy array or a list."""
    return PythonStep(fn, dtype, tuple(rescue), True)


def guarded(fn: Callable, dtype: T.DataType, rescue: tuple[type[BaseException], ...] = ()) -> Callable[[Column, Column], Column]:
    """A function of (guard, value) -> struct<ok, value, error>; Arrow carries the batches."""
    step = python_step(fn, dtype, rescue)

    def apply(guard: Column, value: Column) -> Column:
        r = step.column(F.struct(value.alias("v"), guard.alias("ok")))
        return F.struct(r["ok"].alias("ok"), r["v"].alias("value"), r["e"].alias("error"))

    return apply
