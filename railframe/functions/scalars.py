"""Conversions, attributes and methods as Column functions."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.cells import family

LONG, DOUBLE, STRING = T.LongType(), T.DoubleType(), T.StringType()
DECIMAL = T.DecimalType(38, 18)


def decimal_text(c: Column) -> Column:
    """Plain notation without trailing zeros, but with one digit behind the point."""
    return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", ".0")


def float_text(c: Column) -> Column:
    """A float's shortest text: plain from 0.0001 to below 1e16, else as 1.0e+20."""
    text = c.cast("string")
    mantissa, power = F.regexp_extract(text, r"^(-?[0-9.]+)E", 1), F.regexp_extract(text, r"E(-?[0-9]+)$", 1)
    size = F.abs(c)
    sign = F.when(power.startswith("-"), F.concat(F.lit("-"), F.lpad(F.substring(power, 2, 9), 2, "0"))).otherwise(F.concat(F.lit("+"), F.lpad(power, 2, "0")))
    digits = F.replace(F.replace(mantissa, F.lit("."), F.lit("")), F.lit("-"), F.lit(""))
    minus = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    n = F.expr("1") * F.when(power == "", F.lit("0")).otherwise(power).cast("int")
    whole = F.regexp_replace(digits, "0$", "")
    large = F.concat(minus, F.rpad(whole, 17, "0").substr(F.lit(1), n + 1), F.lit("."), F.when(F.length(whole) > n + 1, whole.substr(n + 2, F.lit(20))).otherwise(F.lit("0")))
    small = F.concat(minus, F.lit("0."), F.repeat(F.lit("0"), -n - 1), whole)
    return F.when(~text.contains("E"), F.when((size != 0) & (size < 1e-4), text).otherwise(text)).when((size >= 1e7) & (size < 1e16), large).when((size >= 1e-4) & (size < 1e-3), small).otherwise(F.concat(mantissa, F.lit("e"), sign))


def as_text(c: Column, dtype: T.DataType) -> Column:
    kind = family(dtype)
    return float_text(c.cast("double")) if kind == "float" else decimal_text(c) if kind == "decimal" else c.cast("string")


def to_i(c: Column, dtype: T.DataType) -> Column:
    """Text: its leading digits, else 0; numbers: without their fraction. Null beyond 64 bits."""
    if family(dtype) == "string":
        lead = F.replace(F.regexp_extract(c, r"^\s*([+-]?[0-9][0-9_]*)", 1), F.lit("_"), F.lit(""))
        return F.when(lead == "", F.lit(0)).otherwise(lead.try_cast("bigint"))
    return c.try_cast("bigint")


def to_f(c: Column, dtype: T.DataType) -> Column:
    if family(dtype) == "string":
        lead = F.regexp_extract(c, r"^\s*([+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?)", 1)
        return F.when(lead == "", F.lit(0.0)).otherwise(lead.try_cast("double"))
    return c.cast("double")


#: name -> (function of value and its type, result type); shorthands of transform.
COERCIONS: dict[str, tuple[Callable[[Column, T.DataType], Column], Any]] = {
    "to_s": (as_text, STRING),
    "to_sym": (as_text, STRING),
    "to_i": (to_i, LONG),
    "to_f": (to_f, DOUBLE),
    "to_a": (lambda c, t: c if isinstance(t, T.ArrayType) else F.map_entries(c), None),
    "to_h": (lambda c, t: c if isinstance(t, T.MapType) else F.map_from_entries(c), None),
}


def split(c: Column, separator: str = ",") -> Column:
    """Parts between a literal separator, without white space around it where it is the comma; no empty parts at the end."""
    pattern = r"\s*,\s*" if separator == "," else "".join(f"\\{x}" if not x.isalnum() and not x.isspace() else x for x in separator)
    parts = F.split(c, pattern, -1)
    n = F.size(parts) - F.coalesce(F.array_position(F.transform(F.reverse(parts), lambda p: p != ""), True).cast("int"), F.lit(0)) + 1
    return F.when(F.array_max(F.transform(parts, F.length)) > 0, F.slice(parts, 1, n)).otherwise(F.array().cast("array<string>"))


def strip(c: Column, dtype: T.DataType) -> Column:
    return F.regexp_replace(c, r"^[\s\x00]+|[\s\x00]+$", "")


#: Methods by name: function of (value, type, *arguments).
METHODS: dict[str, Callable[..., Column]] = {
    "downcase": lambda c, t: F.lower(c),
    "upcase": lambda c, t: F.upper(c),
    "strip": strip,
    "reverse": lambda c, t: F.reverse(c),
    "succ": lambda c, t: c + F.lit(1),
    "abs": lambda c, t: F.abs(c),
    "size": lambda c, t: attribute("size", c, t),
    "length": lambda c, t: attribute("size", c, t),
    "uniq": lambda c, t: F.array_distinct(c),
    "sort": lambda c, t: F.array_sort(c),
    "first": lambda c, t: F.get(c, F.lit(0)),
    "last": lambda c, t: F.try_element_at(c, F.lit(-1)),
    "keys": lambda c, t: F.map_keys(c),
    "values": lambda c, t: F.map_values(c),
    "*": lambda c, t, n: c * F.lit(n),
    "+": lambda c, t, n: F.concat(c, F.lit(n)) if family(t) == "string" else c + F.lit(n),
    "%": lambda c, t, n: c % F.lit(n),
    "[]": lambda c, t, k: c.getField(k) if isinstance(t, T.StructType) else F.try_element_at(c, F.lit(k + 1 if isinstance(k, int) else k)),
    "except": lambda c, t, *ks: c.dropFields(*ks) if isinstance(t, T.StructType) else F.map_filter(c, lambda k, v: ~k.isin(*ks)),
    "filter": lambda c, t, f: F.filter(c, f),
    "transform_values": lambda c, t, f: F.transform_values(c, lambda k, v: f(v)),
    "transform_keys": lambda c, t, f: F.transform_keys(c, lambda k, v: f(k)),
    "extract": lambda c, t, p, group=0: F.regexp_extract(c, p, group),
    "year": lambda c, t: F.year(c),
    "month": lambda c, t: F.month(c),
    "day": lambda c, t: F.day(c),
}


def attribute(name: str, c: Column, dtype: T.DataType) -> Column | None:
    """A value's attribute, or None where values of its type have none of that name."""
    kind = family(dtype)
    if name in ("size", "length") and kind == "string":
        return F.length(c)
    if name in ("size", "length") and kind in ("array", "hash"):
        return F.lit(len(dtype.names)) if isinstance(dtype, T.StructType) else F.size(c)
    if name == "bytesize" and kind == "string":
        return F.octet_length(c)
    if name in ("year", "month", "day", "hour", "minute") and kind in ("date", "time"):
        return getattr(F, name)(c)
    if name in ("first", "last") and kind == "array":
        return METHODS[name](c, dtype)
    if isinstance(dtype, T.StructType) and name in dtype.names:
        return c.getField(name)
    return None


#: kind -> names of the methods that its values answer.
CAPABILITIES: dict[str, set[str]] = {
    "string": {"size", "length", "bytesize", "upcase", "downcase", "strip", "reverse", "split", "empty?", "to_s", "to_i", "to_f", "to_sym", "+", "*", "[]"},
    "symbol": {"size", "length", "upcase", "downcase", "empty?", "to_s", "to_sym", "[]"},
    "integer": {"+", "-", "*", "/", "%", "abs", "succ", "to_i", "to_f", "to_s", "even?", "odd?"},
    "float": {"+", "-", "*", "/", "%", "abs", "to_i", "to_f", "to_s", "nan?"},
    "decimal": {"+", "-", "*", "/", "%", "abs", "to_i", "to_f", "to_s"},
    "boolean": {"to_s"},
    "nil": {"to_s", "to_a", "to_i", "to_h"},
    "date": {"year", "month", "day", "to_s", "iso8601", "succ"},
    "time": {"year", "month", "day", "hour", "minute", "to_s", "iso8601", "to_i", "to_f"},
    "array": {"each", "size", "length", "first", "last", "empty?", "map", "to_a", "to_h", "uniq", "sort", "[]", "+", "reverse"},
    "hash": {"each", "each_pair", "size", "length", "keys", "values", "empty?", "to_a", "to_h", "map", "[]", "except"},
    "range": {"first", "last", "begin", "end", "size", "each"},
}
