"""What a type expression says to others: Spark types, JSON Schema, Mermaid diagrams, metadata."""

from __future__ import annotations

import datetime
import decimal
import json
from collections.abc import Callable
from typing import Any as Obj

from pyspark.sql import types as T

from . import matchers as M
from . import nodes as N
from .cells import TAGS, VARIANT, common

JSON_KINDS = {"string": {"type": "string"}, "symbol": {"type": "string"}, "integer": {"type": "integer"}, "numeric": {"type": "number"}, "decimal": {"type": "number"}, "float": {"type": "number"}, "true": {"type": "boolean"}, "false": {"type": "boolean"}, "boolean": {"type": "boolean"}, "nil": {"type": "null"}, "date": {"type": "string", "format": "date"}, "time": {"type": "string", "format": "date-time"}, "array": {"type": "array"}, "hash": {"type": "object"}, "range": {"type": "object"}}


def data_type(t: N.Type) -> T.DataType:
    """The Spark type of what t makes; VARIANT where values may be of several."""
    match t:
        case N.Wrap(inner=i) | N.Not(inner=i):
            return data_type(i) if isinstance(t, N.Wrap) else VARIANT
        case N.StructOf(cls=c):
            return data_type(c.schema)
        case N.Foreign(dtype=d):
            return d
        case N.Gate(kind=k):
            return T.MapType(T.StringType(), VARIANT) if k == "hash" else TAGS[k][1] if k in TAGS else VARIANT
        case N.Equals(literal=v) | N.Static(literal=v):
            return N._dtype_of(v)
        case N.Generate(of=o):
            return data_type(o)
        case N.Refine(base=b):
            found = data_type(b)
            return TAGS[k][1] if isinstance(found, T.VariantType) and isinstance(t.matcher, M.Kind) and (k := t.matcher.name) in TAGS else found
        case N.Meet(left=left):
            return data_type(left)
        case N.Seq() | N.Convert() | N.Invoke():
            return VARIANT if t.output_type is t else data_type(t.output_type)
        case N.Choice(left=a, right=b):
            return common(data_type(a), data_type(b))
        case N.Array(of=o) | N.FilteredArray(inner=N.Array(of=o)) | N.Stream(of=o):
            return T.ArrayType(data_type(o))
        case N.Map(keys=k, values=v) | N.FilteredMap(inner=N.Map(keys=k, values=v)):
            return T.MapType(data_type(k), data_type(v))
        case N.Tuple(of=parts):
            return T.StructType([T.StructField(f"_{i}", data_type(p)) for i, p in enumerate(parts)])
        case N.Record():
            if not t.fields and not t.typed and t.rest is None:
                return T.MapType(T.StringType(), VARIANT)
            fields = [T.StructField(k.name, data_type(f), True, metadata(f) or None) for k, f in t.fields]
            tail = [f for _, f in t.typed] + ([t.rest] if t.rest and not isinstance(t.rest, N.Never) else [])
            return T.StructType(fields + ([T.StructField("_", T.MapType(T.StringType(), data_type(tail[0]) if len(tail) == 1 else VARIANT))] if tail else []))
        case N.FilteredRecord(inner=r):
            return data_type(r)
        case N.Tagged(variants=vs):
            found: dict[str, T.DataType] = {}
            for v in vs:
                for f in data_type(v):
                    found[f.name] = common(found[f.name], f.dataType) if f.name in found else f.dataType
            return T.StructType([T.StructField(k, d) for k, d in found.items()])
        case N.Interval(of=o):
            return T.StructType([T.StructField("from", data_type(o)), T.StructField("to", data_type(o)), T.StructField("exclusive", T.BooleanType())])
        case N.Never() | N.Undefined():
            return T.NullType()
    return VARIANT


# --- visitors ---------------------------------------------------------------------------------


class Visitor:
    """Handlers by node class; a class without one goes to its parent's."""

    def __init__(self):
        self.handlers: dict[type, Callable] = {}

    def on(self, *classes: type) -> Callable:
        def register(fn: Callable) -> Callable:
            for c in classes:
                self.handlers[c] = fn
            return fn

        return register

    def visit(self, t: N.Type, *context: Obj) -> Obj:
        for c in type(t).__mro__:
            if c in self.handlers:
                return self.handlers[c](t, *context)
        raise TypeError(f"no handler for {type(t).__name__}")


def native(v: Obj) -> Obj:
    """A value as JSON has it; one that JSON lacks raises."""
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return [native(x) for x in v]
    if isinstance(v, dict):
        return {str(k): native(x) for k, x in v.items()}
    json.dumps(v)
    return v


#: Register handlers of own node classes with @JSON.on(Class).
JSON = Visitor()


def json_schema(t: N.Type, root: bool = False) -> dict:
    """JSON Schema of what t takes in. Types that hold themselves become definitions."""
    defs: dict = {}
    out = JSON.visit(t, defs)
    head = {"$schema": "https://json-schema.org/draft-08/schema#"} if root else {}
    return head | out | ({"$defs": {name: body for name, body in defs.values()}} if defs else {})


#: Keywords of which the larger or the smaller bound holds where both sides have one.
LARGER = {"minimum", "exclusiveMinimum", "minLength", "minItems", "minProperties", "formatMinimum"}
SMALLER = {"maximum", "exclusiveMaximum", "maxLength", "maxItems", "maxProperties", "formatMaximum", "formatExclusiveMaximum"}
#: Keywords that say something about a value, besides bounds; the others are notes, of which the first side's hold.
STRICT = {"type", "enum", "const", "pattern", "format", "not", "anyOf", "allOf", "items", "prefixItems", "additionalProperties", "patternProperties", "if", "then", "$ref"}


def merged(a: dict, b: dict) -> dict:
    """What satisfies both schemas. Bounds are narrowed, properties are merged each; what does not merge goes to allOf."""
    out, rest = dict(a), []
    for k, v in b.items():
        if k not in out or out[k] == v:
            out[k] = v
        elif k in LARGER:
            out[k] = max(out[k], v)
        elif k in SMALLER:
            out[k] = min(out[k], v)
        elif k == "type" and {out[k], v} == {"integer", "number"}:
            out[k] = "integer"
        elif k == "enum":
            out[k] = [x for x in out[k] if x in v]
        elif k == "required":
            out[k] = [*out[k], *(x for x in v if x not in out[k])]
        elif k == "properties":
            out[k] = out[k] | {n: merged(out[k][n], p) if n in out[k] else p for n, p in v.items()}
        elif k == "allOf":
            out[k] = [*out[k], *(x for x in v if x not in out[k])]
        elif k in STRICT:
            rest.append({k: v})
    if rest:
        out["allOf"] = [*out.get("allOf", []), *(x for x in rest if x not in out.get("allOf", []))]
    return out


def either(parts: list[dict]) -> dict:
    """What satisfies one of the schemas: what all branches say stands once, before them, if it says of which type the value is."""
    if len(parts) == 1:
        return parts[0]
    same = {k: v for k, v in parts[0].items() if all(k in p and p[k] == v for p in parts[1:])}
    if "type" not in same:
        return {"anyOf": parts}
    rest = [{k: v for k, v in p.items() if k not in same} for p in parts]
    if {} in rest:  # that branch takes all that the base takes
        return same
    if all(set(r) == {"const"} for r in rest):
        return same | {"enum": [r["const"] for r in rest]}
    return merged(same, {"anyOf": rest})


@JSON.on(N.Type)
def _plain(t, defs):
    return {}


@JSON.on(N.Never)
def _never(t, defs):
    return {"not": {}}


@JSON.on(N.Gate)
def _gate(t, defs):
    return dict(JSON_KINDS[t.kind])


@JSON.on(N.Equals)
def _equals(t, defs):
    kind = M.kind_of(t.literal)
    return {"const": native(t.literal)} | JSON_KINDS.get(kind, {}) if kind != "nil" else {"type": "null"}


@JSON.on(N.Static)
def _static(t, defs):
    return {"const": native(t.literal), "default": native(t.literal)} | JSON_KINDS.get(M.kind_of(t.literal), {})


@JSON.on(N.Refine)
def _refine(t, defs):
    base, own = JSON.visit(t.base, defs), bounds(t.matcher)
    if base.get("type") in ("integer", "number") and own.get("type") == "string":  # text that a number is matched as
        own.pop("type")
    return merged(base, own)


def bounds(m: M.Matcher) -> dict:
    if isinstance(m, M.Pattern):
        return {"pattern": m.source, "type": "string"}
    if isinstance(m, M.OneOf):
        return {"enum": native(list(m.values))}
    if isinstance(m, M.Equal):
        return {"const": native(m.value)}
    if isinstance(m, M.Between):
        dated = any(isinstance(v, datetime.date) for v in m.ends())
        low, high, over = ("formatMinimum", "formatMaximum", "formatExclusiveMaximum") if dated else ("minimum", "maximum", "exclusiveMaximum")
        out = {} if m.low is None else {low: native(m.low)}
        if m.high is not None:
            whole = m.exclusive and isinstance(m.high, int)
            out |= {high: m.high - 1} if whole else {over if m.exclusive else high: native(m.high)}
        return out
    return {}


@JSON.on(N.Check)
def _check(t, defs):
    return JSON.visit(t.base, defs)


@JSON.on(N.Attr)
def _attr(t, defs):
    out = JSON.visit(t.base, defs)
    if t.name not in ("size", "length"):
        return out
    low, high = ("minItems", "maxItems") if out.get("type") == "array" else ("minProperties", "maxProperties") if out.get("type") == "object" else ("minLength", "maxLength")
    if isinstance(t.matcher, M.Equal):
        return out | {low: t.matcher.value, high: t.matcher.value}
    if isinstance(t.matcher, M.Between):
        top = t.matcher.high if not t.matcher.exclusive else t.matcher.high - 1 if t.matcher.high is not None else None
        return out | ({} if t.matcher.low is None else {low: t.matcher.low}) | ({} if top is None else {high: top})
    return out


@JSON.on(N.Not)
def _not(t, defs):
    return {"not": JSON.visit(t.inner, defs)}


@JSON.on(N.Seq)
def _seq(t, defs):
    a = JSON.visit(t.left, defs)
    b = JSON.visit(t.right, defs)
    return a if "type" in a and "type" in b and a["type"] != b["type"] else merged(a, b)


@JSON.on(N.Meet)
def _meet(t, defs):
    return merged(JSON.visit(t.left, defs), JSON.visit(t.right, defs))


@JSON.on(N.Choice)
def _choice(t, defs):
    left = t.left
    if isinstance(left, N.Seq) and isinstance(left.left, N.Undefined):  # a default
        return JSON.visit(t.right, defs) | ({"default": native(left.right.literal)} if isinstance(left.right, N.Static) else {})
    parts: list = []
    for b in branches(t):
        own = JSON.visit(b, defs)
        parts += [p for p in (own["anyOf"] if set(own) == {"anyOf"} else [own]) if p not in parts]
    return either(parts)


def branches(t: N.Type) -> list[N.Type]:
    """The branches of a choice of choices, without defaults, which are choices with notes of their own."""
    if type(t) is not N.Choice or isinstance(t.left, N.Seq) and isinstance(t.left.left, N.Undefined):
        return [t]
    return branches(t.left) + branches(t.right)


#: The JSON types of kinds that have one.
SCALARS = {k: v["type"] for k, v in JSON_KINDS.items() if isinstance(v.get("type"), str)}


@JSON.on(N.Capability)
def _capability(t, defs):
    """The JSON types whose values answer the methods."""
    own = list(dict.fromkeys(SCALARS[k] for k in t.kinds() if k in SCALARS))
    own = [x for x in own if not (x == "integer" and "number" in own)]
    return {"type": own[0]} if len(own) == 1 else {"type": own} if own else {"not": {}}


@JSON.on(N.Convert)
def _convert(t, defs):
    a = JSON.visit(t.inp, defs)
    return a if "type" in a or "anyOf" in a else merged(a, JSON.visit(t.out, defs))


@JSON.on(N.Invoke)
def _invoke(t, defs):
    return JSON.visit(t.inp, defs)


@JSON.on(N.Generate)
def _generate(t, defs):
    return JSON.visit(t.of, defs)


@JSON.on(N.Record)
def _record(t, defs):
    out: dict = {"type": "object", "properties": {k.name: JSON.visit(f, defs) for k, f in t.fields}, "required": [k.name for k, _ in t.fields if not k.optional]}
    patterns = {k.matcher.source: JSON.visit(f, defs) for k, f in t.typed if type(k) is N.Refine and isinstance(k.matcher, M.Pattern)}
    if patterns:
        out["patternProperties"] = patterns
    if t.rest is not None:
        out["additionalProperties"] = False if isinstance(t.rest, N.Never) else JSON.visit(t.rest, defs) or True
    return out


@JSON.on(N.FilteredRecord)
def _filtered(t, defs):
    return JSON.visit(t.output_type, defs)


@JSON.on(N.FilteredArray, N.FilteredMap)
def _inner(t, defs):
    return JSON.visit(t.inner, defs)


@JSON.on(N.StructOf)
def _struct(t, defs):
    return JSON.visit(t.cls.schema, defs)


@JSON.on(N.Map)
def _map(t, defs):
    return {"type": "object", "patternProperties": {".*": JSON.visit(t.values, defs)}}


@JSON.on(N.Array, N.Stream)
def _array(t, defs):
    return {"type": "array", "items": JSON.visit(t.of, defs)}


@JSON.on(N.Tuple)
def _tuple(t, defs):
    return {"type": "array", "prefixItems": [JSON.visit(p, defs) for p in t.of]}


@JSON.on(N.Interval)
def _interval(t, defs):
    end = JSON.visit(t.of, defs)
    return {"type": "object", "properties": {"from": end, "to": end, "exclusive": {"type": "boolean"}}}


@JSON.on(N.Tagged)
def _tagged(t, defs):
    rules = [{"if": {"properties": {t.key: {"const": native(tag)}}}, "then": {k: v for k, v in JSON.visit(r, defs).items() if k != "type"}} for tag, r in zip(t.tags(), t.variants)]
    return {"type": "object", "properties": {t.key: {"type": "string", "enum": native(t.tags())}}, "required": [t.key], "allOf": rules}


@JSON.on(N.Deferred)
def _deferred(t, defs, given=None):
    key = id(t.make)
    if key not in defs:
        name = given or getattr(t.make, "__name__", "type").strip("<>")
        taken = {n for n, _ in defs.values()}
        while name in taken:
            name += "_"
        defs[key] = (name, {})
        defs[key] = (name, JSON.visit(t.target(), defs))
    return {"$ref": f"#/$defs/{defs[key][0]}"}


@JSON.on(N.Wrap)
def _wrap(t, defs):
    if t.role == "name" and isinstance(t.inner, N.Deferred):
        return _deferred(t.inner, defs, t.name)
    out = JSON.visit(t.inner, defs)
    if t.role == "metadata":
        return {str(k): native(v) for k, v in t.data} | out
    data = dict(t.data)
    if t.name == "options" and isinstance(data.get("options"), (list, tuple)):
        return out | {"enum": native(data["options"])}
    if t.name == "excluded_from":
        return out | {"not": {"enum": native(data["excluded_from"])}}
    if t.role == "label":
        return {"uuid": {"type": "string", "format": "uuid"}, "email": {"type": "string", "format": "email"}, "boolean": {"type": "boolean"}, "uri": {"type": "string", "format": "uri"}}.get(t.name, out)
    return out


# --- metadata and diagrams --------------------------------------------------------------------


def metadata(t: N.Type) -> dict:
    """What metadata and policies around t say, and its kind."""
    out: dict = {}
    if isinstance(t, N.Wrap):
        out = metadata(t.inner) | ({t.name: True} if t.role == "policy" and not t.data else {}) | (dict(t.data) if t.role != "label" else {})
    elif isinstance(t, N.Refine):
        out = metadata(t.base)
    elif isinstance(t, N.Choice):
        out = metadata(t.left) | metadata(t.right)
    elif isinstance(t, N.Seq):
        out = metadata(t.left) | metadata(t.right)
    elif isinstance(t, N.Convert):
        out = metadata(t.inp) | metadata(t.out)
    return {str(k): list(v) if isinstance(v, tuple) else v for k, v in out.items()}


def mermaid(t: N.Type, direction: str = "LR") -> str:
    """A flowchart: sequences in a row, choices side by side, containers around their parts."""
    lines, count = [f"flowchart {direction}"], [0]

    def node(text: str, shape: tuple[str, str] = ("[", "]")) -> str:
        count[0] += 1
        name = f"n{count[0]}"
        clean = text.replace('"', "'")
        lines.append(f'  {name}{shape[0]}"{clean}"{shape[1]}')
        return name

    def walk(x: N.Type) -> tuple[list[str], list[str]]:
        """First and last nodes."""
        if isinstance(x, N.Wrap) and x.role == "name":
            if isinstance(x.inner, N.Deferred):
                n = node(x.name)
                return [n], [n]
            lines.append(f'  subgraph g{len(lines)}["{x.name}"]')
            inside = walk(x.inner)
            lines.append("  end")
            return inside
        if isinstance(x, N.Wrap):
            return walk(x.inner)
        if isinstance(x, N.Refine):
            a, b = walk(x.base)
            test = node(x.message if type(x) is N.Check else x.matcher.message(), ("{", "}"))
            lines.extend(f"  {e} --> {test}" for e in b)
            return a, [test]
        if isinstance(x, N.Seq):
            (a, b), (c, d) = walk(x.left), walk(x.right)
            lines.extend(f"  {e} --> {f}" for e in b for f in c)
            return a, d
        if isinstance(x, N.Convert):
            (a, b), f = walk(x.inp), node(x.name, ("([", "])"))
            c, d = walk(x.out)
            lines.extend(f"  {e} --> {f}" for e in b)
            lines.extend(f"  {f} --> {e}" for e in c)
            return a, d
        if isinstance(x, N.Choice):
            (a, b), (c, d) = walk(x.left), walk(x.right)
            start = node("or", ("((", "))"))
            lines.extend(f"  {start} --> {e}" for e in (*a, *c))
            return [start], [*b, *d]
        if isinstance(x, N.Gate):
            n = node(M.NAMES[x.kind])
        elif isinstance(x, (N.Equals, N.Static)):
            n = node(M.shown(x.literal))
        elif isinstance(x, N.Record):
            n = node("Hash[" + ", ".join(k.name + "?" * k.optional for k, _ in x.fields) + "]", ("[[", "]]"))
            for k, f in x.fields:
                lines.extend(f"  {n} -- {k.name} --> {e}" for e in walk(f)[0])
        else:
            n = node(type(x).__name__)
            if not isinstance(x, N.Deferred):
                for c in x.children():
                    lines.extend(f"  {n} --> {e}" for e in walk(c)[0])
        return [n], [n]

    walk(t)
    return "\n".join(lines)
