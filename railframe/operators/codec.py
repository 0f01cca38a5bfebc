"""Encoders and codecs: one definition, read from a wire form and written to it.

An encoder turns wire values into a type's values and back. A codec holds encoders for types; it rewrites any type into a
decoder (wire -> values) or an encoder (values -> wire), and nothing of it is left in the result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars
from ..plans import matchers as M
from ..plans import nodes as N
from ..plans import relation as R
from ..plans.cells import VARIANT, Cell, as_variant, one_error


class NoEncoder(N.TypeMismatch):
    """A part of a type that a codec has no encoder for; the message has its path."""


class NoEntry(KeyError):
    """A key that nothing is registered under."""

    def __str__(self) -> str:
        return str(self.args[0])


#: Makes the wire type of a type that an encoder fits: given that type and what takes a part of it, under a name, through the codec.
WireFor = Callable[[N.Type, Callable[[N.Type, str], N.Type]], N.Type]


class Encoder:
    """Wire type and value type with functions of Columns between them; what cannot be converted gives null and is invalid.

    With wire_for the wire type depends on the type that a codec meets: an encoder for all ranges, lists or maps is so one for
    ranges of dates, whose ends the codec turns into text. Without functions the values of both sides are alike but for such parts."""

    def __init__(self, wire: Any, of: Any, decode: Callable[[Column], Column] | None, encode: Callable[[Column], Column] | None, name: str = "encoder", wire_for: WireFor | None = None):
        self.wire, self.of, self.name, self.wire_for = N.wrap(wire), N.wrap(of), name, wire_for
        self._decode, self._encode = decode, encode

    def decoding(self, of: N.Type | None = None, wire: N.Type | None = None) -> N.Type:
        takes, gives = wire or self.wire, of or self.of
        return N.Convert(takes, gives, self._decode, f"decode {self.name}") if self._decode else N.Seq(takes, gives)

    def encoding(self, of: N.Type | None = None, wire: N.Type | None = None) -> N.Type:
        takes = of or self.of
        if wire is None:
            return N.Convert(takes, R.bare(self.wire.output_type), self._encode, f"encode {self.name}") if self._encode else self.wire
        # What the function makes has parts that are values still; the wire type encodes them.
        plain = self.wire_for(takes, lambda part, name: part)
        return N.Seq(N.Convert(takes, plain, self._encode, f"encode {self.name}"), wire) if self._encode else wire

    def operand(self, left: N.Type | None) -> N.Type:
        """Beside a type that makes the encoder's values it encodes, else it decodes."""
        made = R.produced(left) if left is not None else None
        return self.encoding() if made is not None and made <= self.of and not made <= self.wire else self.decoding()

    def __rshift__(self, other: Any) -> N.Type:
        return self.decoding() >> other


# Fixed patterns.
DATE_FORM = r"\A\d{4}-\d{2}-\d{2}\z"
TIME_FORM = r"\A\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?(\.\d+)?(Z|[+-]\d{2}:?\d{2})?)?\z"
FLOAT_FORM = r"\A-?\d+(\.\d+)?([eE][+-]?\d+)?\z"
INTEGER_FORM = r"\A-?\d+\z"
BOOLEAN_FORM = r"\A(?i:true|1|false|0)\z"


def date_pattern(c: Column) -> Column:
    return F.when(c.rlike(DATE_FORM), c.try_cast("date"))


def time_pattern(c: Column) -> Column:
    return F.when(c.rlike(TIME_FORM), F.regexp_replace(c, r"([+-]\d{2})(\d{2})\z", "$1:$2").try_cast("timestamp"))


def time_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


TEXT = N.Gate("string")
DATE = Encoder(TEXT, N.Gate("date"), date_pattern, lambda c: c.cast("string"), "date")
TIME = Encoder(TEXT, N.Gate("time"), time_pattern, time_text, "time")
SYMBOL = Encoder(TEXT, N.Gate("symbol"), lambda c: c, lambda c: c, "symbol")
DECIMAL = Encoder(TEXT[M.Pattern(FLOAT_FORM)], N.Gate("decimal"), lambda c: c.try_cast(scalars.DECIMAL), scalars.decimal_text, "decimal")
# Forms: text that must look exactly so; casts alone are lenient.
INTEGER = Encoder(TEXT[M.Pattern(INTEGER_FORM)], N.Gate("integer"), lambda c: c.try_cast("bigint"), lambda c: c.cast("string"), "integer")
FLOAT = Encoder(TEXT[M.Pattern(FLOAT_FORM)], N.Gate("float"), lambda c: c.try_cast("double"), lambda c: scalars.float_text(c.cast("double")), "float")
NUMERIC = Encoder(TEXT[M.Pattern(FLOAT_FORM)], N.Gate("numeric"), lambda c: c.try_cast("double"), lambda c: scalars.float_text(c.cast("double")), "numeric")
BOOLEAN = Encoder(TEXT[M.Pattern(BOOLEAN_FORM)], N.Gate("boolean"), lambda c: F.lower(c).isin("true", "1"), lambda c: c.cast("string"), "boolean")
NIL = Encoder(TEXT[M.OneOf(("",))], N.Gate("nil"), lambda c: F.lit(None), lambda c: F.lit(""), "nil")


# --- URIs -------------------------------------------------------------------------------------

# Fixed patterns: a scheme and no white space; scheme, authority, path, query and fragment with their marks; an authority's parts.
URI_FORM = r"\A[A-Za-z][A-Za-z0-9+.-]*:\S+\z"
URI_PARTS = r"\A([^:/?#]+):(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?\z"
AUTHORITY = r"\A(.*@)?(\[[^\]]*\]|[^:@\[\]]*)(:[0-9]*)?\z"


def uri_parts(c: Column) -> Column:
    """A URI's text as a struct. Absent parts are null, empty ones empty (but for an empty port, which is none); the path is
    always there. An authority without the form of one, or a port beyond 65535, makes no URI: null."""
    part = lambda n: F.regexp_extract(c, URI_PARTS, n)
    given = lambda text, from_, less=0: F.when(text != "", F.substring(text, F.lit(from_), F.length(text) - less))
    authority = given(part(2), 3)
    of = lambda n: F.regexp_extract(authority, AUTHORITY, n)
    port = F.substring(of(3), 2, 20).try_cast("bigint")
    made = F.struct(
        part(1).alias("scheme"),
        F.when(of(1) != "", F.substring(of(1), F.lit(1), F.length(of(1)) - 1)).alias("user"),
        of(2).alias("host"),
        port.alias("port"),
        part(3).alias("path"),
        given(part(4), 2).alias("query"),
        given(part(5), 2).alias("fragment"),
    )
    return F.when(c.rlike(URI_FORM) & (authority.isNull() | (authority.rlike(AUTHORITY) & ((F.length(of(3)) < 2) | F.coalesce(port <= 65535, F.lit(False))))), made)


def uri_text(c: Column) -> Column:
    """The text of a URI's parts; null where that text would be read as other parts."""
    some = lambda before, name, after="": F.coalesce(F.concat(F.lit(before), c[name].cast("string"), F.lit(after)), F.lit(""))
    authority = F.coalesce(F.concat(F.lit("//"), some("", "user", "@"), c["host"], some(":", "port")), F.lit(""))
    text = F.concat(c["scheme"], F.lit(":"), authority, c["path"], some("?", "query"), some("#", "fragment"))
    back = uri_parts(text)
    same = [back[n].eqNullSafe(c[n]) for n in ("scheme", "user", "host", "port", "path", "query", "fragment")]
    return F.when(reduce(Column.__and__, same), text)


def uri_record(scheme: N.Type) -> N.Record:
    maybe = lambda kind: N.Choice(N.Gate("nil"), N.Gate(kind))
    parts = {"scheme": scheme, "user": maybe("string"), "host": maybe("string"), "port": maybe("integer"), "path": N.Gate("string"), "query": maybe("string"), "fragment": maybe("string")}
    return N.Record(tuple((N.Key(k), t) for k, t in parts.items()))


URI = Encoder(TEXT[M.Pattern(URI_FORM)], uri_record(N.Gate("string")), uri_parts, uri_text, "uri")
HTTP = Encoder(TEXT[M.Pattern(r"\A(?i:https?)://\S+\z")], uri_record(N.Gate("string")[M.Pattern(r"\A(?i:https?)\z")]), uri_parts, uri_text, "http")
FILE = Encoder(TEXT[M.Pattern(r"\A(?i:file):/\S*\z")], uri_record(N.Gate("string")[M.Pattern(r"\A(?i:file)\z")]), uri_parts, uri_text, "file")


def ends(t: N.Type, part: Callable[[N.Type, str], N.Type]) -> N.Type:
    """A range on the wire: the struct of from, to and exclusive, its ends through the codec; each may be null."""
    end = part(N.base_of(t).of, "from")
    maybe = lambda of: N.Choice(N.Gate("nil"), of)
    return N.Record(((N.Key("from"), maybe(end)), (N.Key("to"), maybe(end)), (N.Key("exclusive"), maybe(N.Gate("boolean")))))


RANGE = Encoder(N.Any(), N.Interval(N.Any()), None, None, "range", ends)

#: Types of containers, which encoders of containers may take as a whole; else their parts are rewritten one by one.
CONTAINERS = (N.Record, N.Array, N.Map, N.Tuple, N.Interval)


class Codec:
    """A registry of encoders and of types that pass as they are; a child's own entries come before its parent's."""

    def __init__(self, parent: Codec | None = None, name: str = "codec"):
        self.encoders: list[Encoder] = list(parent.encoders) if parent else []
        self.noops: list[N.Type] = list(parent.noops) if parent else []
        self.name, self.frozen = name, False
        self.registry: dict[str, tuple[N.Type, N.Type]] = {}

    def encoder(self, e: Encoder) -> Codec:
        if self.frozen:
            raise RuntimeError("the codec is frozen")
        self.encoders.append(e)
        return self

    def noop(self, *types: Any) -> Codec:
        if self.frozen:
            raise RuntimeError("the codec is frozen")
        self.noops += [N.wrap(t) for t in types]
        return self

    def freeze(self) -> Codec:
        self.frozen = True
        return self

    # --- directions ---------------------------------------------------------------------------
    def __rshift__(self, t: Any) -> N.Type:
        return self.decoder(t)

    def operand(self, left: N.Type | None) -> N.Type:
        """T >> codec: the encoder of what T makes."""
        return self.rewritten(R.produced(left), False, "", {})

    def decoder(self, t: Any) -> N.Type:
        return self.rewritten(N.wrap(t), True, "", {})

    def encoder_of(self, t: Any) -> N.Type:
        return self.rewritten(R.produced(N.wrap(t)), False, "", {})

    def for_(self, t: Any) -> tuple[N.Type, N.Type]:
        return self.decoder(t), self.encoder_of(t)

    # --- registry -----------------------------------------------------------------------------
    def register(self, key: str, t: Any = None) -> Codec:
        """Types under keys, such as the names of messages; a type alone is its own key, by its name."""
        if self.frozen:
            raise RuntimeError("the codec is frozen")
        if t is None:
            key, t = getattr(key, "__name__", repr(key)), key
        self.registry[key] = self.for_(t)
        return self

    def has(self, key: str) -> bool:
        return key in self.registry

    def decode(self, key: str) -> N.Type:
        return self._entry(key)[0]

    def encode(self, key: str) -> N.Type:
        return self._entry(key)[1]

    def _entry(self, key: str) -> tuple[N.Type, N.Type]:
        if key not in self.registry:
            raise NoEntry(f"{self.name}: nothing is registered under {key!r}, but {sorted(self.registry)}")
        return self.registry[key]

    def decoded_by(self, key: str) -> Dispatch:
        """For records with fields of the key and the payload: each payload decoded by its own row's entry."""
        return Dispatch(self, key, True)

    def encoded_by(self, key: str) -> Dispatch:
        return Dispatch(self, key, False)

    # --- rewriting ----------------------------------------------------------------------------
    def best(self, t: N.Type, path: str) -> Encoder | None:
        """The encoder of the most specific type above t; the last registered of equals; incomparable ones raise."""
        found = [e for e in self.encoders if t <= e.of]
        if not found:
            return None
        top = found[-1]
        for e in reversed(found[:-1]):
            if e.of <= top.of and not top.of <= e.of:
                top = e
            elif not top.of <= e.of:
                raise NoEncoder(f"{path or 'value'}: {top.name} and {e.name} both fit {t!r}")
        return top

    def fitted(self, e: Encoder, t: N.Type, decode: bool, again: Callable) -> N.Type:
        wire = e.wire_for(t, again) if e.wire_for else None
        return e.decoding(t, wire) if decode else e.encoding(t, wire)

    def rewritten(self, t: N.Type, decode: bool, path: str, memo: dict[N.Type, N.Type]) -> N.Type:
        """memo has what types that are named before they are made became: one that holds itself is rewritten once, and where it
        comes again stands the same result, so that a cycle stays a cycle."""
        again = lambda x, part="": self.rewritten(x, decode, f"{path}.{part}".strip(".") if part else path, memo)
        if isinstance(t, N.Deferred):
            if t not in memo:
                memo[t] = N.Deferred(cache(lambda: again(t.target())), t.max_depth)
            return memo[t]
        if isinstance(t, N.Static):
            return t if decode else N.Equals(t.literal)
        if isinstance(t, N.Wrap):
            return t.rebuilt((again(t.inner),))
        if isinstance(t, N.StructOf):
            return again(t.cls.schema)
        if isinstance(t, N.Choice):
            if isinstance(t.left, N.Seq) and isinstance(t.left.left, N.Undefined):  # a default stays one when decoding
                return N.Choice(t.left, again(t.right)) if decode else again(t.right)
            a, b = again(t.left), again(t.right)
            return a if a == b else N.Choice(a, b)
        if isinstance(t, (N.Undefined, N.Never, N.Generate)):
            return t
        if isinstance(t, CONTAINERS) and any(isinstance(e.of, CONTAINERS) and t <= e.of for e in self.encoders):
            return self.fitted(self.best(t, path), t, decode, again)  # a container with a wire form of its own, such as a URI or a range
        if isinstance(t, N.Record) and (t.fields or t.typed or t.rest):
            fields = tuple((k, again(f, k.name)) for k, f in t.fields)
            return N.Record(fields, tuple((k, again(f, "*")) for k, f in t.typed), t.rest and again(t.rest, "*"))
        if isinstance(t, N.FilteredRecord):
            return N.FilteredRecord(again(t.inner))
        if isinstance(t, (N.Array, N.FilteredArray, N.Stream)) and not (isinstance(t, N.Array) and isinstance(t.of, N.Any)):
            return t.rebuilt(tuple(again(c, "[]" if isinstance(t, N.Array) else "") for c in t.children()))
        if isinstance(t, N.Tuple):
            return N.Tuple(tuple(again(c, f"[{i}]") for i, c in enumerate(t.of)))
        if isinstance(t, N.Map):
            return N.Map(t.keys, again(t.values, "{}"))
        if isinstance(t, N.FilteredMap):
            return N.FilteredMap(again(t.inner))
        if isinstance(t, N.Tagged):
            return N.Tagged(t.key, tuple(N.Record(tuple((k, f if k.name == t.key else again(f, k.name)) for k, f in v.fields), v.typed, v.rest) for v in t.variants))
        if isinstance(t, N.Meet):
            return N.Seq(again(t.left), t.right) if decode else again(t.left)
        if isinstance(t, N.Seq):
            return N.Seq(again(t.left), t.right) if decode else again(R.produced(t))
        if isinstance(t, (N.Convert, N.Invoke)):  # a converting leaf: what it takes in is decoded first
            if isinstance(t.input_type, N.Any):
                return t
            return N.Seq(again(R.accepted(t)), t) if decode else again(R.produced(t))
        e = self.best(t, path)
        if e is not None:
            return self.fitted(e, t, decode, again)
        base = N.base_of(t)
        if base is not t and self.best(base, path) is not None:
            return self.fitted(self.best(base, path), t, decode, again)
        if any(t <= n for n in self.noops) or isinstance(t, (N.Any, N.Equals)):
            return t
        raise NoEncoder(f"{path or 'value'}: no encoder for {t!r}")


class Dispatch:
    """A registry as a step over a table: the key column of each row says by which entry its payload goes.

    All entries' types are lowered once, and one CASE over the key chooses; so no row is shuffled or collected, and entries
    may take and give values of any types: results are VARIANT (JSON text in what comes out). A key without an entry is an
    error of its row, and so is a null one."""

    def __init__(self, codec: Codec, key: str, decode: bool):
        self.codec, self.key, self.decode = codec, key, decode

    def apply(self, df: DataFrame, payload: str = "payload", ok: str = "ok", errors: str = "errors") -> DataFrame:
        """df with the payloads that its rows' entries make, whether they are valid, and the errors. The payload column is VARIANT,
        JSON text, or of a type that all entries take."""
        clash = {ok, errors} & set(df.columns)
        if clash:
            raise ValueError(f"columns {sorted(clash)} are there already: give other names for ok and errors")
        column, dtype = F.col(f"`{payload}`"), df.schema[payload].dataType
        if isinstance(dtype, T.StringType):
            column, dtype = F.try_parse_json(column), VARIANT
        key = F.col(f"`{self.key}`").cast("string")
        missed = F.concat(F.lit(f"{self.codec.name}: nothing is registered under "), F.coalesce(key, F.lit("null")))
        value, good, said = F.lit(None).cast("variant"), F.lit(False), one_error(F.lit(self.key), missed)
        for name, (decoder, encoder) in reversed(self.codec.registry.items()):
            o = (decoder if self.decode else encoder).lower(Cell(column, dtype), F.lit(""))
            here = key == name
            value = F.when(here, F.when(o.ok, as_variant(o.value, o.dtype))).otherwise(value)
            good = F.when(here, o.ok).otherwise(good)
            said = F.when(here, o.errors).otherwise(said)
        kept = [c for c in df.columns if c != payload]
        made = df.select(*(F.col(f"`{c}`") for c in kept), value.alias("__value"), good.alias("__ok"), said.alias("__errors"))
        return made.select(*(F.col(f"`{c}`") for c in kept), F.to_json("__value").alias("__value"), "__ok", "__errors").toDF(*kept, payload, ok, errors)


#: JSON: what it has passes; dates, times, decimals and symbols are text.
JSON = Codec(name="json").noop(N.Choice(N.Gate("nil"), N.Choice(N.Gate("string"), N.Choice(N.Gate("numeric"), N.Gate("boolean")))), N.Gate("hash"), N.Gate("array"))
for _e in (SYMBOL, DECIMAL, DATE, TIME, URI, HTTP, FILE, RANGE):
    JSON.encoder(_e)

#: Forms: everything is text, and an empty text is null.
FORMS = Codec(name="forms").noop(N.Gate("string"))
for _e in (SYMBOL, NUMERIC, DECIMAL, FLOAT, INTEGER, BOOLEAN, NIL, DATE, TIME, URI, HTTP, FILE, RANGE):
    FORMS.encoder(_e)

# Both are shared: own encoders go to a Codec that has one of them as its parent.
JSON.freeze()
FORMS.freeze()
