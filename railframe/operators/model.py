"""Struct classes: a record with a name, inherited attributes and steps that come first.

class User(Struct):
    name = attribute(String.present())
    age = attribute(Integer, optional=True)

    class address(Struct):      # an attribute that is a struct of its own, User.Address
        city = attribute(String)

    @many                       # an array of them, User.Friends
    class friends(Struct):
        name = attribute(String)

User.new(df) gives the attributes, whether the row is valid, and the errors. Every struct inside has its own: User.valid("friends[0]")
and User.errors("friends[0]") are Columns of that result.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import nodes as N


class attribute:  # noqa: N801
    """A declared attribute. writer: it may be set again with Struct.set."""

    def __init__(self, of: Any, optional: bool = False, writer: bool = False):
        self.of, self.optional, self.writer = of, optional, writer
        #: The struct class of an attribute that is a struct, or an array of them.
        self.inner = of if isinstance(of, Meta) else of[0] if isinstance(of, list) and of and isinstance(of[0], Meta) else None


def many(cls: type) -> type:
    """A struct class inside another, as an array."""
    cls.as_array = True
    return cls


def maybe(cls: type) -> type:
    """A struct class inside another, as an attribute that may be absent."""
    cls.as_optional = True
    return cls


class Meta(type):
    def __new__(mcs, name, bases, space):
        for k, v in list(space.items()):
            if isinstance(v, Meta) and not k[:1].isupper():  # a class inside: an attribute, and a class by its name
                v.__name__ = k[:1].upper() + k[1:]
                space[k] = attribute([v] if v.as_array else v, v.as_optional)
                space.setdefault(v.__name__, v)
        own = {k: v for k, v in space.items() if isinstance(v, attribute)}
        for k in own:
            del space[k]
        cls = super().__new__(mcs, name, bases, space)
        cls.attributes = {k: a for b in reversed(bases) for k, a in getattr(b, "attributes", {}).items()} | own
        cls.steps = tuple(s for b in reversed(bases) for s in getattr(b, "steps", ())) + tuple(space.get("before", ()))
        cls.schema = N.Record(tuple((N.Key(k, a.optional), N.wrap(a.of)) for k, a in cls.attributes.items()))
        return cls

    def __le__(cls, other):
        return N.StructOf(cls) <= other

    def __rshift__(cls, other):
        return N.StructOf(cls) >> other

    def __or__(cls, other):
        return N.StructOf(cls) | other


class Struct(metaclass=Meta):
    """Columns of this struct: `of` makes a type, `with_` and `set` change attributes and run the schema on them again."""

    before: tuple = ()
    as_array = as_optional = False

    @classmethod
    def new(cls, df: DataFrame) -> DataFrame:
        """All rows: the attributes as far as they are valid, ok and errors. Nothing is raised."""
        from .dataset import validate

        return validate(df, cls.of())

    @classmethod
    def errors(cls, at: str = "") -> Column:
        """Of a table that new gives: the errors of the struct at a path (friends[0], address), by paths inside it."""
        if not at:
            return F.col("errors")
        cls.attribute_at(at)
        own = lambda e: (e["path"] == at) | e["path"].startswith(f"{at}.") | e["path"].startswith(f"{at}[")
        inside = lambda e: F.regexp_replace(F.substr(e["path"], F.lit(len(at) + 1)), r"^\.", "")
        return F.transform(F.filter("errors", own), lambda e: F.struct(inside(e).alias("path"), e["message"].alias("message")))

    @classmethod
    def valid(cls, at: str = "") -> Column:
        """Of a table that new gives: whether the struct at a path is valid, whatever the others are."""
        return F.size(cls.errors(at)) == 0

    @classmethod
    def attribute_at(cls, path: str) -> attribute:
        """The declared attribute at a path through the structs inside; one that is not declared raises."""
        name, _, rest = path.partition(".")
        name = name.partition("[")[0]
        if name not in cls.attributes:
            raise AttributeError(f"{cls.__name__} has no attribute {name}")
        own = cls.attributes[name]
        return own.inner.attribute_at(rest) if rest and own.inner is not None else own

    @classmethod
    def same(cls, a: str | Column, b: str | Column) -> Column:
        """Whether two columns of this struct are equal in all declared attributes, those of structs inside too; null is as null."""
        return cls._plain(a).eqNullSafe(cls._plain(b))

    @classmethod
    def _plain(cls, c: str | Column) -> Column:
        c = F.col(c) if isinstance(c, str) else c

        def part(name: str, own: attribute) -> Column:
            value = c.getField(name)
            if own.inner is None:
                return value
            return F.transform(value, own.inner._plain) if own.inner.as_array else own.inner._plain(value)

        made = F.struct(*(part(k, a).alias(k) for k, a in cls.attributes.items() if not a.optional or a.inner is not None))
        return F.when(c.isNotNull(), made)

    @classmethod
    def whole(cls) -> N.Type:
        out = None
        for s in cls.steps:
            out = N.wrap(s) if out is None else N.Seq(out, N.wrap(s))
        return cls.schema if out is None else N.Seq(out, cls.schema)

    @classmethod
    def of(cls) -> N.Type:
        return N.StructOf(cls)

    @classmethod
    def from_record(cls, name: str, record: Any) -> type:
        r = N.wrap(record)
        return Meta(name, (cls,), {k.name: attribute(t, k.optional) for k, t in r.fields})

    @classmethod
    def with_(cls, df: DataFrame, **changes: Column) -> DataFrame:
        """Rows with some attributes changed, validated anew (value, ok, errors)."""
        from .dataset import validate

        unknown = {k.partition(".")[0] for k in changes} - set(cls.attributes)
        if unknown:
            raise AttributeError(f"no attribute {', '.join(sorted(unknown))}")
        for path, value in changes.items():
            cls.attribute_at(path)
            name, _, rest = path.partition(".")
            df = df.withColumn(name, F.col(f"`{name}`").withField(rest, value) if rest else value)
        return validate(df, cls.of())

    @classmethod
    def set(cls, df: DataFrame, name: str, value: Column) -> DataFrame:
        if not cls.attributes[name].writer:
            raise AttributeError(f"{name} cannot be written")
        return cls.with_(df, **{name: value})

    @classmethod
    def to_h(cls) -> Column:
        return F.to_json(F.struct(*(F.col(k) for k in cls.attributes)))
