"""Spans of patterns in texts as Column expressions: array<struct<start, end, kind>>, code points, end exclusive.

Spark gives the matches of a pattern and the pieces between them, not their places; the places are running sums of the
lengths of both. All work is row by row, so a text of any length is one row's work and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,kind:int>>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def found(text: Column, pattern: str | Column, gate: str | None = None) -> Column:
    """Leftmost non-overlapping matches, as array<struct<start, end, text>>; empty for null. gate: a string every match holds."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")

    def placed(m: Column) -> Column:
        def put(acc: Column, pair: Column) -> Column:
            start = acc["at"] + F.length(pair["gap"])
            end = start + F.length(pair["text"])
            return F.struct(end.alias("at"), F.concat(acc["got"], F.array(F.struct(start.alias("start"), end.alias("end"), pair["text"].alias("text")))).alias("got"))

        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(m))
        pairs = F.zip_with(gaps, m, lambda g, x: F.struct(g.alias("gap"), x.alias("text")))
        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("got")), put)["got"]

    some = let(matches, lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(none))
    seen = text.isNotNull() & (text.contains(gate) if gate else F.lit(True))
    return F.when(seen, some).otherwise(none)


def kept(matches: Column, kind: int, accept: Callable[[Column], Column]) -> Column:
    """Spans of the matches whose text is accepted."""
    return F.transform(F.filter(matches, lambda m: accept(m["text"])), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def listed(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end by start and then kind, joined by commas."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"]))), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def masked(text: Column, spans: Column, kinds: list[str]) -> Column:
    """text with each span replaced by its kind in angle brackets; of overlapping spans the first names the whole stretch."""
    names = F.array(*map(F.lit, kinds))

    def put(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        grown = F.concat(acc["out"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.element_at(names, s["kind"] + 1), F.lit(">"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, grown).otherwise(acc["out"]).alias("out"))

    done = lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text)))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.when(F.size(spans) > 0, F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), put, done)).otherwise(text)


def upper_tail(z: Column) -> Column:
    """An upper bound of the normal distribution's upper tail (for z < 0 its complement), at z = 0 exact."""
    size = F.abs(z)
    bound = F.exp(-size * size / 2) * F.lit(0.3989422804014327) * 2 / (size + F.sqrt(size * size + F.lit(2.5464790894703255)))
    return F.when(z >= 0, bound).otherwise(1 - bound)
