"""Types on DataFrames, batch or streaming: one projection and one filter, and no shuffle.

validate keeps all rows beside ok and errors; filtered keeps the valid rows; split gives both parts; parse fails the job at
the first invalid row. The filters are on ok, plain conditions that Spark pushes to the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import nodes as N
from ..plans.cells import Cell, Out, Stages, stages
from . import deep


@dataclass
class Lowered:
    """A type on a table: what it makes, and the table with what is projected before."""

    df: DataFrame
    out: Out
    #: The columns of the table as it was given.
    names: list[str]
    #: Whether it is made in projections before, or would be better so.
    large: bool = False


def lowered(df: DataFrame, t: object, column: str | None = None) -> Out:
    """What a type makes of a table, or of one column, in Columns."""
    return prepared(df, t, column).out


def prepared(df: DataFrame, t: object, column: str | None = None, binds: bool = False, filters: bool = False) -> Lowered:
    """Types that hold themselves to any depth are judged beforehand, by jobs, where the table is no stream. binds: large results
    stand in projections before; not where a filter follows, which Spark would write them into, as it pushes it down. filters: they
    do where a result is large, and the caller keeps its filter from being pushed."""
    t = N.wrap(t)
    if isinstance(t, N.Stream):
        t = t.of
    names = df.columns
    if not df.isStreaming and deep.endless(t):
        df, t = deep.judged(df, t, lambda df, t: of_rows(df, t, column, names, False))
    low = of_rows(df, t, column, names, binds)
    return of_rows(df, t, column, names, True) if filters and low.large else low


def of_rows(df: DataFrame, t: N.Type, column: str | None, names: list[str], binds: bool) -> Lowered:
    cell = Cell(F.struct(*(F.col(f"`{n}`") for n in names)), T.StructType([df.schema[n] for n in names]), row=True) if column is None else Cell(F.col(f"`{column}`"), df.schema[column].dataType)
    with stages(Stages(df.columns, binds)) as before:
        out = t.lower(cell, F.lit(""))
        if binds:  # what is read stands in the projections
            _ = out.ok, out.errors, columns(out, column)
    return Lowered(before.on(df), out, names, before.large)


def public(value: Column, dtype: T.DataType) -> Column:
    """VARIANT as JSON text, so that results can be compared and grouped."""
    return F.to_json(value) if isinstance(dtype, T.VariantType) else value


def columns(o: Out, column: str | None) -> dict[str, Column]:
    """What a type makes, by name."""
    if o.fields is not None and column is None:
        return {k: public(f.value, f.dtype) for k, f in o.fields.items()}
    if column is None and isinstance(o.dtype, T.StructType):
        return {f.name: public(o.value.getField(f.name), f.dataType) for f in o.dtype}
    return {column or "value": public(o.value, o.dtype)}


def selected(low: Lowered, column: str | None, made: dict[str, Column]) -> DataFrame:
    """The other columns, if one was read, and those made. Names come last: no expression can mean a new column by an old name."""
    kept = [c for c in low.names if c != column] if column is not None else []
    columns = [*(F.col(f"`{c}`") for c in kept), *made.values()]
    return low.df.select(*(c.alias(f"__{i}") for i, c in enumerate(columns))).toDF(*kept, *made)


def validate(df: DataFrame, t: object, column: str | None = None, ok: str = "ok", errors: str = "errors") -> DataFrame:
    """The fields that t makes of each row (or of one column), whether they are valid, and the errors (path, message).

    Other columns and fields must not have the names of `ok` and `errors`: name these anew there."""
    low = prepared(df, t, column, True)
    made = columns(low.out, column)
    clash = {ok, errors} & ({*made} | ({*low.names} - {column} if column is not None else set()))
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already: give validate other names for ok and errors")
    return selected(low, column, made | {ok: low.out.ok, errors: low.out.errors})


def filtered(df: DataFrame, t: object, column: str | None = None) -> DataFrame:
    """The valid rows only. Where results stand in projections before, a generator leaves out the others, as Spark would write
    the projections into a filter that it pushes down; a short chain's filter goes to the scan."""
    low = prepared(df, t, column, filters=True)
    made = columns(low.out, column)
    if not low.large:
        low.df = low.df.where(low.out.ok)
        return selected(low, column, made)
    test = spare([*low.names, *made], "__valid")
    return generated(selected(low, column, made | {test: low.out.ok}), test)


def spare(taken: list[str], name: str) -> str:
    while name in taken:
        name += "_"
    return name


def generated(rows: DataFrame, test: str) -> DataFrame:
    """The rows for which a column is true, without it."""
    kept = [F.col(f"`{c}`") for c in rows.columns if c != test]
    one = F.explode(F.when(F.col(f"`{test}`"), F.array(F.lit(True)))).alias(spare(rows.columns, "__one"))
    return rows.select(*kept, one).select(*kept)


def invalid(df: DataFrame, t: object, column: str | None = None, errors: str = "errors") -> DataFrame:
    """The rows that are not valid, as they came, with errors (in place of a column of that name)."""
    low = prepared(df, t, column, filters=True)
    own = [c for c in low.names if c != errors]
    if low.large:
        test = spare([*own, errors], "__invalid")
        rows = low.df.select(*(F.col(f"`{c}`") for c in own), low.out.errors.alias("__errors"), (~low.out.ok).alias(test))
        return generated(rows.toDF(*own, errors, test), test)
    rows = low.df.where(~low.out.ok).select(*(F.col(f"`{c}`") for c in own), low.out.errors.alias("__errors"))
    return rows.toDF(*own, errors)


def split(df: DataFrame, t: object, column: str | None = None) -> tuple[DataFrame, DataFrame]:
    return filtered(df, t, column), invalid(df, t, column)


def parse(df: DataFrame, t: object, column: str | None = None) -> DataFrame:
    """All rows, or an error that names the first invalid row's errors."""
    low = prepared(df, t, column, True)
    guard = lambda c: F.when(low.out.ok, c).otherwise(F.raise_error(F.to_json(low.out.errors)))
    return selected(low, column, {n: guard(c) for n, c in columns(low.out, column).items()})


def report(df: DataFrame, t: object) -> DataFrame:
    """An extension: errors by path and message over all rows, counted with partial aggregation."""
    low = prepared(df, t)
    bad = low.df.select(F.explode(low.out.errors).alias("e"))
    return bad.groupBy("e.path", "e.message").agg(F.count("*").alias("rows"))


def exploded(df: DataFrame, column: str, t: object) -> DataFrame:
    """An array column as a stream: one row for each element, with its place, validity and errors."""
    flat = df.select("*", F.posexplode(F.col(f"`{column}`")).alias("place", "element")).drop(column)
    return validate(flat, t, "element")
