"""Types that hold themselves to any depth.

A type is unrolled some levels, and values that nest deeper are put off: the rows that have such values go, each with its
values and their paths, into a table, whose values are unrolled as many levels again, and so on until no value is left. Then
the tables are judged from the last to the first, each value with the results of those inside it at hand, which it looks up
by their paths. So a job runs for some levels, over the rows only that are so deep, and a value of any depth is judged as
its type says, whatever stands around the place where it goes on (choices, negations, steps).
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import nodes as N
from ..plans import sites
from ..plans.cells import ERRORS, Cell, Out, Stages, no_errors, projected, stages
from ..sources.scratch import tasks, written

RESULT = f"map<string,struct<ok:boolean,errors:{ERRORS}>>"


def endless(t: N.Type) -> bool:
    return isinstance(t, N.Deferred) and t.max_depth is None or any(map(endless, t.children()))


def known(t: N.Type, results: Column, makes: list[Callable]) -> N.Type:
    """t with the results of what was put off."""
    return N.transformed(t, lambda x: x.known_by(results, makes) if isinstance(x, N.Deferred) else x)


def by_row(inside: DataFrame, results: str) -> DataFrame:
    """The results of the values inside each row of the table before, as a map from their keys. A map is as large as its row. They are
    merged with their rows: Spark goes by the size of the files, in which results are far smaller than in memory, and would
    broadcast them."""
    pairs = F.collect_list(F.struct("key", F.struct("ok", "errors")))
    return inside.groupBy("inside").agg(F.map_from_entries(pairs).cast(RESULT).alias(results)).hint("merge")


def judged(df: DataFrame, t: N.Type, lowered: Callable[[DataFrame, N.Type], object]) -> tuple[DataFrame, N.Type]:
    """df with a column of results, and t that reads it."""
    found = sites.Found()
    with sites.finding(found):
        low = lowered(df, t)
    if not found.columns:  # no value of it can nest so deep
        return df, t
    results = next(n for n in ("__deep", *(f"__deep{i}" for i in range(len(df.columns)))) if n not in df.columns)
    names = [f"`{n}`" for n in df.columns]
    waiting = low.df.withColumn("__waiting", found.column()).select(*names, "__waiting")
    # A generator, as a filter would be pushed below what it reads, which would be made twice.
    alone = waiting.select(*names, F.explode(F.when(F.size("__waiting") > 0, F.array("__waiting"))).alias("__waiting"))
    # Dealt anew: a table in one file is read by one task, and its deep values are far larger than it.
    deep_rows = written(alone.withColumn("__row", F.monotonically_increasing_id()).repartition(tasks(df.sparkSession), "__row"), "deep_rows")
    if deep_rows.isEmpty():
        return df.withColumn(results, F.lit(None).cast(RESULT)), known(t, F.col(results), found.makes)

    tables = [written(put_off(deep_rows, "__row", "__waiting"), "deep_values")]
    while True:
        inner = written(put_off(by_type(tables[-1], found.makes, lambda m: waiting_of(m, found), "waiting"), "id", "waiting"), "deep_values")
        if inner.isEmpty():
            break
        tables.append(inner)
    outcome = None
    for table in reversed(tables):
        table = table.withColumn("results", F.lit(None).cast(RESULT)) if outcome is None else joined(table, by_row(outcome, "results"))
        judged = by_type(table, found.makes, lambda m: result_of(m, found), "r")
        outcome = written(judged.select("inside", "key", "r.ok", "r.errors"), "deep_results")
    rows = deep_rows.join(by_row(outcome, results).withColumnRenamed("inside", "__row"), "__row", "left").select(*names, results)
    rest = waiting.select(*names, F.explode(F.when(F.size("__waiting") == 0, F.array(F.lit(None).cast(RESULT)))).alias(results))
    return rest.unionByName(rows), known(t, F.col(results), found.makes)


def joined(table: DataFrame, results: DataFrame) -> DataFrame:
    return table.alias("t").join(results.alias("r"), F.col("t.id") == F.col("r.inside"), "left").select("t.*", "r.results")


def put_off(rows: DataFrame, row: str, waiting: str) -> DataFrame:
    """The values that rows of a table wait for: in which row, the key, the path, which type goes on there, and the value."""
    # Not of the column itself, for which Spark would filter by its size first, and so make it twice.
    listed = F.when(F.size(waiting) > 0, F.col(waiting))
    flat = rows.select(F.col(row).alias("inside"), F.explode(listed).alias("w"))
    return flat.select(F.monotonically_increasing_id().alias("id"), "inside", "w.key", "w.path", "w.which", "w.value")


def by_type(table: DataFrame, makes: list[Callable], made: Callable[[Callable], Column], name: str) -> DataFrame:
    """table with a column that made(type) gives for each row's own type; what is read more than once is projected before."""
    parts = []
    for i, make in enumerate(list(makes)):
        with stages(Stages(table.columns, True)) as before:
            column = made(make)
        own = table.where(F.col("which") == i) if len(makes) > 1 else table
        parts.append(before.on(own).withColumn(name, column).select(*table.columns, name))
    return functools.reduce(DataFrame.unionByName, parts)


def value_cell() -> Cell:
    return Cell(F.col("value"), T.VariantType())


def value_path() -> Column:
    return N.below(F.col("path"), projected(N.prefix(F.col("path"))))


def waiting_of(make: Callable, found: sites.Found) -> Column:
    """What a value of a type waits for. Types that come up on the way are added to what is found."""
    own = sites.Found()
    own.makes = found.makes
    with sites.finding(own):
        N.Deferred(make, None).lower(value_cell(), value_path())
    return own.column()


def result_of(make: Callable, found: sites.Found) -> Column:
    """ok and errors of a value of a type."""
    o: Out = N.Deferred(make, None).known_by(F.col("results"), found.makes).lower(value_cell(), value_path())
    ok = projected(o.ok)
    return F.struct(ok.alias("ok"), F.when(ok, no_errors()).otherwise(o.errors).alias("errors"))
