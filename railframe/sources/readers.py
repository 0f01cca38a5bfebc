"""Where values come from and go to: files, configuration maps, downloads; wire forms in and out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dataset import filtered, invalid, prepared
from ..plans import nodes as N
from .scratch import written

#: Bytes of the splits' names up to which their table is broadcast; beyond, it is joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Columns of where a row was read: its file, where its split starts, its place in its task.
FILE, START, PLACE = "__file", "__start", "__place"


def text_schema(t: object) -> T.StructType:
    """A record's fields, all as text."""
    return T.StructType([T.StructField(k.name, T.StringType()) for k, _ in N.wrap(t).fields])


def csv(spark: SparkSession, path: str, t: object, header: bool = True, **options: str) -> DataFrame:
    """Rows of CSV files as text, with the fields of a record; its types convert and check them."""
    return spark.read.options(header=header, **options).schema(text_schema(t)).csv(path)


def json_lines(spark: SparkSession, path: str, column: str = "value") -> DataFrame:
    """Lines of JSON as VARIANT; what is not JSON is null."""
    return spark.read.text(path).select(F.try_parse_json("value").alias(column))


def read_from(df: DataFrame) -> DataFrame:
    """Rows just read from files, with the file and the start of the split that each comes from."""
    return df.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(START))


def numbered(df: DataFrame, line: str = "line", row: str | None = None, path: str | None = None, before: int = 0) -> DataFrame:
    """Rows just read from files (or out of `read_from`), each with its number in its file, from 1 and without gaps; with row
    also one over all files in the order of their paths, after the `before` first; with path the file.

    A task reads a split from its start, so a row's number is its place in its split and the rows of the splits before, which a
    prefix sum over one row for each split (for each file, over all files) gives: nothing is sorted. Rows are written first,
    as another scan might be split otherwise. Rows are numbered as they are read: filter them afterwards, read each file once.
    Names that df has already are refused."""
    names = [n for n in df.columns if n not in (FILE, START)]
    made = [n for n in (line, row, path) if n]
    clash = [n for n in made if n.lower() in {m.lower() for m in names}]
    if clash or len(set(made)) < len(made):
        raise ValueError(f"columns {clash or made} are there already: give other names")
    placed = df if FILE in df.columns else read_from(df)
    held = written(placed.withColumn(PLACE, F.monotonically_increasing_id()), "numbered")
    splits = held.groupBy(FILE, START).agg(F.min(PLACE).alias("first"), F.count("*").alias("rows"))
    earlier = lambda w: F.coalesce(F.sum("rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.withColumn("in_file", earlier(Window.partitionBy(FILE).orderBy(START)))
    if row:
        files = splits.groupBy(FILE).agg(F.sum("rows").alias("rows"))
        splits = splits.join(files.select(FILE, earlier(Window.orderBy(FILE)).alias("in_all")), FILE)
    splits = written(splits, "splits")
    size = splits.agg(F.sum(F.octet_length(FILE) + 32)).first()[0] or 0
    rows = held.join(F.broadcast(splits) if size <= BROADCAST_BYTES else splits, [FILE, START])
    number = F.col(PLACE) - F.col("first") + F.col("in_file") + 1
    out = [F.col(f"`{n}`") for n in names] + [number.alias(line)]
    out += [(number + F.col("in_all") + before).alias(row)] if row else []
    return rows.select(*out, *([F.col(FILE).alias(path)] if path else []))


def lines(spark: SparkSession, path: str, column: str = "value", line: str = "line", row: str | None = None, file: str | None = None) -> DataFrame:
    """Lines of text files with their numbers (see numbered)."""
    return numbered(spark.read.text(path).withColumnRenamed("value", column), line, row, file)


def csv_lines(spark: SparkSession, path: str, t: object, header: bool = True, line: str = "line", row: str | None = None, file: str | None = None, **options: str) -> DataFrame:
    """`csv`, with the number of the line that each row stands in. A row is a line: quoted texts hold no line ends. Blank lines
    count but give no row; with header, each file's first line is one and gives no row either."""
    fields = text_schema(t)
    clash = [n for n in (line, row, file) if n in fields.names]
    if clash:
        raise ValueError(f"columns {clash} are there already: give other names")
    # Parsed before the rows are written, so once for each line, whatever is asked of the fields later.
    parsed = F.from_csv("value", ", ".join(f"`{f.name}` STRING" for f in fields), options)
    read = read_from(spark.read.text(path)).select(parsed.alias("__row"), (F.trim("value") != "").alias("__given"), FILE, START)
    found = numbered(read.select(*(F.col(f"__row.`{n}`") for n in fields.names), "__given", FILE, START), line, row, file)
    return found.where(F.col("__given") & ((F.col(f"`{line}`") > 1) if header else F.lit(True))).drop("__given")


def from_json(df: DataFrame, column: str) -> DataFrame:
    """A text column as VARIANT, in which an absent key and an explicit null differ."""
    return df.withColumn(column, F.try_parse_json(F.col(f"`{column}`")))


def to_json(df: DataFrame, t: object, column: str = "json") -> DataFrame:
    """What an encoder makes of each row, as one JSON text; rows that it rejects are null."""
    low = prepared(df, t)
    return low.df.select(F.when(low.out.ok, F.to_json(low.out.value)).alias(column))


def environment(df: DataFrame, prefix: str, column: str = "env") -> DataFrame:
    """A configuration map's entries whose names have a prefix, under the rest of the name in lower case."""
    own = F.map_filter(F.col(column), lambda k, v: k.startswith(prefix))
    return df.withColumn(column, F.transform_keys(own, lambda k, v: F.lower(F.substring(k, F.lit(len(prefix) + 1), F.length(k)))))


def downloaded(df: DataFrame, fetch: Callable[[str], bytes], column: str = "url", into: str = "body") -> DataFrame:
    """User code that fetches, on the executors and a batch at a time; a failure is null. Rows keep their columns."""
    schema = df.withColumn(into, F.lit(None).cast("binary")).schema

    def one(url: str) -> bytes | None:
        try:
            return fetch(url)
        except OSError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column(into, pa.array([None if u is None else one(u) for u in b[column].to_pylist()], pa.binary()))

    return df.mapInArrow(run, schema)


def write_split(df: DataFrame, t: object, good: str, bad: str, mode: str = "append") -> None:
    """Valid rows as Parquet in one folder, the others with their errors as JSON in another."""
    filtered(df, t).write.mode(mode).parquet(good)
    invalid(df, t).write.mode(mode).json(bad)
