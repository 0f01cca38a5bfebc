"""Helpers that the text operators share: the shared scratch folder, word shingles and range buckets."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows and bytes in an Arrow batch: texts may be long, so batches hold few rows, and fewer of very long ones.
BATCH_ROWS, BATCH_BYTES = 256, 32 << 20

#: Words in a shingle.
WORDS = 5

_CACHED_DIR: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small. Spark reads the setting when a query runs, so it stays with the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share. Where that is unset, below a new local folder,
    but only if everything runs on this machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        top = _CACHED_DIR.setdefault(app, tempfile.mkdtemp(prefix="spark-"))
    return f"{top.rstrip('/')}/railframe-{uuid.uuid4().hex}/{name}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the scratch folder and read it again: cuts the lineage, and outlives executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Copies of the small side of a salted join.
SALTS = 16


def salted(big: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """big joined with small, whose keys are unique: rows of a key that fills any share of big are dealt to SALTS tasks by the
    partition that they come from, and small is copied to each."""
    spread = big.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return spread.join(copies, [key, "__salt"], how).drop("__salt")


#: Rows of small that a broadcast may hold; rows of a key that one task takes; keys that may be split.
BROADCAST_ROWS, HOT_ROWS, HOT_KEYS = 500_000, 200_000, 5_000


def split_join(big: DataFrame, small: DataFrame, key: str, counts: DataFrame, how: str = "inner", rows: int | None = None) -> DataFrame:
    """big joined with small (inner or left), where a key may hold any share of big's rows.

    counts: key and n, at least as many as big has rows of the key; a saved table. Keys with more than `rows` (HOT_ROWS) are dealt to as many
    tasks as they fill, by a hash of the row, so that a lost task is dealt alike again; only their rows of small are copied,
    at most once for each `rows` rows of big. The limit grows with big, so that never more than HOT_KEYS keys are split and broadcast."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(HOT_ROWS if rows is None else rows, math.ceil(total / HOT_KEYS))
    hot = counts.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("__parts"))
    if hot.isEmpty():
        return big.join(small, key, how)
    hot = F.broadcast(hot)
    parts = F.coalesce("__parts", F.lit(1))
    spread = big.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(*big.columns), parts).cast("int")).drop("__parts")
    copies = small.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return spread.join(copies, [key, "__salt"], how).drop("__salt")


def keyed_join(big: DataFrame, small: DataFrame, key: str, counts: DataFrame, how: str = "inner") -> DataFrame:
    """split_join, or a broadcast of a small that has at most BROADCAST_ROWS rows; for small of a few numbers a row, saved."""
    return big.join(F.broadcast(small), key, how) if small.count() <= BROADCAST_ROWS else split_join(big, small, key, counts, how)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 ascending values that part the rows of df by an integer key into about equal ranges."""
    if n < 2:
        return []
    cuts = [i / n for i in range(1, n)]
    found = df.agg(F.percentile_approx(F.col(key).cast("long"), cuts, 20 * n).alias("cuts")).first()["cuts"]
    return sorted(set(found or []))


def bucket(keys: np.ndarray, cuts: list[int]) -> np.ndarray:
    """The number of each key's range; a key equal to a cut belongs below it."""
    return np.searchsorted(np.asarray(cuts, dtype=np.int64), keys, side="left").astype(np.int32)


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def out_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """A batch of the given columns, in the order of the schema."""
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def ranged(df: DataFrame, group: str, order: list[str], rows: int, per: int, name: str) -> DataFrame:
    """df (of `rows` rows) sorted by group and order and dealt into ranges of about `per` rows, with `part`, the number of the
    range, and `place` among the group's rows in the range. A group of any size is spread over as many ranges as it fills.

    Rows that are equal in all of `order` are alike and may stand either way; tie spreads them over ranges."""
    dealt = df.withColumn("tie", F.monotonically_increasing_id())
    count = max(1, min(partitions(df.sparkSession), math.ceil(rows / 1000)), math.ceil(rows / per))
    keys = [group, *order, "tie"]
    schema = ", ".join(f"{c} {k}" for c, k in df.dtypes) + ", place long"
    out = arrow_schema(schema)
    names = df.columns
    at = names.index(group)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = object(), 0
        for b in batches:
            columns = [b[c] for c in names]
            places = []
            for g in columns[at].to_pylist():
                n = n + 1 if g == last else 0
                last = g
                places.append(n)
            yield out_batch(out, [*columns, places])

    in_order = saved(dealt, f"{name}_dealt").repartitionByRange(count, *keys).sortWithinPartitions(*keys).mapInArrow(numbered, schema)
    return saved(in_order.withColumn("part", F.spark_partition_id()), name)


_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words(text: str | None) -> list[bytes]:
    """Maximal runs of other characters than space and tab to carriage return, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; with fewer words, of the whole sequence; without words, none."""
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), seed=len(found))], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    n = len(h) - WORDS + 1
    s = h[:n] * _MULT[0]
    for i in range(1, WORDS):
        s = s + h[i : i + n] * _MULT[i]
    return np.unique(mix(s))
