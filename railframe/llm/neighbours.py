"""Nearest neighbours by inner product: a block matrix join on int8 tiles.

Queries and candidates are dealt into blocks, and each pair of blocks meets in one task. There an int8 product of the two
tiles gives every inner product within a proven error; a candidate whose upper bound is below the query's limit (the
k-th largest lower bound) is left out, the others are recomputed in double precision from the original vectors. A tile
returns one list of at most k for each query, and heaps merge the lists. The result is exact.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, out_batch, partitions

#: Each candidate is copied once for each block of queries.
QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 8192
#: Queries that meet a candidate block at once, and rows of the block that are multiplied at once.
ROWS, STRIP = 512, 2048


def lengths(x: np.ndarray) -> np.ndarray:
    """Lengths of the rows; they are scaled by their largest component first, so that no square overflows or vanishes."""
    top = np.abs(x).max(axis=1, initial=0.0)
    top[top == 0] = 1.0
    return top * np.sqrt(((x / top[:, None]) ** 2).sum(axis=1))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and the length of what rounding took from each row."""
    scale = np.abs(x).max(axis=1, initial=0.0) / 127.0
    scale[scale == 0] = 1.0
    scale = np.maximum(scale, np.finfo(np.float64).tiny)
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, lengths(x - q * scale[:, None]) * (1 + 1e-9)


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x with y, summed in the order of the components."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j] * y[j]
    return total


def tile(all_ids: np.ndarray, all_queries: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and scores of its k best candidates of this tile, best first, ties to smaller ids."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    # Of equal vectors only the k + 1 with the smallest ids can be among the k best of any query (itself left out).
    _, same = np.unique(c, axis=0, return_inverse=True)
    by = np.argsort(same.ravel(), kind="stable")
    runs = same.ravel()[by]
    rank = np.arange(len(by)) - np.searchsorted(runs, runs)
    keep = np.sort(by[rank <= k])
    c_ids, c = c_ids[keep], c[keep]
    block = (c_ids, c, *quantised(c), lengths(c))
    return [x for at in range(0, len(all_ids), ROWS) for x in strip(all_ids[at : at + ROWS], all_queries[at : at + ROWS], block, k)]


def strip(q_ids: np.ndarray, q: np.ndarray, block: tuple[np.ndarray, ...], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """tile for some of its queries."""
    c_ids, c, cq, cs, cl, c_len = block
    qq, qs, ql = quantised(q)
    q_len = lengths(q)
    # An int8 product is exact in single precision up to 1040 components, in double precision for any.
    kind = np.float32 if q.shape[1] <= 1040 else np.float64
    near = np.empty((len(q), len(c)))
    for at in range(0, len(c), STRIP):
        near[:, at : at + STRIP] = qq.astype(kind) @ cq[at : at + STRIP].astype(kind).T
    near *= qs[:, None] * cs
    slack = ql[:, None] * (c_len + cl) + q_len[:, None] * cl + 1e-12 * q_len[:, None] * c_len
    found = []
    for i in range(len(q)):
        own = c_ids == q_ids[i]
        with np.errstate(invalid="ignore"):
            low, high = near[i] - slack[i], near[i] + slack[i]
        # Bounds that overflow tell nothing: they set no limit, and what has one is not left out.
        low = np.where(own | np.isnan(low), -np.inf, low)
        if len(low) > k:
            limit = np.partition(low, len(low) - k)[len(low) - k]
            left = np.flatnonzero(~own & ~(high < limit))
        else:
            left = np.flatnonzero(~own)
        scores = exact(c[left], q[i])
        best = np.lexsort((c_ids[left], -scores))[:k]
        found.append((c_ids[left][best], scores[best]))
    return found


def search(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", keyed: bool = False) -> DataFrame:
    """The k nearest of every query (rows whose id is divisible by `every`): query_id, rank, vec_id, score, and query_key if keyed.

    Null ids and vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of another
    length than the query's are no candidates. A query with fewer candidates gets them all; without any it has no rows.
    Rows that repeat an id are candidates each; a query never meets rows with its own id. Queries that repeat an id and the
    vector are one; with other vectors each has its own list, told apart by query_key, a hash of the vector.
    """
    spark = vectors.sparkSession
    v = F.col(vector).cast("array<double>")
    good = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    queries = good.where(F.col("id") % every == 0)
    size = good.agg(F.count("*").alias("c"), F.count_if(F.col("id") % every == 0).alias("q")).first()
    q_blocks, c_blocks = max(1, math.ceil(size["q"] / QUERY_BLOCK)), max(1, math.ceil(size["c"] / CANDIDATE_BLOCK))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        """Each row in its own block, once for each block of the other side."""
        return df.withColumn("dim", F.size("v")).withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    lists = "query_id long, query_key long, ids array<long>, scores array<double>"
    lists_out = arrow_schema(lists)

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        flat = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return t["id"].to_numpy(), flat.reshape(t.num_rows, -1)

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return lists_out.empty_table()
        (q_ids, qv), (c_ids, cv) = matrix(q), matrix(c)
        found = tile(q_ids, qv, c_ids, cv, k)
        return pa.Table.from_batches([out_batch(lists_out, [q_ids, q["key"].to_numpy(), [x[0] for x in found], [x[1] for x in found]])])

    keys = ["dim", "qb", "cb"]
    tiles = dealt(queries.dropDuplicates(["id", "v"]).withColumn("key", F.xxhash64("v")), "qb", q_blocks, "cb", c_blocks).groupBy(*keys).cogroup(dealt(good, "cb", c_blocks, "qb", q_blocks).groupBy(*keys)).applyInArrow(meet, lists)
    ranked = "query_id long, rank int, vec_id long, score double, query_key long"
    ranked_out = arrow_schema(ranked)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (((q, key), [(-s, i) for i, s in zip(ids, scores)]) for b in batches for q, key, ids, scores in zip(*(b[c].to_pylist() for c in ("query_id", "query_key", "ids", "scores"))))
        lines = ((q, n, i, -s, key) for (q, key), own in groupby(rows, key=lambda r: r[0]) for n, (s, i) in enumerate(islice(heapq.merge(*(x for _, x in own)), k), 1))
        while some := list(islice(lines, 20_000)):
            yield out_batch(ranked_out, list(zip(*some)))

    found = tiles.repartition(partitions(spark), "query_id", "query_key").sortWithinPartitions("query_id", "query_key").mapInArrow(merge, ranked)
    return found if keyed else found.drop("query_key")
