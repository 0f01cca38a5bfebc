"""Hard negatives: for each anchor and positive, the best rows of other labels whose score lies just below the positive's.

Anchors and candidates are dealt into blocks, and each pair of blocks meets in one task, twice. There a Strassen product of
the two int64 tiles, padded with zeros, gives all scores. The first meeting keeps a list of the best positives for each
anchor, and heaps merge the lists of an anchor; the second knows the positives, and keeps a list of the best rows in each
positive's window, which heaps merge likewise. Scores are integers and exact: if a bound over the whole table shows that a
score may not fit 64 bits, the tiles hold Python's integers instead.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, out_batch, partitions, saved

#: Each candidate is copied once for each block of anchors, each anchor once for each block of candidates.
ANCHOR_BLOCK, CANDIDATE_BLOCK = 2048, 4096
#: A product with a side of at most so many rows or columns is not divided further.
LEAF = 32
#: 64-bit products below this are exact in doubles, whose matrix product is the faster one.
EXACT_DOUBLE = 1 << 53


def padded(x: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """x with zeros below and to the right."""
    if x.shape == (rows, columns):
        return x
    out = np.zeros((rows, columns), x.dtype)
    out[: x.shape[0], : x.shape[1]] = x
    return out


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matrix product of two integer tiles by Strassen's seven half-size products.

    Sums and products are of integers. In int64 they may wrap around on the way; as they do so modulo 2**64, the result is
    right wherever it fits."""
    (n, k), m = a.shape, b.shape[1]
    if min(n, k, m) <= LEAF:
        return leaf(a, b)
    n2, k2, m2 = (n + 1) // 2, (k + 1) // 2, (m + 1) // 2
    a, b = padded(a, 2 * n2, 2 * k2), padded(b, 2 * k2, 2 * m2)
    a11, a12, a21, a22 = a[:n2, :k2], a[:n2, k2:], a[n2:, :k2], a[n2:, k2:]
    b11, b12, b21, b22 = b[:k2, :m2], b[:k2, m2:], b[k2:, :m2], b[k2:, m2:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * n2, 2 * m2), a.dtype)
    out[:n2, :m2] = p1 + p4 - p5 + p7
    out[:n2, m2:] = p3 + p5
    out[n2:, :m2] = p2 + p4
    out[n2:, m2:] = p1 - p2 + p3 + p6
    return out[:n, :m]


def leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not a.size or not b.size:
        return np.zeros((a.shape[0], b.shape[1]), a.dtype)
    if a.dtype == np.int64:
        top = max(abs(int(a.max())), abs(int(a.min()))) * max(abs(int(b.max())), abs(int(b.min()))) * a.shape[1]
        if top < EXACT_DOUBLE:
            return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores, best first, ties to smaller ids; ids ascend."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        left = np.flatnonzero(scores >= kth)
        return left[np.argsort(-scores[left], kind="stable")[:k]]
    return np.argsort(-scores, kind="stable")


def windowed(ids: np.ndarray, scores: np.ndarray, positive: int, low: int, k: int) -> np.ndarray:
    """The places of the first k rows, best first, with low * positive <= 100 * score <= 100 * positive."""
    inside = np.flatnonzero((scores <= positive) & (scores >= -(-low * positive // 100)))
    return inside[best(ids[inside], scores[inside], k)]


def hard_negatives(
    vectors: DataFrame,
    every: int = 100,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    scale: int = 256,
    label: Column | str = "label",
    id_col: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every anchor (rows whose id is divisible
    by `every`), its first `positives` rows of the same label and for each of these the first `negatives` rows of other labels with
    low % of the positive's score or more, but no more than that score. Scores are inner products of floor(scale * x).

    Null ids, null labels, null vectors and those with null or non-finite components take no part; vectors of another length
    never meet, those of length 0 have the score 0. A row never meets rows with its own id. Anchors that repeat an id with
    equal label and vector are one; otherwise each has its own lists, and the rows of both are returned. Other rows that
    repeat an id count each. An anchor with fewer positives or negatives gets them all; a positive without negatives gives
    no row. Scores are compared exactly at any size; one that does not fit 64 bits is returned as null.
    """
    spark = vectors.sparkSession
    v = F.col(f"`{vector}`").cast("array<double>")
    made = label if isinstance(label, Column) else F.col(f"`{label}`")
    good = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), made.cast("long").alias("label"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    )
    size = good.agg(F.count("*").alias("c"), F.count_if(F.col("id") % every == 0).alias("a"), F.max(F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0))).alias("top"), F.max(F.size("v")).alias("dim")).first()
    a_blocks, c_blocks = max(1, math.ceil(size["a"] / ANCHOR_BLOCK)), max(1, math.ceil(size["c"] / CANDIDATE_BLOCK))
    top = math.inf if (size["top"] or 0.0) * scale == math.inf else math.ceil((size["top"] or 0.0) * scale) + 1
    wide = top * top * (size["dim"] or 0) >= 1 << 62
    kind = "string" if wide else "long"

    def matrix(t: pa.Table) -> np.ndarray:
        flat = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        dim = len(flat) // t.num_rows
        if not wide:
            return np.floor(flat * scale).astype(np.int64).reshape(t.num_rows, dim)
        exact = [n * scale // d for n, d in map(float.as_integer_ratio, flat.tolist())]
        return np.array(exact, dtype=object).reshape(t.num_rows, dim)

    def told(scores: np.ndarray) -> list:
        return [str(s) for s in scores] if wide else scores

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        """Each row in its own block, once for each block of the other side."""
        return df.withColumn("dim", F.size("v")).withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    keys = ["dim", "ab", "cb"]
    candidates = dealt(good, "cb", c_blocks, "ab", a_blocks).groupBy(*keys)

    def met(anchors: DataFrame, lists: str, rows: Callable[[dict, np.ndarray, np.ndarray, np.ndarray], list[tuple]]) -> DataFrame:
        """What rows(anchor, ids, labels, scores) gives for each anchor and block of candidates, without the anchor's own id."""
        schema = arrow_schema(lists)

        def meet(a: pa.Table, c: pa.Table) -> pa.Table:
            if not a.num_rows or not c.num_rows:
                return schema.empty_table()
            c = c.sort_by("id")
            ids, labels = c["id"].to_numpy(), c["label"].to_numpy()
            scores = strassen(matrix(a), np.ascontiguousarray(matrix(c).T))
            found = []
            for i, anchor in enumerate(a.drop_columns(["v"]).to_pylist()):
                others = np.flatnonzero(ids != anchor["id"])
                found += rows(anchor, ids[others], labels[others], scores[i][others])
            return pa.Table.from_batches([out_batch(schema, list(zip(*found)))]) if found else schema.empty_table()

        return dealt(anchors, "ab", a_blocks, "cb", c_blocks).groupBy(*keys).cogroup(candidates).applyInArrow(meet, lists)

    def merged(tiles: DataFrame, by: list[str], ranked: str, k: int) -> DataFrame:
        """The first k of the lists of each key, merged by a heap."""
        schema, order = arrow_schema(ranked), ["anchor", "key", *by]

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = ((tuple(r[c] for c in order), [(-int(s), i) for i, s in zip(r["ids"], r["scores"])]) for b in batches for r in b.to_pylist())
            lines = ((*own, n, i, str(-s) if wide else -s) for own, some in groupby(rows, key=lambda r: r[0]) for n, (s, i) in enumerate(islice(heapq.merge(*(x for _, x in some)), k), 1))
            while some := list(islice(lines, 20_000)):
                yield out_batch(schema, list(zip(*some)))

        return tiles.repartition(partitions(spark), "anchor", "key").sortWithinPartitions(*order).mapInArrow(merge, ranked)

    def best_positives(anchor: dict, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> list[tuple]:
        same = np.flatnonzero(labels == anchor["label"])
        first = same[best(ids[same], scores[same], positives)]
        return [(anchor["id"], anchor["key"], ids[first], told(scores[first]))] if len(first) else []

    def best_negatives(anchor: dict, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> list[tuple]:
        other = np.flatnonzero(labels != anchor["label"])
        ids, scores, found = ids[other], scores[other], []
        for place, positive, score in zip(anchor["places"], anchor["positives"], anchor["scores"]):
            first = windowed(ids, scores, int(score), low, negatives)
            if len(first):
                found.append((anchor["id"], anchor["key"], place, positive, score, ids[first], told(scores[first])))
        return found

    anchors = good.where(F.col("id") % every == 0).dropDuplicates(["id", "label", "v"]).withColumn("key", F.xxhash64("label", "v"))
    tiles = met(anchors, f"anchor long, key long, ids array<long>, scores array<{kind}>", best_positives)
    # Written, so that the second meeting does not repeat the first, and an executor that is lost does not either.
    known = saved(merged(tiles, [], f"anchor long, key long, place int, positive long, score {kind}", positives), "positives")
    each = known.groupBy("anchor", "key").agg(F.sort_array(F.collect_list(F.struct("place", "positive", "score"))).alias("p"))
    with_positives = anchors.join(each, (F.col("id") == F.col("anchor")) & (anchors["key"] == each["key"])).select(
        *(F.col(c).alias(c) for c in ("id", "label", "v")), anchors["key"], F.col("p.place").alias("places"), F.col("p.positive").alias("positives"), F.col("p.score").alias("scores")
    )
    windows = met(with_positives, f"anchor long, key long, place int, positive long, score {kind}, ids array<long>, scores array<{kind}>", best_negatives)
    ranked = merged(windows, ["place", "positive", "score"], f"anchor long, key long, place int, positive long, score {kind}, rank int, negative long, found {kind}", negatives)
    fits = lambda c: F.col(c).try_cast("long")
    return ranked.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("negative").alias("negative_id"), fits("score").alias("positive_score"), fits("found").alias("negative_score"))
