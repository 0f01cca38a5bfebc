"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the k smallest distinct 48-bit hashes of a text's shingles, so sketches of parts merge into the sketch
of the whole, and two sketches estimate resemblance, containment and the number of distinct shingles. With fewer than k
shingles the sketch holds them all and every estimate is exact. As text it is the base64 form of the ascending hashes,
six bytes each, big-endian.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, bounds, bucket, out_batch, partitions, prepare, shingles

#: Hashes that a sketch keeps: the standard error of a resemblance is at most 0.5 / sqrt(K), about 0.044.
K = 128
_SPACE = float(1 << 48)


def sketch(text: str | None, k: int = K) -> np.ndarray:
    """The k smallest distinct shingle hashes, ascending; empty for a null text and one without words."""
    return smallest(shingles(text) >> np.uint64(16), k)


def smallest(h: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distinct values of an ascending array."""
    return np.unique(h[:k]) if len(h) <= k or len(np.unique(h[:k])) == k else np.unique(h)[:k]


def merged(sketches: Iterable[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of the union of the texts (shingles across a seam are not among them)."""
    every = list(sketches)
    return np.unique(np.concatenate(every))[:k] if every else np.empty(0, np.uint64)


def shown(s: np.ndarray) -> str:
    return base64.b64encode(s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def parsed(text: str | None) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text or ""), np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(raw), 2), np.uint8), raw], axis=1).copy().view(">u8").ravel().astype(np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of common shingles in all shingles; 1 for two empty sketches, 0 for one."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.unique(np.concatenate([a, b]))[:k]
    both = np.intersect1d(a, b, assume_unique=True)
    return int(np.isin(union, both, assume_unique=True).sum()) / len(union)


def distinct_shingles(s: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(s)) if len(s) < k else (k - 1) * _SPACE / (float(s[k - 1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too; 1 if a is empty."""
    if not len(a):
        return 1.0
    union = distinct_shingles(merged([a, b], k), k)
    return min(1.0, resemblance(a, b, k) * union / max(1.0, distinct_shingles(a, k)))


def fingerprint(docs: DataFrame, text: str = "text", into: str = "fingerprint", k: int = K) -> DataFrame:
    """Adds the sketch of each whole text as a string column; null and empty texts have the empty string."""
    prepare(docs.sparkSession)
    schema = docs.drop(into).withColumn(into, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [n for n in b.schema.names if n != into]
            yield b.select(keep).append_column(into, pa.array([shown(sketch(t, k)) for t in b[text].to_pylist()], pa.string()))

    return docs.mapInArrow(run, schema)


def merge_fingerprints(df: DataFrame, by: str, fp: str = "fingerprint", k: int = K) -> DataFrame:
    """The sketch of all rows of each value of `by` (a group may hold any share of the rows): by, fingerprint.

    Each task first merges what it has of a group into one sketch, so a group gathers a sketch for each task at most.
    """
    key = df.schema[by].dataType.simpleString()
    ddl = f"`{by}` {key}, fingerprint string"
    out = arrow_schema(ddl)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            for g, s in zip(b[by].to_pylist(), b[fp].to_pylist()):
                held.setdefault(g, []).append(parsed(s))
                if len(held[g]) >= 64:
                    held[g] = [merged(held[g], k)]
            if len(held) > 50_000:
                yield out_batch(out, [list(held), [shown(merged(v, k)) for v in held.values()]])
                held = {}
        yield out_batch(out, [list(held), [shown(merged(v, k)) for v in held.values()]])

    def whole(t: pa.Table) -> pa.Table:
        return pa.table([t[by].slice(0, 1), pa.array([shown(merged(map(parsed, t["fingerprint"].to_pylist()), k))])], schema=out)

    # What is dealt by the group is one row for each group and task, or for each 50,000 groups of a task.
    return df.select(by, fp).mapInArrow(some, ddl).groupBy(by).applyInArrow(whole, ddl)


NEAR = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def against_next(docs: DataFrame, k: int = K) -> DataFrame:
    """Every document beside the next one in descending order of doc_id (after the last: the first).

    The edited text has the last third (floor) of the code points replaced by the first as many of the next document.
    Texts cross the network once: rows are dealt by ranges of doc_id, and each range also gets the first document of the
    next lower range (of the highest, for the lowest). Null texts are empty; a null id is the lowest; rows that share an
    id stand in a fixed order; a sole document is its own next; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = bounds(docs, "doc_id", partitions(spark))
    low = -(1 << 63)

    dealt_as = "bucket int, guest boolean, key long, doc_id long, body binary"
    dealt_out, out = arrow_schema(dealt_as), arrow_schema(NEAR)
    tops_as = "bucket int, key long"
    tops_out = arrow_schema(tops_as)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, int] = {}
        for b in batches:
            keys = b["doc_id"].fill_null(low).to_numpy()
            for p, key in zip(bucket(keys, cuts).tolist(), keys.tolist()):
                best[p] = max(best.get(p, low), key)
        yield out_batch(tops_out, [list(best), list(best.values())])

    # The highest id of each range: as many rows as ranges.
    found = sorted((r["bucket"], r["key"]) for r in docs.select("doc_id").mapInArrow(tops, tops_as).groupBy("bucket").agg(F.max("key").alias("key")).collect())
    # id of a range's first document -> the range that it follows.
    guests = {key: found[(i + 1) % len(found)][0] for i, (_, key) in enumerate(found)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            keys = b["doc_id"].fill_null(low).to_numpy()
            bodies = [press.compress((t or "").encode("utf-8", "surrogatepass")) for t in b["text"].to_pylist()]
            rows = [(p, False, key, doc, body) for p, key, doc, body in zip(bucket(keys, cuts).tolist(), keys.tolist(), b["doc_id"].to_pylist(), bodies)]
            rows += [(guests[r[2]], True, *r[2:]) for r in rows if r[2] in guests]
            yield out_batch(dealt_out, list(zip(*rows)) or [[]] * 5)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inflate = zstandard.ZstdDecompressor()
        before, done = None, False
        for b in batches:
            rows = []
            for guest, doc, body in zip(*(b[c].to_pylist() for c in ("guest", "doc_id", "body"))):
                if done:
                    break
                text = inflate.decompress(body).decode("utf-8", "surrogatepass") if body else ""
                here = (doc, text, sketch(text, k))
                if before is not None:
                    own, whole, mine = before
                    third = len(whole) // 3
                    edited = whole[: len(whole) - third] + text[:third]
                    after = sketch(edited, k)
                    rows.append((own, len(whole), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), shown(mine), shown(after), resemblance(mine, after, k), resemblance(mine, here[2], k)))
                before, done = here, guest
            yield out_batch(out, list(zip(*rows)) or [[]] * len(out))

    dealt = docs.mapInArrow(deal, dealt_as).repartitionById(len(cuts) + 1, "bucket")
    return dealt.sortWithinPartitions("guest", F.col("key").desc(), "body").mapInArrow(compare, NEAR)
