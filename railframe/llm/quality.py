"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

A text is cut into blocks, and every block is compressed with a dictionary built from good labelled text and with one
built from bad; the difference of the two sizes over their sum tells which kind of text the document resembles. That, and
how far the text compresses with neither, go into a logistic calibration fitted on labelled documents that the
dictionaries have not seen. The model is fitted on the driver from a bounded sample of labelled rows (PER_CLASS documents
of each label, of at most MAX_CHARS characters); scores read whole texts.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: The sample that a model is fitted on: documents of each label, and the longest that is taken.
PER_CLASS, MAX_CHARS = 2000, 16_384
DICTIONARY_BYTES, BLOCK_BYTES, LEVEL = 112_640, 1024, 3
#: Blocks that a dictionary is trained on at most, chosen by a fixed shuffle of those of its documents.
DICTIONARY_BLOCKS = 8000


@dataclass(frozen=True)
class Model:
    """Dictionaries (None: too little text), and the calibration: weights of a constant and four terms, with their means and spreads."""

    good: bytes | None
    bad: bytes | None
    weights: tuple[float, ...]
    mean: tuple[float, ...] = (0.0,) * 4
    spread: tuple[float, ...] = (1.0,) * 4


def blocks(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]


@functools.lru_cache(maxsize=8)
def compressor(dictionary: bytes | None) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)


def features(text: str | None, good: bytes | None, bad: bytes | None) -> tuple[float, float, float, float]:
    """Normalised size difference (above 0: nearer to good text), compressed share of the whole text, and both squared; zeros for an empty text."""
    if not text:
        return (0.0,) * 4
    parts = blocks(text)
    with_good, with_bad = (sum(len(c.compress(p)) for p in parts) for c in (compressor(good), compressor(bad)))
    difference = (with_bad - with_good) / (with_bad + with_good)
    raw = text.encode("utf-8", "surrogatepass")
    share = min(1.5, len(compressor(None).compress(raw)) / len(raw))
    return difference, share, difference * difference, share * share


def trained(samples: list[bytes]) -> bytes | None:
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return None  # too little text for a dictionary


def calibrated(x: np.ndarray, y: np.ndarray, steps: int = 100, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression with a constant first: Newton steps, halved until the penalised loss falls. The ridge (not on the
    constant) keeps the weights finite where the labels can be told apart without error."""
    x = np.column_stack([np.ones(len(x)), x])
    penalty = ridge * (np.arange(x.shape[1]) > 0)
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + (penalty * w * w).sum() / 2)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from the fit: crc32 of the id as text leaves 1 by 3. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Learn from labelled documents outside the held-out third. Null labels, ids and texts take no part; of several labels
    of a document the largest counts, of several texts the least. With no document of one of the labels every score is the share of label 1, smoothed."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    count = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    slots = 1 << 20
    cut = F.lit(0)
    for y, n in count.items():
        cut = F.when(F.col("y") == y, F.lit(int(min(1.0, per_class / n) * slots))).otherwise(cut)
    # At most a few thousand ids at any size of the tables, the first by hash, so the join is a broadcast and no text is shuffled.
    place = F.pmod(F.xxhash64("doc_id"), F.lit(slots))
    chosen = known.where(place < cut).orderBy(place, "doc_id").limit(4 * per_class)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where((F.length("text") > 0) & (F.length("text") <= MAX_CHARS))
    # Of texts that share an id the least counts.
    rows = sorted((r["doc_id"], r["y"], r["text"]) for r in text.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect())
    random.Random(0).shuffle(rows)
    half = {}
    dictionaries: dict[int, bytes | None] = {}
    for y in (0, 1):
        own = [t for _, v, t in rows if v == y]
        half[y] = len(own) // 2
        samples = [p for t in own[: half[y]] for p in blocks(t)]
        random.Random(1).shuffle(samples)
        dictionaries[y] = trained(samples[:DICTIONARY_BLOCKS])
    good, bad = dictionaries[1], dictionaries[0]
    held = [(t, y) for y in (0, 1) for t in [t for _, v, t in rows if v == y][half[y] :]]
    base = (count.get(1, 0) + 1) / (sum(count.values()) + 2)
    y = np.array([v for _, v in held], np.float64)
    if len(set(y.tolist())) < 2:
        return Model(None, None, (float(np.log(base / (1 - base))),) + (0.0,) * 4)
    x = np.array([features(t, good, bad) for t, _ in held])
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread == 0] = 1.0
    w = calibrated((x - mean) / spread, y)
    # The sample has another share of each label than the labelled rows: move the constant by the difference.
    w[0] += np.log(base / (1 - base)) - np.log(y.mean() / (1 - y.mean()))
    return Model(good, bad, tuple(map(float, w)), tuple(map(float, mean)), tuple(map(float, spread)))


def scores(texts: list[str | None], model: Model) -> np.ndarray:
    x = np.array([features(t, model.good, model.bad) for t in texts]).reshape(-1, 4)
    z = model.weights[0] + ((x - np.array(model.mean)) / np.array(model.spread)) @ np.array(model.weights[1:])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """Adds the probability of label 1 of every whole text; a null text counts as empty, which gets a score too. A column
    that is already named as the result is replaced."""
    prepare(docs.sparkSession)
    schema = docs.drop(into).withColumn(into, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [n for n in b.schema.names if n != into]
            yield b.select(keep).append_column(into, pa.array(scores(b[text].to_pylist(), model), pa.float64()))

    return docs.mapInArrow(run, schema)
