"""Vector best-fit packing of token pieces into sequences.

Documents are tokenised where they lie and cut into pieces no longer than a sequence; only narrow rows (document, piece,
length) are shuffled, into groups of a bounded number of tokens that are packed independently. In a group, pieces go
from large to small into the open sequence that fits best: every sequence has a vector of residual capacities (tokens,
documents, attention cost) and must hold the piece under each of them; among those the rule picks the largest weighted
dot product of size and residual, or the smallest weighted norm of what would remain. Tokens weigh most, so that few
sequences are made; among those that fit about alike, the residual documents and attention cost choose. A group leaves at
most a few sequences partly filled, a share that falls with its size.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, out_batch, prepare, saved
from .encoding import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most. Attention cost of a piece: the square of its length."""

    tokens: int = 2048
    documents: int = 128
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.5, 0.2)
    rule: str = "norm"

    def __post_init__(self) -> None:
        if self.rule not in ("norm", "dot"):
            raise ValueError("rule is 'norm' or 'dot'")
        if min(self.tokens, self.documents) < 1 or self.attention < self.tokens**2:
            raise ValueError("a sequence must hold a piece of full length under every capacity")


def cut(docs: DataFrame, tokenizer: str, tokens: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of every document: the ids of its whole text and then end_id, cut only if longer than `tokens`.

    A null text is empty: its one piece is end_id alone. Null and repeated ids are kept as they are.
    """
    prepare(docs.sparkSession)

    out = arrow_schema(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), int(end_id).to_bytes(4, "little")
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                ids = enc.encode(text) + end
                for i in range(0, len(ids), 4 * tokens):
                    part = ids[i : i + 4 * tokens]
                    rows.append((doc, i // (4 * tokens), i // 4, len(part) // 4, zlib.crc32(part)))
            yield out_batch(out, list(zip(*rows)) or [[]] * len(out))

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(run, PIECES)


def fill(lengths: np.ndarray, cap: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset in it of each piece; a piece is at most cap.tokens long."""
    n = len(lengths)
    seq, offset = np.empty(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    caps = np.array([cap.tokens, cap.documents, cap.attention], np.float64)
    weights = np.asarray(cap.weights)
    whole = int(np.searchsorted(-lengths[order], -cap.tokens, side="right"))
    seq[order[:whole]] = np.arange(whole)
    rest = order[whole:]
    left = np.empty((len(rest), 3))  # residual capacities of the open sequences, as parts of the whole
    names = np.empty(len(rest), np.int64)
    filled = np.empty(len(rest), np.int64)
    open_n, made = 0, whole
    least = float(lengths.min()) / cap.tokens if n else 0.0
    for p in rest:
        size = float(lengths[p])
        need = np.array([size, 1.0, size * size]) / caps
        room = left[:open_n] - need
        ok = (room >= -1e-12).all(axis=1)
        at = -1
        if ok.any():
            if cap.rule == "norm":
                score = np.where(ok, (weights * room * room).sum(axis=1), np.inf)
                at = int(score.argmin())
            else:
                score = np.where(ok, (weights * left[:open_n] * need).sum(axis=1), -np.inf)
                at = int(score.argmax())
        if at < 0:
            at, open_n = open_n, open_n + 1
            left[at], names[at], filled[at] = 1.0, made, 0
            made += 1
        seq[p], offset[p] = names[at], filled[at]
        filled[at] += int(size)
        left[at] -= need
        if left[at, 0] < least - 1e-12:  # no piece fits any more
            open_n -= 1
            left[at], names[at], filled[at] = left[open_n], names[open_n], filled[open_n]
    return seq, offset


def pack(pieces: DataFrame, cap: Capacity = Capacity(), group_tokens: int = 4_000_000) -> DataFrame:
    """Adds sequence_id and offset to the rows of `pieces` (doc_id, piece, length and others); columns that already have
    these names are replaced.

    Pieces are dealt by their place in the table, which should be a written one, into groups of about group_tokens tokens,
    so one task holds a bounded number of narrow rows however large the table is and however often an id, or null, is
    repeated. An empty table gives an empty result.
    """
    pieces = pieces.drop("sequence_id", "offset")
    total = pieces.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    groups = max(1, math.ceil(total / group_tokens))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("piece", "ascending")]).drop_columns("__group")
        seq, offset = fill(t["length"].to_numpy().astype(np.int64), cap)
        return t.append_column("sequence_id", pa.array((key[0].as_py() << 32) + seq)).append_column("offset", pa.array(offset))

    return pieces.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))).groupBy("__group").applyInArrow(run, schema)


def packed_documents(docs: DataFrame, tokenizer: str, cap: Capacity = Capacity(), end_id: int = 0) -> DataFrame:
    """Pieces of all documents with the sequence and offset of each. The narrow pieces are written once to the scratch folder."""
    return pack(saved(cut(docs, tokenizer, cap.tokens, end_id), "pieces"), cap)
