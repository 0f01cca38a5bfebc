"""Token-id files: every document its own zstandard frame, one shared dictionary, an offset index for short reads.

A file is: the frames one after another; the index (doc_id, null flag, offset, bytes, ids, crc32 of each document); a
JSON footer with the dictionary's SHA-256, the id width and the counts; the lengths of index and footer; a magic number.
Files hold consecutive ranges of doc_id in ascending order, so a document's place among all ids is its file's base plus
its place in the file. The dictionary is fitted on a bounded, hash-chosen sample of serialised id arrays.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_schema, bounds, bucket, out_batch, partitions, prepare, saved, scratch
from .encoding import encoder

MAGIC = b"RFIDFILE"
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("bytes", "<u8"), ("ids", "<u8"), ("crc", "<u4")])

#: A file is closed after so many bytes; a task writes as many as it needs.
FILE_BYTES = 256 << 20
#: The dictionary is fitted on about this many documents, of at most so many characters each.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 1000, 16_384, 65_536


def narrowed(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def widened(raw: bytes, width: int) -> bytes:
    return raw if width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


def fit_dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> bytes:
    """A dictionary from a sample of SAMPLE_DOCS documents; raw content where there are too few to train one; empty for no documents."""
    total = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(1, total))
    chosen = docs.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))) & (F.length("text") <= SAMPLE_CHARS)).select("doc_id", "text").orderBy(F.xxhash64("doc_id"), "text").limit(2 * SAMPLE_DOCS)
    enc, end = encoder(tokenizer), int(end_id).to_bytes(4, "little")
    samples = sorted(narrowed(enc.encode(r["text"]) + end, width) for r in chosen.collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


def as_dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = 1, level: int = 3, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode every whole text (null: empty) and write the files below the scratch folder; returns their list in order.

    Result: path, dictionary (path), base (ids in earlier files), documents, ids, one row for each file. Documents with a
    null id come first; rows that share an id stand next to each other in a fixed order.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    width = 2 if encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    top = scratch(spark, "ids")
    raw_dict = fit_dictionary(docs, tokenizer, end_id, width)
    digest = hashlib.sha256(raw_dict).hexdigest()
    where, base = pafs.FileSystem.from_uri(top)
    where.create_dir(base, recursive=True)
    with where.open_output_stream(f"{base}/dictionary-{digest}.zdict") as f:
        f.write(raw_dict)
    n = partitions(spark)
    cuts = bounds(docs, "doc_id", n)

    framed_as = "bucket int, doc_id long, n long, crc long, frame binary"
    listed_as = "part int, file int, path string, documents long, ids long"
    frames_out, list_out = arrow_schema(framed_as), arrow_schema(listed_as)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), int(end_id).to_bytes(4, "little")
        press = zstandard.ZstdCompressor(level=level, dict_data=as_dictionary(raw_dict))
        for b in batches:
            ids = [enc.encode(t) + end for t in b["text"].to_pylist()]
            keys = b["doc_id"].fill_null(np.iinfo(np.int64).min).to_numpy()
            yield out_batch(frames_out, [bucket(keys, cuts), b["doc_id"], [len(x) // 4 for x in ids], [zlib.crc32(x) for x in ids], [press.compress(narrowed(x, width)) for x in ids]])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, index, at, part, file = None, [], 0, -1, 0
        store, folder = pafs.FileSystem.from_uri(top)

        def closed() -> pa.RecordBatch:
            table = np.array(index, INDEX)
            foot = json.dumps({"dictionary_sha256": digest, "width": width, "documents": len(table), "ids": int(table["ids"].sum())}).encode()
            body = zlib.compress(table.tobytes())
            out.write(body + foot + struct.pack("<QQ", len(body), len(foot)) + MAGIC)
            out.close()
            return out_batch(list_out, [[part], [file], [f"{top}/{name}"], [len(table)], [int(table["ids"].sum())]])

        for b in batches:
            for p, doc, ids, crc, frame in zip(*(b[c].to_pylist() for c in ("bucket", "doc_id", "n", "crc", "frame"))):
                if out is None:
                    name = f"part-{TaskContext.get().partitionId():05d}-{file:05d}-{uuid.uuid4().hex}.ids"
                    out, index, at, part = store.open_output_stream(f"{folder}/{name}"), [], 0, p
                index.append((doc or 0, doc is None, at, len(frame), ids, crc))
                out.write(frame)
                at += len(frame)
                if at + len(index) * INDEX.itemsize >= file_bytes:
                    yield closed()
                    out, file = None, file + 1
        if out is not None:
            yield closed()

    framed = docs.mapInArrow(frames, framed_as)
    dealt = framed.repartitionById(len(cuts) + 1, "bucket").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "frame")
    files = saved(dealt.mapInArrow(write, listed_as), "files")
    # One row a file: this window is as small as the list of files.
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("path", F.lit(f"{top}/dictionary-{digest}.zdict").alias("dictionary"), F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"), "documents", "ids")


class IdFile:
    """A file opened for reading; documents by place, each decompressed alone."""

    def __init__(self, path: str, dictionary: bytes):
        store, name = pafs.FileSystem.from_uri(path)
        self.file = store.open_input_file(name)
        size = self.file.size()
        tail = self.file.read_at(24, size - 24)
        if tail[16:] != MAGIC:
            raise ValueError(f"{path} is not an id file")
        n_index, n_foot = struct.unpack("<QQ", tail[:16])
        self.foot = json.loads(self.file.read_at(n_foot, size - 24 - n_foot))
        if self.foot["dictionary_sha256"] != hashlib.sha256(dictionary).hexdigest():
            raise ValueError(f"{path} was written with another dictionary")
        self.index = np.frombuffer(zlib.decompress(self.file.read_at(n_index, size - 24 - n_foot - n_index)), INDEX)
        self.inflate = zstandard.ZstdDecompressor(dict_data=as_dictionary(dictionary))

    def __len__(self) -> int:
        return len(self.index)

    def ids(self, i: int) -> bytes:
        """The ids of document i as little-endian unsigned 32-bit integers; checks their crc32."""
        row = self.index[i]
        found = widened(self.inflate.decompress(self.file.read_at(int(row["bytes"]), int(row["offset"]))), self.foot["width"])
        if zlib.crc32(found) != row["crc"] or len(found) != 4 * row["ids"]:
            raise ValueError(f"document {i} is damaged")
        return found


def read_ids(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (array)."""
    spark: SparkSession = files.sparkSession
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, dictionary, base in zip(*(b[c].to_pylist() for c in ("path", "dictionary", "base"))):
                store, name = pafs.FileSystem.from_uri(dictionary)
                with store.open_input_stream(name) as f:
                    file = IdFile(path, f.read())
                starts = int(base) + np.cumsum(file.index["ids"], dtype=np.int64) - file.index["ids"].astype(np.int64)
                for lo in range(0, len(file), 1000):
                    row = file.index[lo : lo + 1000]
                    found = [file.ids(lo + i) for i in range(len(row))]
                    columns = [pa.array(row["doc_id"].astype(np.int64), mask=row["null"] == 1), starts[lo : lo + 1000], [len(x) // 4 for x in found], [zlib.crc32(x) for x in found]]
                    yield out_batch(out, columns + [[np.frombuffer(x, "<u4").astype(np.int64) for x in found]] * with_ids)

    return files.repartition(partitions(spark)).mapInArrow(run, schema)
