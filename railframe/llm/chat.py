"""Chat formatting in Spark expressions: turns of a conversation are collected as structs and sorted, adjacent turns of one
role are merged by array functions, and one text comes out, with the spans of it that a model learns from.

    <s><|turn|>user<|text|>first<|next|>second<|end|><|turn|>assistant<|text|>answer<|end|></s>

Control strings inside roles and texts are escaped, so that the output is read back without loss. A conversation that is
larger than a chunk comes in several rows, which are its text when they are joined in the order of their chunks; a block
of one role may go on in the next chunk. So no conversation has to fit into a row or a task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_schema, out_batch, partitions, ranged, saved

BEGIN, FINISH, TURN, TEXT, NEXT, END = "<s>", "</s>", "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
#: What is escaped in roles and texts: the template's own marks, and those of other templates.
CONTROL = [BEGIN, FINISH, TURN, TEXT, NEXT, END, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
#: Conversations are cut into chunks of about so many characters; a turn counts TURN_CHARS besides its text.
CHUNK_CHARS, TURN_CHARS = 1 << 20, 256
#: Rows of long conversations in a range, about.
RANGE_ROWS = 50_000
#: Long conversations up to this number are broadcast, 16 bytes each; more are joined by a shuffle.
BROADCAST_LONG = 100_000


def escaped(c: Column) -> Column:
    """Backslashes doubled, and one behind the first character of each control string, which then is none."""
    ahead = "|".join(re.escape(x[1:]) for x in CONTROL if x[0] == "<")
    square = "|".join(re.escape(x[1:]) for x in CONTROL if x[0] == "[")
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), f"(<(?=(?:{ahead}))|\\[(?=(?:{square})))", "$1\\\\")


def plain(c: Column) -> Column:
    """The inverse of escaped."""
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def chunked(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (null: empty) and the chunk of its conversation that a row belongs to."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    weight = F.length("text") + F.length("role") + TURN_CHARS
    long_ = saved(rows.groupBy("conv_id").agg(F.sum(weight).alias("chars"), F.count("*").alias("rows")).where(F.col("chars") > CHUNK_CHARS), "long_conversations")
    size = long_.agg(F.count("*").alias("n"), F.sum("rows").alias("rows")).first()
    if not size["n"]:
        return rows.withColumn("chunk", F.lit(0).cast("long"))
    ids = long_.select(F.col("conv_id").alias("long_id"), F.lit(True).alias("long"))
    marked = rows.join(F.broadcast(ids) if size["n"] <= BROADCAST_LONG else ids, F.col("conv_id").eqNullSafe(F.col("long_id")), "left")
    short = marked.where("long IS NULL").select(*rows.columns, F.lit(0).cast("long").alias("chunk"))
    # Long ones are sorted over ranges of rows, and cut where their characters, summed within a range, pass a chunk's.
    some = marked.where("long").select(*rows.columns)
    placed = ranged(some, "conv_id", ["turn", "role", "text"], size["rows"], RANGE_ROWS, "long_turns")
    before = F.sum(weight).over(W.partitionBy("part", "conv_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1))
    cut = placed.withColumn("cut", F.coalesce(before, F.lit(0)).cast("long"))
    cut = saved(cut.withColumn("piece", F.expr(f"cut div {CHUNK_CHARS}")).drop("cut"), "long_pieces")
    pieces = cut.select("conv_id", "part", "piece").distinct()
    chunks = pieces.withColumn("chunk", (F.row_number().over(W.partitionBy("conv_id").orderBy("part", "piece")) - 1).cast("long"))
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.piece") == F.col("b.piece"))
    return short.unionByName(cut.alias("a").join(chunks.alias("b"), same).select(*(f"a.{c}" for c in rows.columns), "b.chunk"))


def formatted(turns: DataFrame, learned: str = "assistant") -> DataFrame:
    """conv_id, chunk, chunks, role (of the block that goes on from the chunk before, null if none does), formatted, and loss:
    the spans (start, end; code points of the chunk's text) of the texts whose role is `learned`.

    Turns ascend by turn, then by role and text; null turns come first, and repeated rows are turns of their own. Null roles
    and texts are empty. Rows with a null conv_id are one conversation. Other columns than conv_id, turn, role and text
    are not read. An empty table has no rows.
    """
    rows = chunked(turns)
    whole = rows.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    whole = saved(whole, "turns")
    # Where a conversation has several chunks: how many, and the role that its block before ends with.
    edges = whole.where("chunk > 0").select("conv_id").distinct()
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    ends = whole.select("conv_id", "chunk", F.get(F.col("turns.role"), F.size("turns") - 1).alias("last")).alias("e").join(edges.alias("k"), same("e.conv_id", "k.conv_id"), "left_semi")
    own = W.partitionBy("conv_id")
    ends = ends.select("conv_id", "chunk", F.lag("last").over(own.orderBy("chunk")).alias("before"), F.count("*").over(own).alias("chunks"))
    found = whole.alias("w").join(ends.alias("e"), same("w.conv_id", "e.conv_id") & (F.col("w.chunk") == F.col("e.chunk")), "left").select("w.conv_id", "w.chunk", "w.turns", F.coalesce("e.chunks", F.lit(1)).alias("chunks"), "e.before")

    # Adjacent turns of one role are one block: blocks start where the role is another than that of the turn before.
    clean = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), escaped(t["text"]).alias("text")))
    found = found.select("conv_id", "chunk", "chunks", "before", clean.alias("turns"))
    places = F.sequence(F.lit(0), F.size("turns") - 1)
    starts = F.filter(places, lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    found = found.withColumn("starts", starts)
    block = lambda i, k: F.struct(
        F.get("turns", i)["role"].alias("role"),
        F.transform(F.slice("turns", i + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - i), lambda t: t["text"]).alias("texts"),
        ((k == 0) & F.coalesce(F.get("turns", i)["role"] == F.col("before"), F.lit(False))).alias("goes_on"),
    )
    found = found.withColumn("blocks", F.transform("starts", block)).drop("turns", "starts")

    # What is written before a block; what ends the block before a chunk's first is written there, too.
    opening = lambda b: F.when(b["goes_on"], F.lit(NEXT)).otherwise(F.concat(F.lit(TURN), escaped(b["role"]), F.lit(TEXT)))
    found = found.withColumn("blocks", F.transform("blocks", lambda b: F.struct(b["role"].alias("role"), b["texts"].alias("texts"), opening(b).alias("opening"))))
    last = F.col("chunk") == F.col("chunks") - 1
    first_goes_on = F.coalesce(F.get("blocks.role", F.lit(0)) == F.col("before"), F.lit(False))
    lead = F.when(F.col("chunk") == 0, F.lit(BEGIN)).when(first_goes_on, F.lit("")).otherwise(F.lit(END))
    body = F.array_join(F.transform("blocks", lambda b: F.concat(b["opening"], F.array_join(b["texts"], NEXT))), END)
    text = F.concat(lead, body, F.when(last, F.lit(END + FINISH)).otherwise(F.lit("")))

    # Spans: each text's length and what is written before it, summed up.
    sizes = F.flatten(F.transform("blocks", lambda b, k: F.transform(b["texts"], lambda t, i: F.struct(F.when(i == 0, F.length(b["opening"]) + F.when(k > 0, len(END)).otherwise(F.length(lead))).otherwise(len(NEXT)).alias("gap"), F.length(t).alias("n"), (b["role"] == learned).alias("learned")))))
    spans = F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, s: F.struct((acc["at"] + s["gap"] + s["n"]).alias("at"), F.when(s["learned"], F.array_append(acc["spans"], F.struct((acc["at"] + s["gap"]).alias("start"), (acc["at"] + s["gap"] + s["n"]).alias("end")))).otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"],
    )
    return found.select("conv_id", "chunk", F.col("chunks").cast("long").alias("chunks"), F.when(F.col("chunk") > 0, F.col("before")).alias("role"), text.alias("formatted"), spans.alias("loss"))


def read_back(chats: DataFrame) -> DataFrame:
    """Formatted chunks as they were: conv_id, chunk, chunks, turns (role, text), learned (the texts below the loss mask) and
    formatted_chars. Control strings in roles and texts are themselves again."""
    body = F.regexp_replace(F.regexp_replace("formatted", f"^{re.escape(BEGIN)}", ""), f"{re.escape(FINISH)}$", "")
    blocks = F.filter(F.split(body, re.escape(END)), lambda b: b != "")
    opened = lambda b: b.startswith(TURN)
    role = lambda b: F.when(opened(b), plain(F.substring_index(F.substr(b, F.lit(len(TURN) + 1)), TEXT, 1))).otherwise(F.col("role"))
    texts = lambda b: F.split(F.when(opened(b), F.substr(b, F.locate(TEXT, b) + len(TEXT))).otherwise(F.substr(b, F.lit(len(NEXT) + 1))), re.escape(NEXT))
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(texts(b), lambda t: F.struct(role(b).alias("role"), plain(t).alias("text")))))
    learned = F.transform("loss", lambda s: plain(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return chats.select("conv_id", "chunk", "chunks", turns.alias("turns"), learned.alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))


def digest(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. A conversation in one row is digested there;
    the chunks of others stream through one task each, in order, as a digest has to."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    found = read.select("conv_id", "chunk", "chunks", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), F.array_join("learned", "").alias("loss"), "formatted_chars")
    single = found.where("chunks = 1").select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    out = arrow_schema(schema)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b[c].to_pylist() for c in ("conv_id", "n_turns", "said", "loss", "formatted_chars"))))
        for conv, own in groupby(rows, key=lambda r: r[0]):
            n, loss_chars, chars, turns, loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            for _, k, said, learned, size in own:
                n, loss_chars, chars = n + k, loss_chars + len(learned), chars + size
                turns.update(said.encode())
                loss.update(learned.encode())
            yield out_batch(out, [[conv], [n], [turns.hexdigest()], [loss_chars], [loss.hexdigest()], [chars]])

    several = found.where("chunks > 1").repartition(partitions(read.sparkSession), "conv_id").sortWithinPartitions("conv_id", "chunk")
    return single.unionByName(several.mapInArrow(streamed, schema))
