"""Structured Streaming: valid rows on, others to a second sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dataset import filtered, validate
from ..sources.readers import numbered, read_from, write_split
from ..sources.scratch import shared


def files(spark: SparkSession, folder: str, schema, glob: str = "*", kind: str = "parquet") -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.format(kind).schema(schema).option("pathGlobFilter", glob).load(folder)


def valid(stream: DataFrame, t: object) -> DataFrame:
    return filtered(stream, t)


def judged(stream: DataFrame, t: object) -> DataFrame:
    return validate(stream, t)


def split_sinks(stream: DataFrame, t: object, good: str, bad: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Each batch's valid rows to one folder and its invalid ones, with errors, to another. A batch that is run again after a
    failure replaces what it wrote before."""

    def both(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        write_split(batch, t, f"{good}/batch={batch_id}", f"{bad}/batch={batch_id}", mode="overwrite")
        batch.unpersist()

    return stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def numbered_sink(stream: DataFrame, folder: str, checkpoint: str, line: str = "line", row: str = "row", path: str | None = None, **trigger) -> StreamingQuery:
    """A stream of files to Parquet below folder/rows, each row with its number in its file and over all that came, batch by
    batch. A file comes whole in one batch; the rows of the batches before are in folder/counts, one row for each batch, so a
    batch that is run again after a failure gets the numbers that it had."""

    def one(batch: DataFrame, batch_id: int) -> None:
        spark, counts = batch.sparkSession, f"{folder}/counts"
        # The batch's own empty count makes the folder one that can be read.
        spark.createDataFrame([(0,)], "rows long").write.mode("overwrite").parquet(f"{counts}/batch={batch_id}")
        before = spark.read.parquet(counts).where(F.col("batch") < batch_id).agg(F.sum("rows")).first()[0] or 0
        rows = f"{folder}/rows/batch={batch_id}"
        numbered(batch, line, row, path, before).write.mode("overwrite").parquet(rows)
        done = spark.read.parquet(rows).count()
        spark.createDataFrame([(done,)], "rows long").write.mode("overwrite").parquet(f"{counts}/batch={batch_id}")

    return read_from(stream).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def to_memory(stream: DataFrame, name: str) -> DataFrame:
    """Run what is there to an in-memory table, for tests and small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def to_files(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Run what is there to Parquet files, and read them; executors write, nothing passes through the driver.

    Without a folder, a new one below spark.checkpoint.dir; only where that is unset and all runs on this machine, a new local one."""
    spark = stream.sparkSession
    top = folder or shared(spark, "stream")
    query = stream.writeStream.format("parquet").option("path", f"{top}/rows").option("checkpointLocation", f"{top}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{top}/rows")
