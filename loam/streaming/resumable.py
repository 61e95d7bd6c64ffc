"""Resumable scoring, batch and streaming.

Batch: finished rows are a table; the rest is ``left_anti`` on the key, dealt once into its
chunks, scored and appended chunk by chunk. Streaming: new input files are picked up by
``readStream``; an id that was seen is dropped by keyed state, which the checkpoint keeps over
restarts; each micro-batch is scored in ``foreachBatch`` and written under its ``batch_id``
partition with dynamic partition overwrite, so a replayed batch after a crash overwrites itself
instead of duplicating rows (exactly-once on the sink). The checkpoint location records which
files were done.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scoring import ScoreFn, score
from ..session import checkpoint_dir, path_exists, remove_path

#: Folder name of the chunks while they wait.
_CHUNK = "_chunk"


def remaining(todo: DataFrame, done: DataFrame | None, key: str = "id") -> DataFrame:
    """Rows of ``todo`` whose key is not in ``done`` (resume by key, not by offset)."""
    if done is None:
        return todo
    return todo.join(done.select(key), key, "left_anti")


def resume_batch(spark: SparkSession, todo: DataFrame, done_path: str, score_fn: ScoreFn,
                 key: str = "id", n: int = 1, chunks: int = 1) -> DataFrame:
    """Score what ``done_path`` lacks, append it there, return the whole finished table.

    An id of ``todo`` that comes twice is scored once (which of its rows is open). With several ``chunks``
    the rest is dealt into them once, by a hash of the key, in the shared folder, so the input and the
    finished table are read once whatever their number; each chunk then reads its own part. An error stops
    the run with the earlier chunks kept, and the next run goes on with what is missing. Rows with a null
    key are left out, as nothing could tell later that they are done.
    """
    done = spark.read.parquet(done_path) if path_exists(spark, done_path) else None
    rest = remaining(todo.where(F.col(key).isNotNull()), done, key).dropDuplicates([key])
    if chunks == 1:
        score(rest, score_fn, n).write.mode("append").parquet(done_path)
    else:
        dealt = os.path.join(checkpoint_dir(spark), f"chunks-{uuid.uuid4().hex}")
        try:
            rest.withColumn(_CHUNK, F.pmod(F.xxhash64(F.col(key)), F.lit(chunks))).write.partitionBy(_CHUNK).parquet(dealt)
            for c in range(chunks):
                part = os.path.join(dealt, f"{_CHUNK}={c}")
                if path_exists(spark, part):
                    rows = spark.read.schema(rest.schema).parquet(part)
                    score(rows, score_fn, n).write.mode("append").parquet(done_path)
        finally:
            remove_path(spark, dealt)
    if not path_exists(spark, done_path):  # nothing to do and nothing done
        score(rest.limit(0), score_fn, n).write.parquet(done_path)
    return spark.read.parquet(done_path)


def start_stream(spark: SparkSession, source_dir: str, schema: T.StructType, sink_dir: str,
                 checkpoint: str, score_fn: ScoreFn, n: int = 1, max_files: int = 1,
                 available_now: bool = True, key: str | None = None, event_time: str | None = None,
                 delay: str = "1 day"):
    """Start the streaming form; returns the ``StreamingQuery``.

    ``maxFilesPerTrigger`` bounds each micro-batch (the chunk of the original
    loop); ``availableNow`` processes the backlog and stops.

    With ``key`` an id is scored once, however many files or micro-batches it comes in, also after a
    restart from the checkpoint: the ids seen are the stream's state, dealt by key. They are kept for good
    unless ``event_time`` names a timestamp column: then an id is forgotten ``delay`` after its time, and
    only a repetition that comes later than that is scored again. Which of several rows of an id stays is
    open. Without ``key`` every row is scored.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source_dir)
    if key is not None:
        stream = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key]) if event_time \
            else stream.dropDuplicates([key])

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        scored = score(batch, score_fn, n).withColumn("batch_id", F.lit(batch_id))
        (scored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(sink_dir))

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def start_epoch_summary(spark: SparkSession, source_dir: str, schema: T.StructType, sink_dir: str, checkpoint: str,
                        run: str, epoch: Column, loss: str, max_files: int = 1, available_now: bool = True):
    """F23 as results arrive: keep the mean loss per run and epoch while log files come in.

    The stream's state is one sum per (run, epoch); each micro-batch writes the rows that it changed under
    its ``batch_id`` (update mode, replays overwrite themselves). ``latest`` reads them back. Rows may come
    in any order and at any time; a null loss does not count.
    """
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source_dir)
    means = log.groupBy(F.col(run), epoch.alias("epoch")).agg(F.avg(loss).alias("loss"))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(sink_dir))

    writer = means.writeStream.outputMode("update").foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def latest(spark: SparkSession, sink_dir: str, keys: list[str]) -> DataFrame:
    """The last row of each key that an update-mode sink holds."""
    rows = spark.read.parquet(sink_dir)
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*keys, "r.*")
