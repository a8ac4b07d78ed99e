"""Incremental annotation as Structured Streaming (resume = the stream checkpoint).

New chunk files land in a folder; `readStream` picks them up, each
micro-batch is scored and parsed, and the result is written idempotently
per batch id (a replayed batch overwrites its own output), so an executor
or driver restart resumes from the checkpoint without duplicates.
`trigger(availableNow=True)` processes the backlog and stops, which is the
batch-resume behaviour of the study's periodic checkpoints.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annospark.operators.annotate import rule_answers, score
from annospark.operators.answers import normalize_answers
from annospark.session import checkpoint_dir


def annotate_batch(batch: DataFrame, id_col: str, text_col: str = "text", scorer=None) -> DataFrame:
    """Parsed answers of a scorer callback, or of the bundled rule."""
    scored = (score(batch, scorer, text_col=text_col, keep=[id_col]) if scorer is not None
              else rule_answers(batch, text_col=text_col, keep=[id_col]))
    return normalize_answers(scored, "json").select(id_col, "label", "confidence", "status", "attempts",
                                                   "tokens_in", "tokens_out")


def start_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, id_col: str,
                 text_col: str = "text", files_per_trigger: int | None = None, available_now: bool = True):
    schema = spark.read.parquet(source).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:       # a rate; unset, a batch takes all that has landed
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = reader.parquet(source)

    def write_batch(bdf: DataFrame, batch_id: int) -> None:
        (annotate_batch(bdf, id_col, text_col).withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").parquet(f"{sink}/batch={batch_id}"))

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def stream_annotate(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str = "text",
                    files_per_trigger: int | None = None) -> DataFrame:
    """Land `docs`, one file per partition, in the shared checkpoint folder, run the
    stream to completion, and return the annotated table."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    src, sink, ckpt = f"{base}/landing", f"{base}/annotated", f"{base}/checkpoint"
    docs.select(id_col, text_col).write.parquet(src)
    q = start_stream(spark, src, sink, ckpt, id_col, text_col, files_per_trigger)
    q.awaitTermination()
    return spark.read.parquet(sink).drop("batch")   # folder name; batch_id is a data column
