"""Results attached as they arrive: the last arrival of each key wins across micro-batches and replays.

The stream keeps one row of state per key, the result with the latest arrival, in the
checkpoint's state store.  A micro-batch hands on the keys it has changed, written under its
batch id, so a replayed batch overwrites its own output; among the rows of a key the
latest arrival is the state, in whatever order batches were written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annospark.operators.annotate import attach_results
from annospark.session import checkpoint_dir


def start_latest(spark: SparkSession, source: str, sink: str, checkpoint: str, key: list[str], order_col: str = "arrival",
                 files_per_trigger: int | None = None, available_now: bool = True):
    """Streams result files into `sink`: after each batch the changed keys with their latest result."""
    reader = spark.readStream.schema(spark.read.parquet(source).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = reader.parquet(source)
    rest = [c for c in stream.columns if c not in (*key, order_col)]
    latest = stream.groupBy(*key).agg(F.max_by(F.struct(*rest), order_col).alias("r"), F.max(order_col).alias(order_col))

    def write_batch(changed: DataFrame, batch_id: int) -> None:
        changed.select(*key, order_col, "r.*").write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    writer = latest.writeStream.outputMode("update").foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def attach_stream(spark: SparkSession, requests: DataFrame, results: DataFrame, key: list[str], order_col: str = "arrival",
                  landings: int = 4, files_per_trigger: int | None = None) -> DataFrame:
    """`attach_results` of results that land in several files and batches, in any order; the stream is run to its end."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/attach-{uuid.uuid4().hex}"
    source, sink = f"{base}/landing", f"{base}/latest"
    results.repartition(landings).write.parquet(source)
    start_latest(spark, source, sink, f"{base}/checkpoint", key, order_col, files_per_trigger).awaitTermination()
    return attach_results(requests, spark.read.parquet(sink).drop("batch"), key, order_col)
