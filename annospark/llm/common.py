"""Helpers shared by the training-data operators.

* ``tokens(text)`` semantics: a word is a maximal run of characters other than
  U+0020 and U+0009..U+000D.  ``bytes.split()`` splits at exactly these bytes.
* ``stored(df)`` cuts lineage by writing Parquet to the folder that the session
  names in ``spark.checkpoint.dir``, which driver and executors share.
* ``bounded(batches)`` keeps what a Python worker holds at once to a few megabytes
  of text, however many rows or bytes an Arrow batch has.
* ``shipped(module)`` makes the functions of a module travel with the job, so
  the workers need no installed copy of this package.
"""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

#: Rows for which one task sorts or numbers a slice of an ordered table.
SLICE_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shipped(module_name: str) -> None:
    """Pickle the functions of this module by value."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of its own only where it is unset on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="annospark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose texts (of this column) hold `limit` bytes at most, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def slices(rows: int, per: int = SLICE_ROWS) -> int:
    """How many slices of about `per` rows; grows with the input."""
    return max(1, -(-rows // per))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def worker_state(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, across its tasks."""
    box = sys.__dict__.setdefault("_annospark_worker", types.SimpleNamespace())
    return box.__dict__.setdefault(name, {})


shipped(__name__)
