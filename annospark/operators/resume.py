"""Results of later runs merged into a stored annotation table: earlier labels stay, only pending rows are filled.

The table is a base, written once, and one folder of filled rows a run.  A run
fills rows that no run before it has filled; it writes these rows only, so its cost is
that of what was pending.  Reading joins the base with the filled rows, of which
each key has one.  A run that is replayed, or comes again after a crash, finds the rows of the
runs before it as they were and writes its own folder anew: nothing changes.

Defined cases: null keys match null keys; repeated results of a key in one run: the last arrival
counts; blank and null labels are pending; results of unknown keys are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annospark.functions.text import utrim
from annospark.operators.joins import null_safe_join


def usable(label: Column) -> Column:
    return F.coalesce(utrim(label) != "", F.lit(False))


class StoredAnnotations:
    """The stored table at `folder`, its rows named by `keys`."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str]):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys

    def create(self, rows: DataFrame) -> StoredAnnotations:
        """Stores (keys, label, confidence and any other columns) as the base."""
        rows.write.parquet(f"{self.folder}/base")
        empty = rows.select(*self.keys, "label", "confidence", F.lit(0).alias("run")).where("false")
        empty.write.parquet(f"{self.folder}/filled/none")
        return self

    def _filled(self, before: int | None = None) -> DataFrame:
        base = self.spark.read.parquet(f"{self.folder}/base")
        kinds = dict(base.dtypes)
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*self.keys, "label", "confidence"]) + ", run int"
        rows = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/filled")
        return rows if before is None else rows.where(F.col("run") < before)

    def read(self, before: int | None = None) -> DataFrame:
        """The table after all runs (or those before this one), with the run that filled each row: 0 the base, null none."""
        base = self.spark.read.parquet(f"{self.folder}/base")
        filled = self._filled(before).select(*self.keys, F.col("label").alias("__label"), F.col("confidence").alias("__confidence"), F.col("run").alias("__run"))
        j = null_safe_join(base, filled, self.keys)
        kept = usable(F.col("label"))
        rest = [c for c in base.columns if c not in (*self.keys, "label", "confidence")]
        return j.select(*self.keys, *rest, F.when(kept, F.col("label")).otherwise(F.coalesce("__label", "label")).alias("label"),
                        F.when(kept, F.col("confidence")).otherwise(F.coalesce("__confidence", "confidence")).alias("confidence"),
                        F.when(kept, 0).otherwise(F.col("__run")).alias("run"))

    def pending(self, before: int | None = None) -> DataFrame:
        """The keys without a usable label."""
        return self.read(before).where(~usable(F.col("label"))).select(*self.keys)

    def merge(self, results: DataFrame, run: int, order_col: str = "arrival") -> StoredAnnotations:
        """Fills pending rows from (keys, label, confidence, order) as the run of this number, counted from 1."""
        last = (results.where(usable(F.col("label"))).groupBy(*self.keys)
                .agg(F.max_by(F.struct("label", "confidence"), order_col).alias("__r")))
        found = null_safe_join(self.pending(run), last, self.keys, "inner")
        (found.select(*self.keys, "__r.label", "__r.confidence", F.lit(run).alias("run"))
         .write.mode("overwrite").parquet(f"{self.folder}/filled/{run}"))
        return self
