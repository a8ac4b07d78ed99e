"""Parquet table access for the test tables (and any parquet warehouse)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one parquet table; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread_small_input(df: DataFrame) -> DataFrame:
    """Fan a *small* input out over the cluster before heavy per-row work.

    A table stored as a handful of files with one row group each is scanned
    by a single task, which serialises per-document work (regex splitting,
    JSON parsing, scorer calls).  When the scan has fewer splits than the
    cluster has cores, rows are round-robin repartitioned (column pruning
    still applies below the exchange).  Large inputs have far more splits
    than cores and are left untouched, so no shuffle is added at scale.
    The check uses the planned split count only (no file listing on the driver).
    """
    try:
        par = df.sparkSession.sparkContext.defaultParallelism
        splits = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - e.g. a Spark Connect session: leave the plan as it is
        return df
    return df.repartition(par) if splits < par else df


def table_spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread_small_input(table(spark, sf_dir, name))
