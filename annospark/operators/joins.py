"""Join helpers: null-safe keys; tables that grow with the corpus are joined by a shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grows(df: DataFrame) -> DataFrame:
    """The same rows, for a join on a key of the corpus (a block, a request): both sides are shuffled, none is broadcast.

    Spark estimates rows behind a generator (long facts, raw answers) and stored, well compressed
    columns far below their size, and would collect them on the driver.
    """
    return df.hint("merge")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join that matches NULL keys to NULL keys (pandas merge semantics)."""
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(grows(r), cond, how).drop(*[f"__r_{k}" for k in keys])
