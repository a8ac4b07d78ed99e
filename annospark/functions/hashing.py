"""Deterministic hash used for fixtures, sampling and bootstrap draws.

``h(x)`` is the first 8 hex digits of md5(x) read as an unsigned integer.
The same value is computed by DuckDB as ``('0x'||substr(md5(x),1,8))::BIGINT``,
so everything seeded by it can be checked against SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def h(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("bigint")


def h_parts(*parts: Column | str) -> Column:
    """h of the '|'-joined string form of the parts (literals allowed via F.lit)."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return h(F.concat_ws("|", *[c.cast("string") for c in cols]))


def sql_h(expr: str) -> str:
    """DuckDB spelling of h for oracle SQL."""
    return f"CAST(('0x' || substr(md5(CAST({expr} AS VARCHAR)), 1, 8)) AS BIGINT)"


def sql_h_parts(*exprs: str) -> str:
    inner = ", ".join(f"CAST({e} AS VARCHAR)" for e in exprs)
    return sql_h(f"concat_ws('|', {inner})")
