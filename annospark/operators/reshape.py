"""Reshape operators: wide <-> long, long fact, periods, merge, sampling, reconcile."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annospark.constants import (CONDITION_COLUMN_RE, EXCLUDE_MODELS, MODEL_LABELS,
                                 PERIOD_EDGES, PERIOD_LABELS)
from annospark.functions.hashing import h_parts
from annospark.functions.text import year_from_filename
from annospark.operators.joins import null_safe_join


# ---------------------------------------------------------------- J2 / J4
def detect_conditions(df: DataFrame, exclude=EXCLUDE_MODELS) -> list[tuple[str, str, str]]:
    """(column, model_key, prompt) for every DIL_<key>_prompt<X> column (schema only)."""
    pat = re.compile(CONDITION_COLUMN_RE)
    out = []
    for c in df.columns:
        m = pat.match(c)
        if m and m.group(1) not in exclude:
            out.append((c, m.group(1), m.group(2)))
    return out


def display_name(key: Column, labels: dict[str, str] = MODEL_LABELS) -> Column:
    """Key -> display name, default = key (a literal map: no join needed)."""
    m = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.element_at(m, key), key)


def condition_name(key: Column, prompt: Column) -> Column:
    return F.concat(key, F.lit("_prompt"), prompt)


# ---------------------------------------------------------------- J3
def to_long(wide: DataFrame, id_cols: list[str]) -> DataFrame:
    """Wide -> long, one row per block x condition, label and confidence kept paired.

    A narrow generator (`inline` of an array of structs): no shuffle.
    """
    conds = detect_conditions(wide)
    cols = set(wide.columns)
    items = []
    for col, key, p in conds:
        conf_col = f"confidence_{key}_prompt{p}"
        conf = F.col(conf_col) if conf_col in cols else F.lit(None).cast("string")
        items.append(F.struct(F.lit(key).alias("model_key"), F.lit(p).alias("prompt"),
                              F.col(col).cast("string").alias("label"), conf.alias("confidence")))
    if not items:   # no (non-excluded) condition columns: empty long table with the same schema
        none = F.lit(None).cast("string")
        return wide.select(*id_cols, none.alias("model_key"), none.alias("prompt"),
                           none.alias("label"), none.alias("confidence")).where(F.lit(False))
    return wide.select(*id_cols, F.inline(F.array(*items)))


# ---------------------------------------------------------------- R9
def binarize(c: Column, casefold: bool = False) -> Column:
    """'yes' -> 1, 'no' -> 0, anything else NULL (case-sensitive unless casefold)."""
    x = F.lower(c) if casefold else c
    return F.when(x == "yes", 1).when(x == "no", 0).cast("int")


# ---------------------------------------------------------------- J6
def period(year: Column, edges=PERIOD_EDGES, labels=PERIOD_LABELS) -> Column:
    """Right-closed bins (e0,e1], (e1,e2], ...; outside or NULL -> 'nan'."""
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (year > lo) & (year <= hi)
        expr = F.when(cond, lab) if expr is None else expr.when(cond, lab)
    return expr.otherwise("nan")


# ---------------------------------------------------------------- J7 / I1
def long_all(wide: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Every block x condition row with case-insensitive pred (NULL when invalid)."""
    extra = extra or []
    ids = ["block_id", "doc_id", "DIL", *[c for c in extra if c in wide.columns]]
    lg = to_long(wide, ids)
    year = year_from_filename(F.col("doc_id"))
    return (lg.select(
                "block_id", "doc_id", year.alias("year"),
                display_name(F.col("model_key")).alias("model"), "prompt",
                F.coalesce(F.lower("DIL") == "yes", F.lit(False)).cast("int").alias("gold"),
                binarize(F.col("label"), casefold=True).alias("pred"),
                F.coalesce(F.lower("confidence") == "high", F.lit(False)).alias("high"),
                *extra)
            .withColumn("correct", (F.col("pred") == F.col("gold")).cast("int"))
            .withColumn("period", period(F.col("year"))))


def long_fact(wide: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Canonical long fact: block_id, doc_id, year, model, prompt, gold, pred, high, correct, period.

    Case-insensitive labels, NULL gold counts as negative, invalid predictions dropped.
    """
    return long_all(wide, extra).where(F.col("pred").isNotNull())


# ---------------------------------------------------------------- J5
def pivot_long(long: DataFrame, key_cols: list[str], values: list[str],
               value_col: str = "pred", index: str = "block_id") -> DataFrame:
    """Long -> wide by condition; duplicates averaged; pivot values fixed (no extra job)."""
    cond = F.concat_ws("_prompt", *key_cols) if len(key_cols) > 1 else F.col(key_cols[0])
    return (long.withColumn("__cond", cond)
            .groupBy(index).pivot("__cond", values).agg(F.avg(value_col)))


# ---------------------------------------------------------------- J1
def merge_conditions(files: list[DataFrame], on: str = "block_id") -> DataFrame:
    """Left-merge per-condition files onto the first file, which stays whole.

    A null key matches null keys and a repeated key fans out, as in a chain of
    left merges.  All joins share one null-safe key, so the growing left side
    is shuffled once and every file once.  An annotation column already seen
    gets a `_dup_<i>` suffix, as colliding merges do.
    """
    def annotations(f: DataFrame) -> list[str]:
        return [c for c in f.columns if c.startswith(("DIL_", "confidence_"))]

    out, seen = files[0], set(annotations(files[0]))
    for i, f in enumerate(files[1:], 1):
        ann = annotations(f)
        named = [F.col(c).cast("string").alias(f"{c}_dup_{i}" if c in seen else c) for c in ann]
        seen.update(ann)
        out = null_safe_join(out, f.select(on, *named), [on])
    return out


BUCKET_KEY = "__key"


def store_condition(df: DataFrame, name: str, path: str, on: str = "block_id", buckets: int = 200) -> None:
    """Stores a condition file as a table of `buckets` buckets, one sorted file each, by its key as text (null has one of its own)."""
    key = F.when(F.col(on).isNull(), F.lit("n")).otherwise(F.concat(F.lit("k"), F.col(on).cast("string")))
    (df.withColumn(BUCKET_KEY, key).repartition(buckets, BUCKET_KEY).write.option("path", path)
     .bucketBy(buckets, BUCKET_KEY).sortBy(BUCKET_KEY).saveAsTable(name))


def merge_stored(spark: SparkSession, names: list[str], on: str = "block_id") -> DataFrame:
    """`merge_conditions` of stored tables with as many buckets each: bucket meets bucket, nothing is shuffled or broadcast."""
    out = spark.table(names[0])
    seen = {c for c in out.columns if c.startswith(("DIL_", "confidence_"))}
    for i, name in enumerate(names[1:], 1):
        f = spark.table(name)
        ann = [c for c in f.columns if c.startswith(("DIL_", "confidence_"))]
        named = [F.col(c).cast("string").alias(f"{c}_dup_{i}" if c in seen else c) for c in ann]
        seen.update(ann)
        right = f.select(F.col(BUCKET_KEY).alias("__r"), *named).hint("merge")
        out = out.join(right, F.col(BUCKET_KEY) == F.col("__r"), "left").drop("__r")
    return out.drop(BUCKET_KEY)


# ---------------------------------------------------------------- J9
def stratified_sample(df: DataFrame, label_col: str, n: int, seed: int, id_col: str,
                      slack: float = 2.0) -> DataFrame:
    """Exactly `n` rows per class (or all when fewer): the n smallest h(seed|id).

    Scales without sorting whole classes: per-class counts give a hash
    threshold that keeps ~slack*n rows per class (a narrow filter); only that
    remainder is ranked.  If a class keeps fewer than n rows the threshold is
    raised and the filter repeated, so the result is exact.
    """
    keyed = df.withColumn("__h", h_parts(F.lit(seed), id_col))
    counts = {r[0]: r[1] for r in keyed.groupBy(label_col).count().collect()}  # one row per class
    frac = {k: min(1.0, slack * n / max(c, 1)) for k, c in counts.items()}
    span = float(2 ** 32)
    while True:
        thr = F.lit(None).cast("double")
        expr = None
        for k, fr in frac.items():
            cond = F.col(label_col).eqNullSafe(F.lit(k))
            expr = F.when(cond, F.lit(fr * span + 1)) if expr is None else expr.when(cond, F.lit(fr * span + 1))
        thr = expr if expr is not None else thr
        cand = keyed.where(F.col("__h") < thr)
        kept = {r[0]: r[1] for r in cand.groupBy(label_col).count().collect()}
        short = [k for k in counts if kept.get(k, 0) < min(n, counts[k]) and frac[k] < 1.0]
        if not short:
            break
        for k in short:
            frac[k] = min(1.0, frac[k] * 4)
    w = Window.partitionBy(label_col).orderBy("__h", id_col)
    return (cand.withColumn("__rn", F.row_number().over(w))
            .where(F.col("__rn") <= n).drop("__rn", "__h"))


# ---------------------------------------------------------------- J10
def reconcile(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Key sets of two corpus versions: side = both / only_a / only_b."""
    ka = a.select(*keys).distinct().withColumn("__a", F.lit(True))
    kb = b.select(*keys).distinct().withColumn("__b", F.lit(True))
    j = ka.join(kb, keys, "full_outer")
    side = (F.when(F.col("__a") & F.col("__b"), "both")
            .when(F.col("__a"), "only_a").otherwise("only_b"))
    return j.select(*keys, side.alias("side"))


# ---------------------------------------------------------------- helpers
def top_n_per_group(df: DataFrame, group_cols: list[str], order_cols: list[Column], n: int,
                    salt_col: str, buckets: int = 64) -> DataFrame:
    """First n rows per group under `order_cols`, robust to a hot group.

    Phase 1 ranks inside (group, salt bucket) so a group holding a third of
    all rows is spread over `buckets` tasks; phase 2 ranks the <= n*buckets
    survivors per group.  Exact, because a global top-n row is a top-n row
    of its bucket.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(salt_col), F.lit(buckets)))
    w1 = Window.partitionBy(*group_cols, "__salt").orderBy(*order_cols)
    w2 = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return (salted.withColumn("__r1", F.row_number().over(w1)).where(F.col("__r1") <= n)
            .withColumn("__r2", F.row_number().over(w2)).where(F.col("__r2") <= n)
            .drop("__salt", "__r1").withColumn("rank", F.col("__r2").cast("bigint")).drop("__r2"))
