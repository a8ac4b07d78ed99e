"""URL filtering: rules, and where none fits a ratio of two character language models.

Rules name a host and a path prefix; a rule fits its host and all subdomains,
and the longest fitting rule wins.  URLs that a rule decides are the labelled
rows: one smoothed variable-order Markov model learns from the accepted ones,
one from the rejected ones.  The models read the whole url, with scheme, query
and fragment; host and path serve the rules.  A character's probability starts from a uniform one
and is blended, from the empty context to ORDER characters, with its frequency
after that context; contexts never met change nothing, so the order varies with
what the corpus holds.  A URL's score is the difference of the two log-likelihoods
per character, and the threshold is the one with the least balanced error on a
tenth of the labelled rows, scored by the counts of the other nine; all other
rows are scored by the counts of all labelled rows.

Counts are exact: each context and each (context, byte) has its own counter, in a
stored table that grows with the input.  The distinct byte runs of the rows to
score are joined with it, then the rows with their runs' gains; nothing of it
reaches the driver or is bounded by a constant.

Defined cases: a null url, or one without `://`, has empty host and path and fits no
rule; the models judge what it says, a null url as the empty string (score 0); without labelled rows of both
kinds all scores are 0 and the threshold is 0, so the method allows; null
ids and repeated rows are judged row by row; an empty table gives an empty
result.  Only the named columns are read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annospark.llm.common import shipped, stored

ORDER = 4
SLOTS = 1 << 19                                   # counts that a task gathers before it passes them on
SYMBOL_BITS = 9                                   # a byte, or the text's start
CODE_BITS = SYMBOL_BITS * (ORDER + 1)
UNIT = 1 << 32
BLEND = 2.0
ALPHABET = 256
BINS, WIDEST = 2048, 8.0

# Fixed values: (verdict, host, path) of the contract.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    lowered = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules) -> Column:
    """struct(verdict, rule) of the longest rule that fits, else null."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        is_rule = F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))
        out = F.when(fits, is_rule) if out is None else out.when(fits, is_rule)
    return out if out is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def gram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of all bytes of the texts in a row: the text's number, and the byte behind its ORDER predecessors, SYMBOL_BITS bits each.

    Contexts do not cross texts; a predecessor before the text's start reads as 0, a byte b as b + 1.
    """
    data = [t.encode() for t in texts]
    sizes = np.array([len(d) for d in data], dtype=np.int64)
    flat = np.frombuffer(b"".join(data), dtype=np.uint8).astype(np.int64) + 1
    owner = np.repeat(np.arange(len(data)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    code = flat.copy()
    for k in range(1, ORDER + 1):
        before = np.concatenate([np.zeros(min(k, len(flat)), np.int64), flat[:max(0, len(flat) - k)]])
        code |= np.where(place >= k, before, 0) << (SYMBOL_BITS * k)
    return owner, code


def counter_keys() -> Column:
    """The counters that a column `code` reads: number 2k is order k's (context, byte), 2k + 1 its context alone."""
    out = []
    for k in range(ORDER + 1):
        both = F.col("code").bitwiseAND(F.lit((1 << SYMBOL_BITS * (k + 1)) - 1))
        out += [both + F.lit(2 * k << CODE_BITS), F.shiftright(both, SYMBOL_BITS) + F.lit(2 * k + 1 << CODE_BITS)]
    return F.array(*out)


def fit(labelled: DataFrame, slots: int = SLOTS) -> DataFrame | None:
    """(label 0 or 1, key, perhaps held) -> the stored counters: key, all0, all1, and some0, some1 of the rows not held.

    A task gathers about `slots` counts before it hands them to Spark's sum. None if a label is missing.
    """
    held = F.col("held") if "held" in labelled.columns else F.lit(False)
    rows = labelled.select((F.col("label") * 2 + held.cast("int")).alias("cell"), "key")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed() -> pa.RecordBatch:
            values, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([n for _, n in found])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(values >> 2), pa.array(values & 3), pa.array(n)], names=["code", "cell", "n"])

        found: list[tuple] = []
        for batch in batches:
            cells = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            owner, code = gram_codes(batch.column(1).to_pylist())
            if len(code):
                found.append(np.unique(code << 2 | cells[owner], return_counts=True))
            if sum(len(c) for c, _ in found) >= slots:
                yield summed()
                found.clear()
        if found:
            yield summed()

    met = rows.mapInArrow(count, "code long, cell long, n long")
    cells = {"all0": "cell < 2", "all1": "cell >= 2", "some0": "cell = 0", "some1": "cell = 2"}
    codes = met.groupBy("code").agg(*[F.sum(F.when(F.expr(which), F.col("n")).otherwise(0)).alias(c) for c, which in cells.items()])
    counters = stored(codes.select(F.explode(counter_keys()).alias("key"), *cells).groupBy("key").agg(*[F.sum(c).alias(c) for c in cells]))
    total = counters.where(F.col("key") == F.lit(1 << CODE_BITS)).collect()     # order 0's context: one row
    return counters if total and total[0].all0 and total[0].all1 else None


def gains(codes: DataFrame, model: DataFrame) -> DataFrame:
    """code, gain, trial: the accepted minus the rejected log-likelihood in UNITs, by all labelled rows and by those not held."""
    cells = ("all0", "all1", "some0", "some1")
    # order 0's context is one row that every code reads: a constant, not a key of the join
    root = model.where(F.col("key") == F.lit(1 << CODE_BITS)).first()
    asked = codes.select("code", F.posexplode(counter_keys()).alias("number", "key")).where("number <> 1")
    read = asked.join(model.withColumnRenamed("key", "m_key"), F.col("key") == F.col("m_key"), "left")
    each = read.groupBy("code").agg(*[F.coalesce(F.max(F.when(F.col("number") == i, F.col(c))), F.lit(0)).alias(f"{c}_{i}")
                                      for c in cells for i in range(2 * ORDER + 2) if i != 1])
    each = each.select("*", *[F.lit(root[c]).cast("bigint").alias(f"{c}_1") for c in cells])

    def likelihood(c: str) -> Column:
        p = F.lit(1.0 / ALPHABET)
        for k in range(ORDER + 1):
            p = (F.col(f"{c}_{2 * k}") + BLEND * p) / (F.col(f"{c}_{2 * k + 1}") + BLEND)
        return F.log(p)

    def gain(c: str) -> Column:
        both = (F.col(f"{c}0_1") > 0) & (F.col(f"{c}1_1") > 0)
        return F.when(both, F.round((likelihood(f"{c}1") - likelihood(f"{c}0")) * UNIT)).otherwise(0).cast("bigint")

    return each.select("code", gain("all").alias("gain"), gain("some").alias("trial"))


def scored(rows: DataFrame, model: DataFrame | None) -> DataFrame:
    """Adds `score`, the accepted minus the rejected log-likelihood per byte of `key`; rows `held`, if named, by the counts without them.

    Gains are summed in whole UNITs, so equal keys have equal scores in whatever order Spark adds.
    """
    if model is None:
        return rows.withColumn("score", F.lit(0.0))
    named = stored(rows.withColumn("__row", F.monotonically_increasing_id()))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            owner, code = gram_codes(batch.column(1).to_pylist())
            order = np.lexsort((code, owner))
            owner, code = owner[order], code[order]
            first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])])[:len(code)])
            n = np.diff(np.append(first, len(code)))
            yield pa.RecordBatch.from_arrays([pa.array(numbers[owner[first]]), pa.array(code[first]), pa.array(n)], names=["g_row", "code", "n"])

    met = named.select("__row", "key").mapInArrow(grams, "g_row long, code long, n long")
    gain = stored(gains(met.select("code").distinct(), model)).withColumnRenamed("code", "g_code")
    sums = stored(met.join(gain, F.col("code") == F.col("g_code")).groupBy("g_row").agg(
        F.sum(F.col("n") * F.col("gain")).alias("gain"), F.sum(F.col("n") * F.col("trial")).alias("trial")))
    units = F.when(F.col("held"), F.col("trial")).otherwise(F.col("gain")) if "held" in rows.columns else F.col("gain")
    score = F.coalesce(units / F.lit(float(UNIT)) / F.greatest(F.octet_length("key"), F.lit(1)), F.lit(0.0))
    return named.join(sums, F.col("__row") == F.col("g_row"), "left").select(*rows.columns, score.alias("score"))


def calibrated(held_out: DataFrame) -> float:
    """The threshold with the least balanced error on rows (label, score); of equal ones the middle."""
    b = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("score") + WIDEST) / (2 * WIDEST) * BINS)))
    rows = held_out.groupBy("label", b.alias("bin")).count().collect()      # at most 2 * BINS rows
    n = np.zeros((2, BINS + 1))
    for r in rows:
        n[r.label, r.bin + 1] = r["count"]
    if not n.sum(axis=1).all():
        return 0.0
    passed = np.cumsum(n, axis=1) / n.sum(axis=1, keepdims=True)            # share below each edge
    error = passed[1] + 1 - passed[0]                                       # accepted below, rejected at or above
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return float(np.mean(best[[0, -1]]) / BINS * 2 * WIDEST - WIDEST)


def filter_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES, slots: int = SLOTS) -> DataFrame:
    """page id, host, path, rule, verdict, score (null where a rule decides), threshold."""
    host, path = host_and_path(F.col(url_col))
    rows = (pages.select(F.col(id_col), host.alias("host"), path.alias("path"), F.coalesce(F.col(url_col), F.lit("")).alias("key"))
            .withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules))
            .select(F.col(id_col), "host", "path", "fit.rule", F.col("fit.verdict").alias("ruled"), "key"))
    rows = rows.withColumn("held", F.col("ruled").isNotNull() & (F.pmod(F.xxhash64("key"), F.lit(10)) == 0))
    label = F.when(F.col("ruled") == "allow", 1).otherwise(0).alias("label")
    model = fit(rows.where("ruled is not null").select(label, "key", "held"), slots)
    scores = scored(rows.where("ruled is null or held"), model)
    threshold = calibrated(scores.where("held").select(label, "score")) if model is not None else 0.0
    judged = scores.where("ruled is null").withColumn(
        "verdict", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    decided = rows.where("ruled is not null").withColumn("score", F.lit(None).cast("double")).withColumn("verdict", F.col("ruled"))
    return decided.unionByName(judged).select(F.col(id_col), "host", "path", "rule", "verdict", "score", F.lit(threshold).alias("threshold"))


shipped(__name__)
