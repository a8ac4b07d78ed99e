"""Annotation job: scoring callback, result attachment, resume, cost and progress.

The scorer is a user function over a pandas Series of texts (e.g. a client of
a model service); it runs inside `mapInPandas`, so Spark partitions bound the
concurrency and each task retries its own failures; `score_concurrent` runs several
calls at a time inside a task.  No network access is made by this package; the
bundled annotator is a rule in columns (`rule_answers`), and a scorer for the callback.
"""

from __future__ import annotations

import sys
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annospark.functions.text import WS
from annospark.operators.joins import grows

# FIXED VALUES: prices in USD per million tokens (input, output).
PRICES = {
    "claude-opus-4-6": (5.0, 25.0),
    "claude-sonnet-4-6": (3.0, 15.0),
    "claude-haiku-4-5": (1.0, 5.0),
    "gpt-5.2": (1.75, 14.0),
}
BATCH_DISCOUNT = 0.5

SCORE_SCHEMA = "raw_text string, status string, attempts int, tokens_in bigint, tokens_out bigint"


# ---------------------------------------------------------------- A1
def score(df: DataFrame, scorer: Callable[[pd.Series], pd.Series], text_col: str = "text",
          keep: list[str] | None = None, partitions: int | None = None, max_retries: int = 3,
          backoff: float = 0.0) -> DataFrame:
    """Run `scorer` over every row; failures become status 'error' (never abort the job).

    A call that raises is repeated in halves, down to single rows, so a bad row
    fails alone; `backoff` seconds, doubled each round, pass between rounds.

    `partitions` bounds the number of concurrent scorer calls (like a
    semaphore).  Output: keep columns + raw_text, status, attempts,
    tokens_in, tokens_out.
    """
    keep = keep or []
    src = df.select(*keep, text_col)
    if partitions:
        src = src.repartition(partitions)
    in_fields = [f for f in src.schema.fields if f.name in keep]
    out_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in in_fields)
    out_schema = f"{out_schema}, {SCORE_SCHEMA}" if out_schema else SCORE_SCHEMA

    def call(texts: pd.Series) -> pd.Series:
        try:
            return pd.Series(list(scorer(texts)), index=texts.index, dtype=object)
        except Exception:  # noqa: BLE001 - a failed call is split, retried, then recorded
            if len(texts) == 1:
                return pd.Series([None], index=texts.index, dtype=object)
            half = len(texts) // 2
            return pd.concat([call(texts.iloc[:half]), call(texts.iloc[half:])])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            texts = pdf[text_col]
            raw = pd.Series([None] * len(pdf), dtype=object)
            attempts = pd.Series([0] * len(pdf), dtype="int32")
            todo = pd.Series(True, index=pdf.index)
            for attempt in range(1, max_retries + 1):
                if not todo.any():
                    break
                if attempt > 1 and backoff:
                    time.sleep(backoff * 2 ** (attempt - 2))
                idx = todo[todo].index
                attempts.loc[idx] = attempt
                got = call(texts.loc[idx])
                raw.loc[idx] = got
                todo.loc[idx] = got.isna()
            out = pdf[keep].copy()
            out["raw_text"] = raw.values
            out["status"] = ["ok" if r is not None and r == r else "error" for r in raw.values]
            out["attempts"] = attempts.values
            out["tokens_in"] = texts.fillna("").str.len().floordiv(4).astype("int64").values
            out["tokens_out"] = raw.fillna("").astype(str).str.len().floordiv(4).astype("int64").values
            yield out

    return src.mapInPandas(run, out_schema)


class _Budget:
    """At most `rate` calls a second, evenly spaced, from all threads of a task."""

    def __init__(self, rate: float | None):
        self.gap, self.next, self.lock = (1.0 / rate if rate else 0.0), 0.0, threading.Lock()

    def wait(self) -> None:
        if self.gap:
            with self.lock:
                at = max(self.next, time.monotonic())
                self.next = at + self.gap
            time.sleep(max(0.0, at - time.monotonic()))


def score_concurrent(df: DataFrame, call: Callable[[str | None], str | None], text_col: str = "text", keep: list[str] | None = None, *,
                     partitions: int = 8, in_flight: int = 4, max_retries: int = 3, backoff: float = 0.0,
                     calls_per_second: float | None = None) -> DataFrame:
    """Run `call` over every text, several calls at a time inside each task: for scorers that wait, such as model services.

    A task keeps at most `in_flight` calls running and hands rows on in their order, so at most
    partitions * in_flight calls run at once.  `calls_per_second` is the whole job's budget, of which
    each task has an equal share.  A call that raises or gives None is tried `max_retries` times,
    after `backoff` seconds that double, while the others go on; then its row alone has the status 'error'.
    Output: keep columns + raw_text, status, attempts, in_flight (calls running when the last one began,
    itself included), nth (the row's place in its task).
    """
    keep = keep or []
    src = df.select(*keep, text_col).repartition(partitions)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name in keep)
    share = calls_per_second / partitions if calls_per_second else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        budget, lock, running, nth = _Budget(share), threading.Lock(), [0], 0

        def one(text):
            seen = 0
            for attempt in range(1, max_retries + 1):
                if attempt > 1 and backoff:
                    time.sleep(backoff * 2 ** (attempt - 2))
                budget.wait()
                with lock:
                    running[0] += 1
                    seen = running[0]
                try:
                    raw = call(text)
                except Exception:  # noqa: BLE001 - a failed call is tried again, then recorded
                    raw = None
                finally:
                    with lock:
                        running[0] -= 1
                if raw is not None:
                    return raw, "ok", attempt, seen
            return None, "error", max_retries, seen

        with ThreadPoolExecutor(max_workers=in_flight) as pool:
            for pdf in batches:
                texts, waiting, done = iter(pdf[text_col].tolist()), deque(), []
                for text in texts:
                    waiting.append(pool.submit(one, text))
                    if len(waiting) >= 2 * in_flight:          # rows ahead of the oldest one still running
                        done.append(waiting.popleft().result())
                done += [f.result() for f in waiting]
                out = pdf[keep].copy()
                for k, name in enumerate(("raw_text", "status", "attempts", "in_flight")):
                    out[name] = [d[k] for d in done]
                out["nth"] = range(nth, nth + len(done))
                nth += len(done)
                yield out

    return src.mapInPandas(run, f"{schema}{', ' if schema else ''}raw_text string, status string, attempts int, in_flight int, nth bigint")


def rule_answers(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, max_retries: int = 3) -> DataFrame:
    """What `score` gives with the rule annotator, as columns; a null text has no answer after `max_retries` attempts."""
    # steps of their own: the text is lowered once and each pattern runs once, however often the score is named
    low = df.select(*(keep or []), F.col(text_col).alias("__text"), F.lower(text_col).alias("__low"))
    df = low.select(*(keep or []), "__text", marker_score(F.col("__low"), lowered=True).alias("__s"))
    s, text_col = F.col("__s"), "__text"
    answer = F.concat(F.lit('{"label": "'), F.when(F.round(s, 6) >= RULE_THRESHOLD, "yes").otherwise("no"), F.lit('", "confidence": "'),
                      F.when(F.abs(s - RULE_THRESHOLD) >= 0.2, "high").otherwise("low"), F.lit('"}'))
    there = F.col(text_col).isNotNull()
    raw = df.select(*(keep or []), F.when(there, answer).alias("raw_text"), F.when(there, "ok").otherwise("error").alias("status"),
                    F.when(there, 1).otherwise(max_retries).alias("attempts"),
                    F.floor(F.coalesce(F.length(text_col), F.lit(0)) / 4).cast("bigint").alias("tokens_in"))
    return raw.withColumn("tokens_out", F.floor(F.coalesce(F.length("raw_text"), F.lit(0)) / 4).cast("bigint"))


# ---------------------------------------------------------------- A9 rule annotator
# FIXED VALUES: the marker kinds, and among the words of the first three rows the
# Italian ones (pensò disse mormorò rifletté; oh ah ahimè dio mio; forse certamente
# probabilmente), are the examples of the study's definition of the markers.
# Ours: the words of other languages, the patterns and the weights, which the
# study does not publish.  Matched on lower-cased text.
_B, _E = r"(^|\P{L})(", r")(\P{L}|$)"
MARKERS = [
    ("declarative_verbs", _B + "pensò|disse|mormorò|rifletté|thought|said|wondered|murmured|dachte|sagte|fragte|pensa|dit|pensó|dijo" + _E, -0.2),
    ("interjections", _B + "oh|ah|ahimè|alas|ach|hélas|ay|dio mio" + _E, 0.2),
    ("modalisers", _B + "forse|certamente|probabilmente|perhaps|maybe|surely|probably|vielleicht|sicher|peut-être|quizás" + _E, 0.15),
    ("exclamations", r"!", 0.15),
    ("rhetorical_questions", r"\?", 0.15),
    ("suspension_dots", r"\.\.\.|…", 0.1),
    ("temporal_shift", _B + "ora|adesso|domani|ieri|now|tomorrow|yesterday|jetzt|morgen|gestern|maintenant|demain|ahora|mañana|ayer" + _E, 0.1),
    ("subjective_lexicon", _B + "povero|terribile|meraviglioso|poor|terrible|wonderful|schrecklich|pauvre|pobre" + _E, 0.1),
    ("fragmented_syntax", r"(^|[.!?] )\p{L}+[.!?]", 0.1),
]
RULE_THRESHOLD = 0.4


def _found(low: Column, rx: str) -> Column:
    """Whether the pattern occurs.  Words between non-letters are tried only where one of their first letters stands: the
    same places, but most are left at that character."""
    if rx.startswith(_B):
        words = rx[len(_B):-len(_E)]
        firsts = "".join(sorted({w[0] for w in words.split("|")}))
        rx = rf"(?:^|\P{{L}})(?=[{firsts}])(?:{words})(?:\P{{L}}|$)"
    return low.rlike(rx)


def marker_flags(text: Column, lowered: bool = False) -> list[Column]:
    """0 or 1 for each marker; here and below a text that is `lowered` already, in a column, is not lowered once a marker."""
    low = text if lowered else F.lower(text)
    return [F.coalesce(_found(low, rx), F.lit(False)).cast("int").alias(name) for name, rx, _ in MARKERS]


def marker_score(text: Column, lowered: bool = False) -> Column:
    low = text if lowered else F.lower(text)
    s = F.lit(0.0)
    for _, rx, w in MARKERS:
        s = s + F.when(F.coalesce(_found(low, rx), F.lit(False)), F.lit(w)).otherwise(F.lit(0.0))
    return s


def marker_list(text: Column, lowered: bool = False) -> Column:
    low = text if lowered else F.lower(text)
    return F.filter(F.array(*[F.when(_found(low, rx), F.lit(name)) for name, rx, _ in MARKERS]),
                    lambda x: x.isNotNull())


def rule_label(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    keep = keep or []
    low = df.select(*keep, F.lower(text_col).alias("__low"))
    scored = low.select(*keep, F.round(marker_score(F.col("__low"), lowered=True), 6).alias("score"))
    return scored.select(*keep, "score", F.when(F.col("score") >= RULE_THRESHOLD, "yes").otherwise("no").alias("label"))


def rule_scorer(texts: pd.Series) -> pd.Series:
    """Python twin of the rule annotator for the scoring callback (per batch, small helper)."""
    import regex
    pats = [(regex.compile(rx), w) for _, rx, w in MARKERS]

    def one(t):
        if t is None:
            return None
        low = t.lower()
        s = sum(w for p, w in pats if p.search(low))
        lab = "yes" if round(s, 6) >= RULE_THRESHOLD else "no"
        conf = "high" if abs(s - RULE_THRESHOLD) >= 0.2 else "low"
        return f'{{"label": "{lab}", "confidence": "{conf}"}}'

    return texts.map(one)


# ---------------------------------------------------------------- A2
def attach_results(requests: DataFrame, results: DataFrame, key: str | list[str] = "request_id",
                   order_col: str = "arrival") -> DataFrame:
    """Left-join parsed results onto requests; duplicates -> last arrival wins;
    unmatched -> ('missing', 'unknown'); non-succeeded -> ('error', 'unknown')."""
    key = [key] if isinstance(key, str) else key
    last = results.groupBy(*key).agg(
        F.max_by(F.struct("result_type", "label", "confidence"), order_col).alias("r"))
    j = requests.join(grows(last), key, "left")
    ok = F.col("r.result_type") == "succeeded"
    return j.select(
        *requests.columns,
        F.when(F.col("r").isNull(), F.lit("missing")).when(ok, F.col("r.label")).otherwise(F.lit("error")).alias("label"),
        F.when(F.col("r").isNull(), F.lit("unknown")).when(ok, F.col("r.confidence")).otherwise(F.lit("unknown")).alias("confidence"))


# ---------------------------------------------------------------- A3 / A4
def pending(todo: DataFrame, done: DataFrame, keys: list[str], label_col: str | None = "label") -> DataFrame:
    """Rows of `todo` without a usable (non-null, non-blank) label in `done` (anti-join on keys).

    With label_col=None every row of `done` counts as completed (whole files / conditions).
    """
    ok = done
    if label_col is not None:
        ok = done.where(F.col(label_col).isNotNull() &
                        (F.regexp_replace(F.col(label_col), f"^{WS}+|{WS}+$", "") != ""))
    return todo.join(grows(ok.select(*keys)), keys, "left_anti")


# ---------------------------------------------------------------- A6 / A7
def price_table(spark) -> DataFrame:
    return spark.createDataFrame([(m, pi, po) for m, (pi, po) in PRICES.items()],
                                 "model string, price_in double, price_out double")


def cost_rollup(log: DataFrame, prices: DataFrame, total_units: int) -> DataFrame:
    """Tokens and cost per model, batch price, and extrapolation to a corpus of so many units.

    A model without a price keeps its row; its costs are NULL.
    """
    agg = log.groupBy("model").agg(
        F.count(F.lit(1)).alias("processed"),
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    j = agg.join(F.broadcast(prices), "model", "left")  # price table: one row per model
    cost = (F.col("tokens_in").cast("double") / 1e6 * F.col("price_in")
            + F.col("tokens_out").cast("double") / 1e6 * F.col("price_out"))
    return j.select("model", "processed", "tokens_in", "tokens_out",
                    F.round(cost, 6).alias("cost"), F.round(cost * BATCH_DISCOUNT, 6).alias("cost_batch"),
                    F.round(cost / F.col("processed").cast("double") * total_units, 6).alias("cost_full_corpus"))


def progress(log: DataFrame, total: int) -> DataFrame:
    """Processed / failed / rate / remaining / ETA per model from the job log."""
    agg = log.groupBy("model").agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(F.col("status") == "error").alias("failed"),
        ((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).cast("double") / 1e6).alias("elapsed_s"))
    rate = F.try_divide(F.col("processed").cast("double"), F.col("elapsed_s"))
    remaining = F.greatest(F.lit(total) - F.col("processed"), F.lit(0))
    return agg.select(
        "model", "processed", "failed", F.round("elapsed_s", 6).alias("elapsed_s"),
        F.round(F.col("processed").cast("double") * 100 / total, 6).alias("pct"),
        F.round(rate * 60, 6).alias("rate_per_min"),
        F.round(F.try_divide(F.col("elapsed_s"), F.col("processed").cast("double")), 6).alias("sec_per_block"),
        remaining.alias("remaining"),
        F.round(F.try_divide(remaining.cast("double"), rate), 6).alias("eta_s"))


def hourly_throughput(log: DataFrame) -> DataFrame:
    return (log.groupBy("model", F.date_trunc("hour", "ts").alias("hour"))
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "error").alias("failed")))


# the scorer travels with the job, so workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
