"""Periodic runs: seed and extend along diagonals.

A run is a stretch of consecutive words with smallest period q, at least
max(`least`, 2 q) words long, that no neighbouring word extends keeping the
period.  Words q apart are equal all through it, so on the diagonal of lag q it
is a stretch of matches, max(least - q, q) of them or more: the minimum overlap.

1. Index.  The h-grams of a document are numbered exactly (pairs of numbers of
   shorter grams, no hashes); a gram that occurs once is out, and so are all
   longer ones on it.  Seeds of h = least / 2 words serve the lags below 2 h, and
   the doubled lengths h, 2 h, 4 h, ... the lags from 2 h to 4 h.
2. Pairs.  Occurrences of the same gram of the same document whose lag is the
   level's are enumerated, neighbours first.  A gram that meets itself within
   h / 2 words is periodic; it is left out above the first level, so a gram has at most
   eight partners in reach and a document of n words O(n) pairs a level.
3. Extension.  A pair's diagonal is compared word by word both ways.  Per lag a
   table keeps the furthest word covered, and pairs inside it are not extended again.
4. Junctions.  A stretch whose seeds were all left out is periodic itself, and so
   are its two ends: it lies where a run of a smaller period p touches the next
   run of that period.  For each two such runs the possible lags follow from their places
   and phases, so these runs are found from runs, not from pairs.

Of stretches at several lags that cover the same words the smallest lag is the period.
Words that a run repeats (all after its first q) are dropped from the collapsed text.

Documents are judged row by row where they are; nothing is shuffled.

Defined cases: a null or empty text has no words, no runs and collapses to the empty
text; null ids and repeated rows are judged row by row; an empty table gives an empty
result.  Only the named columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annospark.llm.common import WORD, bounded, shipped

LEAST = 12


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))


def longer(grams: np.ndarray, shift: int) -> np.ndarray:
    """Numbers of the grams made of one gram and the one `shift` words on; -1 for those that occur once."""
    n = len(grams) - shift
    out = np.full(max(n, 0), -1, dtype=np.int64)
    if n <= 0:
        return out
    left, right = grams[:n], grams[shift:]
    alive = np.flatnonzero((left >= 0) & (right >= 0))
    _, name, count = np.unique(left[alive] * (int(grams.max()) + 1) + right[alive], return_inverse=True, return_counts=True)
    out[alive] = np.where(count[name] > 1, name, -1)
    return out


def grams_of(words: np.ndarray, length: int) -> np.ndarray:
    grams, size = words, 1
    while size < length:
        shift = min(size, length - size)
        grams, size = longer(grams, shift), size + shift
    return grams


def lagged_pairs(grams: np.ndarray, h: int, low: int, high: int, *, all_grams: bool) -> tuple[np.ndarray, np.ndarray]:
    """(first place, lag), by lag and place, of equal grams low <= lag < high apart."""
    places = np.flatnonzero(grams >= 0)
    places = places[np.argsort(grams[places], kind="stable")]
    names = grams[places]
    if not all_grams and len(names):
        close = (names[1:] == names[:-1]) & (2 * (places[1:] - places[:-1]) <= h)
        periodic = np.zeros(int(names.max()) + 1, bool)
        periodic[names[1:][close]] = True
        places, names = places[~periodic[names]], names[~periodic[names]]
    first, lag, step = [], [], 1
    while step < len(places):
        apart = places[step:] - places[:-step]
        near = (names[step:] == names[:-step]) & (apart < high)
        if not near.any():
            break
        near &= apart >= low
        first.append(places[:-step][near])
        lag.append(apart[near])
        step += 1
    if not first:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, lag = np.concatenate(first), np.concatenate(lag)
    order = np.lexsort((first, lag))
    return first[order], lag[order]


def matching(words: np.ndarray, place: int, lag: int) -> tuple[int, int]:
    """The widest stretch around `place` in which every word equals the one `lag` on."""
    end, limit, width = place, len(words) - lag, 16
    while end < limit:
        to = min(limit, end + width)
        wrong = np.flatnonzero(words[end:to] != words[end + lag:to + lag])
        if len(wrong):
            end += int(wrong[0])
            break
        end, width = to, 2 * width
    start, width = place, 16
    while start > 0:
        to = max(0, start - width)
        wrong = np.flatnonzero(words[to:start] != words[to + lag:start + lag])
        if len(wrong):
            start = to + int(wrong[-1]) + 1
            break
        start, width = to, 2 * width
    return start, end


class Runs:
    """The stretches found, by (start, end), with their smallest period."""

    def __init__(self, words: np.ndarray, least: int):
        self.words, self.least = words, least
        self.period: dict[tuple[int, int], int] = {}
        self.of_period: dict[int, list[tuple[int, int]]] = {}
        self.waiting: list[int] = []

    def add(self, start: int, end: int, lag: int) -> None:
        """The matches [start, end) at this lag."""
        span = (start, end + lag)
        if end + lag - start >= max(self.least, 2 * lag) and self.period.get(span, lag + 1) > lag:
            self.period[span] = lag
            if lag not in self.of_period:
                self.of_period[lag] = []
                heapq.heappush(self.waiting, lag)
            self.of_period[lag].append(span)

    def from_pairs(self, first: np.ndarray, lag: np.ndarray) -> None:
        """Extend each pair that lies beyond what its lag's extensions have covered."""
        head = np.ones(len(first), bool)           # the next place at the same lag is on the same stretch
        head[1:] = (lag[1:] != lag[:-1]) | (first[1:] != first[:-1] + 1)
        covered: dict[int, int] = {}
        for place, step in zip(first[head].tolist(), lag[head].tolist()):
            if place >= covered.get(step, 0):
                start, end = matching(self.words, place, step)
                covered[step] = end
                self.add(start, end, step)

    def from_junctions(self) -> None:
        """Runs whose two ends lie in touching runs of one smaller period, smallest periods first."""
        while self.waiting:
            p = heapq.heappop(self.waiting)
            spans = sorted(s for s in self.of_period[p] if self.period[s] == p)
            for (a, a_end), (b, b_end) in zip(spans, spans[1:]):
                if a_end >= b:
                    self.between(p, a, a_end, b, b_end)

    def between(self, p: int, a: int, a_end: int, b: int, b_end: int) -> None:
        words = self.words
        around, period = words[a:a + 2 * p - 1].tobytes(), words[b:b + p].tobytes()
        size = words.itemsize
        at = around.find(period)
        while at >= 0 and at % size:
            at = around.find(period, at + 1)
        if at < 0:                                 # not the same words turned
            return
        lags = np.arange((b - a - at // size) % p, (b_end - a) // 2 + 1, p)
        lags = lags[lags > p]
        start, end = np.maximum(a, b - lags), np.minimum(a_end, b_end - lags)
        whole = end - start >= lags
        for s, e, lag in zip(start[whole].tolist(), end[whole].tolist(), lags[whole].tolist()):
            open_left = s > 0 and words[s - 1] == words[s - 1 + lag]
            if open_left or (e + lag < len(words) and words[e] == words[e + lag]):
                s, e = matching(words, s, lag)
            self.add(s, e, lag)


def runs_of(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period."""
    n, h = len(words), max(1, (least + 1) // 2)
    if n < max(2, least):
        return []
    grams = grams_of(words, h)
    found = Runs(words, least)
    if (grams >= 0).any():
        found.from_pairs(*lagged_pairs(grams, h, 1, 2 * h, all_grams=True))
    while 4 * h <= n and (grams >= 0).any():       # a run at a lag from 2 h on has 4 h words
        found.from_pairs(*lagged_pairs(grams, h, 2 * h, 4 * h, all_grams=False))
        grams, h = longer(grams, h), 2 * h
    found.from_junctions()
    return sorted((s, e - s, p) for (s, e), p in found.period.items())


def repeated(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words some run repeats."""
    steps = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps)[:n] > 0


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """The id, the runs of at least `least` words (by start, then period) and the collapsed text of every row."""
    small = docs.select(F.col(id_col), F.col(text_col))
    names = [id_col, "runs", "collapsed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            found, kept = [], []
            for text in batch.column(1).to_pylist():
                words = (text or "").encode().split()
                runs = runs_of(numbered(words), least)
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                if runs:
                    words = [w for w, gone in zip(words, repeated(len(words), runs).tolist()) if not gone]
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(RUN)), pa.array(kept, pa.string())], names=names)

    return small.mapInArrow(run, f"`{id_col}` {dict(small.dtypes)[id_col]}, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), 1)


def with_planted_tails(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the text, where a tenth of the ids (by their checksum) get a tail that repeats itself."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"), g.alias("__g"),
                       F.when(F.coalesce(h % 10 == 0, F.lit(False)), words_of(F.col(text_col))).alias("__words"))
    n = F.size("__words").cast("bigint")
    a = F.col("__g") % n
    p = 1 + F.floor((n - a) / (3 + F.col("__g") % 8)).cast("bigint")
    # the period's words once, then each place picks from them
    placed = rows.withColumn("__a", F.when(n > 0, a)).withColumn("__p", F.when(n > 0, p)).withColumn("__n", n)
    tail = F.transform(F.sequence(F.col("__a"), F.col("__n") - 1),
                       lambda i: F.get("__words", (F.col("__a") + (i - F.col("__a")) % F.col("__p")).cast("int")))
    edited = F.concat(F.slice("__words", F.lit(1), F.col("__a").cast("int")), tail)
    return placed.select(F.col(id_col), F.when(F.col("__n") > 0, F.array_join(edited, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The rows of periodic_runs with the longest run and digests of all runs and of the collapsed text."""
    top = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("small"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    rows = found.select(F.col(id_col), "runs", "collapsed", top.alias("top"))
    return rows.select(
        F.col(id_col), F.size("runs").cast("bigint").alias("n_runs"), (-F.col("top.back")).alias("start"), F.col("top.length").alias("length"),
        (-F.col("top.small")).alias("period"), F.floor(1000 * F.col("top.length") / -F.col("top.small")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


shipped(__name__)
