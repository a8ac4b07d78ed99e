"""Repeated passages: fingerprints of word windows, grouped by a run inside them.

A window is `window` consecutive words.  A word goes if a window that covers it
begins with the same word sequence at another place of the corpus as well.  This
takes the place of prefix-partitioned suffix trees: a repeat of `window` words or more is all
that is asked for, so suffixes are cut at that depth and compared as fingerprints; they
are not ordered by their words, and maximal repeats are not listed.

1. Runs.  Of the PREFIX-word runs inside a window the one with the smallest hash
   names the window's group, so equal windows are in one group and
   a document has one such run for about every twelve words.  Runs that occur
   once in the corpus cannot begin a repeat; their windows are dropped here.
2. Groups.  The windows of the other runs are dealt by their run, each as the
   64-bit fingerprint of its words.  A group of more than GROUP_ROWS rows is
   too large for one task's memory, so it is dealt further, by the whole window:
   such windows are counted by it with partial sums, and no task gathers them.
3. The other groups are sorted by fingerprint; equal neighbours mark their places.
4. Places come back to their documents as arrays, and the words they cover go.

Fingerprints are made of the words' xxh3 hashes (see wordhash).  Two different windows of a
group of n, which share their run's hash already, have one fingerprint with probability below n^2 / 2^65.

Texts are shuffled twice, to meet their candidate runs and their places; windows
are shuffled as fingerprints, and only those of repeated runs.

Defined cases: a null or empty text has no words and keeps the empty text; texts
shorter than a window lose nothing; repeated rows lose all their windows, as each
starts at two places; null ids are an id like any other; an empty table gives an
empty result.  Only the named columns and those to carry are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annospark.llm.common import bounded, shipped, stored, worker_state
from annospark.llm.wordhash import Runs, WordHashes

PREFIX = 10
GROUP_ROWS = 20_000


class Words:
    """The words of a text, and fingerprints of the runs of them."""

    def __init__(self, text: str | None):
        self.parts = (text or "").encode().split()
        self.n = len(self.parts)
        self.hashes = None

    def runs(self, words: int) -> np.ndarray:
        """Fingerprints of all runs of so many words."""
        if self.hashes is None:
            self.hashes = Runs(worker_state("words").setdefault("plain", WordHashes()).of(self.parts))
        return self.hashes.of(words)

    def prefixes(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Of every window the fingerprint of its group's run, and the run's place."""
        runs = self.runs(PREFIX)
        width = window - PREFIX + 1
        at = np.lib.stride_tricks.sliding_window_view(runs, width).argmin(axis=1) + np.arange(len(runs) - width + 1)
        return runs[at], at


def covered(n: int, places: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie in windows that start at these places."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, places, 1)
    np.add.at(steps, places + window, -1)
    return np.cumsum(steps)[:n] > 0


def candidate_runs(docs: DataFrame, window: int) -> DataFrame:
    """(row_key, text) -> one row per run that is some window's smallest: run, row_key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            keys, runs = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = Words(text)
                if w.n >= window:
                    names, at = w.prefixes(window)
                    names = names[np.concatenate([[True], at[1:] != at[:-1]])]
                    runs.append(names)
                    keys.append(np.full(len(names), key, dtype=np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(runs).view(np.int64)), pa.array(np.concatenate(keys))],
                                                 names=["run", "row_key"])

    return docs.mapInArrow(run, "run long, row_key long")


def windows_of(docs: DataFrame, window: int) -> DataFrame:
    """(row_key, text, runs) -> run, large, row_key, first, prints: the consecutive windows whose group is one of the runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            out: list[tuple] = []
            for key, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                w = Words(text)
                names, at = w.prefixes(window)
                prints = w.runs(window).view(np.int64)
                asked = wanted.values.field(0).to_numpy().view(np.uint64)
                large = set(asked[wanted.values.field(1).to_numpy(zero_copy_only=False)].tolist())
                keep = np.isin(names, asked)
                turn = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                for a, b in zip(turn.tolist(), [*turn[1:].tolist(), len(at)]):
                    if keep[a]:
                        out.append((int(names[a].view(np.int64)), int(names[a]) in large, key, a, prints[a:b]))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.bool_()), pa.array([o[2] for o in out], pa.int64()),
                     pa.array([o[3] for o in out], pa.int32()), pa.array([o[4] for o in out], pa.list_(pa.int64()))],
                    names=["run", "large", "row_key", "first", "prints"])

    return docs.mapInArrow(run, "run long, large boolean, row_key long, first int, prints array<long>")


def repeated_in_groups(rows: DataFrame) -> DataFrame:
    """Sorted rows of whole groups -> row_key, place: the windows whose fingerprint another window of the group has."""
    def repeated(prints, keys, places):
        order = np.argsort(prints, kind="stable")
        same = prints[order][1:] == prints[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        return keys[order][twice], places[order][twice]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        held_run = None

        def close():
            prints = np.concatenate([h[2] for h in held])
            keys = np.concatenate([np.full(len(h[2]), h[0], np.int64) for h in held])
            places = np.concatenate([np.arange(h[1], h[1] + len(h[2]), dtype=np.int32) for h in held])
            k, p = repeated(prints, keys, places)
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(p)], names=["row_key", "place"])

        for batch in batches:
            made = []
            runs = batch.column(0).to_pylist()
            keys, firsts, prints = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
            for i, r in enumerate(runs):
                if r != held_run and held:
                    made.append(close())
                    held = []
                held_run = r
                held.append((keys[i], firsts[i], prints[i].values.to_numpy()))
            yield from made
        if held:
            yield close()

    return rows.mapInArrow(run, "row_key long, place int")


def repeated_places(docs: DataFrame, window: int) -> DataFrame:
    """(row_key, text) -> row_key, places array<int>: the windows that start elsewhere too."""
    runs = stored(candidate_runs(docs, window))
    # stored, so that the join below deals both sides itself and Spark can split a run with very many rows
    often = stored(runs.groupBy("run").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.col("run").alias("o_run"), (F.col("n") > GROUP_ROWS).alias("large")))
    mine = (runs.join(often, F.col("run") == F.col("o_run")).groupBy(F.col("row_key").alias("m_key"))
            .agg(F.collect_set(F.struct("run", "large")).alias("runs")))
    wide = stored(windows_of(docs.join(mine, F.col("row_key") == F.col("m_key")).select("row_key", "text", "runs"), window))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = wide.where("not large").select("run", "row_key", "first", "prints")
    grouped = repeated_in_groups(small.repartition(parts, "run").sortWithinPartitions("run"))
    dealt = (wide.where("large").select("row_key", "first", F.posexplode("prints").alias("i", "print"))
            .select("row_key", (F.col("first") + F.col("i")).alias("place"), "print"))
    twice = dealt.groupBy(F.col("print").alias("t_print")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t_print")
    counted = dealt.join(twice, F.col("print") == F.col("t_print")).select("row_key", "place")
    return grouped.unionByName(counted).groupBy("row_key").agg(F.collect_list("place").alias("places"))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 35, carry: tuple[str, ...] = (),
                   keep_unchanged: bool = False) -> DataFrame:
    """The id, the text without its repeated words, the columns to `carry`, n_words and n_removed.

    The kept words are joined by one space; with `keep_unchanged` a text that loses nothing stays as it is.
    """
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))        # equal rows share it, and so their places
    base = docs.select(key.alias("row_key"), F.col(text_col).alias("text"))
    places = repeated_places(base, window).select(F.col("row_key").alias("p_key"), "places")
    names = [id_col, text_col, *carry]
    whole = docs.select(key.alias("__key"), *[F.col(c) for c in names])
    joined = whole.join(places, F.col("__key") == F.col("p_key"), "left").select(*names, "places")
    at = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            texts, n_words, n_removed = [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(at)):
                parts = (text or "").encode().split()
                gone = covered(len(parts), found.values.to_numpy(), window) if found.is_valid else np.zeros(len(parts), bool)
                lost = int(gone.sum())
                kept = parts if not lost else [p for p, g in zip(parts, gone.tolist()) if not g]
                texts.append(text if keep_unchanged and not lost else b" ".join(kept).decode())
                n_words.append(len(parts))
                n_removed.append(lost)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), *(batch.column(i) for i in range(2, at)),
                 pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=[*names, "n_words", "n_removed"])

    kinds = dict(joined.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c] if c != text_col else 'string'}" for c in names)
    return joined.mapInArrow(run, schema + ", n_words long, n_removed long")


def oracle(table: str = "documents", window: int = 35) -> str:
    return f"""
WITH w AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM {table}),
s AS (SELECT rid, unnest(range(1, len(words) - {window} + 2)) AS pos, words FROM w WHERE len(words) >= {window}),
f AS (SELECT rid, pos, md5(array_to_string(list_slice(words, pos, pos + {window - 1}), ' ')) AS print FROM s),
t AS (SELECT rid, pos FROM f QUALIFY count(*) OVER (PARTITION BY print) > 1),
gone AS (SELECT DISTINCT rid, unnest(range(pos, pos + {window})) AS i FROM t),
word AS (SELECT rid, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, (len(w.words) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (rid)"""


shipped(__name__)
