"""Document fingerprints: quartile bucket digests.

All byte triplets of a text (three patterns in a sliding window of five bytes)
are hashed into BUCKETS counters.  The three quartiles of the counters turn
each counter into two bits; the digest is these bits in hex, led by the code of
the text's length on a logarithmic scale and the code of its spread.  Two digests
differ by the sum of their buckets' two-bit distances (an extreme pair counts
DIFF_EXTREME) plus a bounded length term; likeness is one minus the difference
over its greatest value, so it lies between 0 and 1 and equal texts have 1.

The neighbour of a document in descending id order: Spark deals the rows into
ranges of (id, hash of the text, a number of the row), so that one id or one row with very many
copies takes several ranges; each range is sorted and judged in its task.  The first
and the last row of every range are kept with their texts, and a second, small step
judges each last row with the first row of the next range.

Defined cases: null texts are empty and have the digest of no bytes; a text of
fewer than three bytes has only its length; null ids come last, ties are ordered
by a hash of the text; repeated rows are separate documents, next to each other; the only row of a table is its
own neighbour; an empty table gives an empty result.  Only the named columns are
read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annospark.llm.common import bounded, shipped, stored, worker_state

BUCKETS = 128
DIFF_EXTREME = 6                                  # of the lowest and the highest quartile
LENGTH_TERM = 12                                  # the length's part of the difference is at most this
DIFFERENCE = np.array([[0, 1, 2, DIFF_EXTREME], [1, 0, 1, 2], [2, 1, 0, 1], [DIFF_EXTREME, 2, 1, 0]])
GREATEST = BUCKETS * DIFF_EXTREME + LENGTH_TERM
RANGE_ROWS = 256                                  # a range has about so many rows at least
ARROW_TYPES = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
PATTERNS = ((0, 1, 2), (0, 1, 3), (0, 2, 4))


def counts(data: bytes) -> np.ndarray:
    """How often each bucket is hit by the triplets of the bytes."""
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    out = np.zeros(BUCKETS, dtype=np.int64)
    for k, (i, j, m) in enumerate(PATTERNS):
        n = len(b) - m
        if n > 0:
            h = (b[i:i + n] | b[j:j + n] << np.uint32(8) | b[m:m + n] << np.uint32(16)) + np.uint32((k + 1) << 24)
            h = h * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA77)
            out += np.bincount(h >> np.uint32(25), minlength=BUCKETS)
    return out


def fingerprint(data: bytes) -> str:
    """Hex: two digits of length, two of spread, then two bits a bucket."""
    n = counts(data)
    q1, q2, q3 = np.partition(n, (BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1))[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    level = (n > q1).astype(np.uint8) + (n > q2) + (n > q3)
    length = min(255, int(round(8 * math.log2(len(data) + 1))))
    spread = min(15, 16 * int(q1) // max(1, int(q3))) * 16 + min(15, 16 * int(q2) // max(1, int(q3)))
    packed = np.packbits(np.stack([level >> 1, level & 1], axis=1).ravel())
    return f"{length:02x}{spread:02x}" + packed.tobytes().hex()


def levels(print_: str) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(bytes.fromhex(print_[4:]), dtype=np.uint8)).reshape(-1, 2)
    return bits[:, 0] * 2 + bits[:, 1]


def likeness(a: str, b: str) -> float:
    """1 of equal digests, 0 of the greatest difference."""
    if a == b:
        return 1.0
    apart = int(DIFFERENCE[levels(a), levels(b)].sum())
    length = min(LENGTH_TERM, abs(int(a[:2], 16) - int(b[:2], 16)) // 2)
    return 1.0 - (apart + length) / GREATEST


def half_swapped(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as many first code points of the following one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def with_following(docs: DataFrame, judge: Callable[[str, str], tuple], fields: list[tuple[str, str]], *, id_col: str, text_col: str) -> DataFrame:
    """doc_id and what judge(text, next text) gives, as the `fields` (name, type), of every row in descending id order."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"),
                       F.xxhash64(F.monotonically_increasing_id()).alias("copy"))
    ranges = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // RANGE_ROWS)))
    keys = [F.col("id").desc_nulls_last(), "tie", "copy"]
    ordered = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    names = ["doc_id", *(n for n, _ in fields)]
    kinds = [pa.int64(), *(ARROW_TYPES[k] for _, k in fields)]
    schema = "doc_id long, " + ", ".join(f"{n} {k}" for n, k in fields)

    def batch_of(out: list[tuple], edges: list[tuple]) -> pa.RecordBatch:
        """Judged rows, then the first or last row of a range (edge 1 or 2) with its text."""
        cells = [*out, *((i, *[None] * len(fields)) for _, _, i, _ in edges)]
        arrays = [pa.array(list(c), kind) for c, kind in zip(zip(*cells), kinds)]
        more = [(0, None, None)] * len(out) + [(e, part, t) for e, part, _, t in edges]
        return pa.RecordBatch.from_arrays([*arrays, *(pa.array(list(c), kind) for c, kind in zip(zip(*more), (pa.int32(), pa.int32(), pa.string())))],
                                          names=[*names, "edge", "part", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        for batch in bounded(batches):
            out, edges = [], []
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held is None:
                    edges.append((1, part, *row))
                else:
                    out.append((held[0], *judge(held[1], row[1])))
                held = row
            if out or edges:
                yield batch_of(out, edges)
        if held is not None:
            yield batch_of([], [(2, part, *held)])

    made = stored(ordered.mapInArrow(run, f"{schema}, edge int, part int, text string"))
    # at most two rows a range: the last row of each range is followed by the first of the next one, the very last by the very first
    first = made.where("edge = 1").select(F.col("part").alias("f_part"), F.col("text").alias("following"))
    after = Window.orderBy("f_part")
    order = first.select("f_part", F.coalesce(F.lead("f_part").over(after), F.first("f_part").over(after)).alias("to"))
    pairs = (made.where("edge = 2").select("doc_id", "part", "text").join(order, F.col("part") == F.col("f_part")).drop("f_part")
             .join(first, F.col("to") == F.col("f_part")).select("doc_id", "text", "following"))

    def run_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            out = [(i, *judge(t, following)) for i, t, following in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*out), kinds)], names=names)

    return made.where("edge = 0").select(*names).unionByName(pairs.mapInArrow(run_pairs, schema))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every text, without looking at neighbours."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            prints = [fingerprint((t or "").encode()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], names=[id_col, "fingerprint"])

    small = docs.select(F.col(id_col), F.col(text_col))
    return small.mapInArrow(run, f"`{id_col}` {dict(small.dtypes)[id_col]}, fingerprint string")


def edited_neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    def judge(text: str, following: str) -> tuple:
        known = worker_state("digest")            # the next row's digest is the following row's own
        if known.get("text") != text:
            known["print"] = fingerprint(text.encode())
        own, edited = known["print"], half_swapped(text, following).encode()
        changed = fingerprint(edited)
        known["text"], known["print"] = following, fingerprint(following.encode())
        return len(text), hashlib.sha256(edited).hexdigest(), own, changed, likeness(own, changed), likeness(own, known["print"])

    fields = [("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"),
              ("near_edited", "double"), ("near_next", "double")]
    return with_following(docs, judge, fields, id_col=id_col, text_col=text_col)


shipped(__name__)
