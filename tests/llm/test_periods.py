"""Periodic runs against every lag compared word by word, and the query's digests against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from annospark.llm import periods


def brute(words, least):
    """All stretches of matches at all lags, the smallest lag of each."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                best.setdefault((i, j + q), q)
            i = max(j, i + 1) if j > i else i + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def sequences():
    draw = random.Random(3)
    for k in range(700):
        letters = draw.choice([1, 2, 2, 3, 4, 30])
        w = [draw.randrange(letters) for _ in range(draw.randrange(0, 130))]
        for _ in range(draw.randrange(0, 4)):      # repeats inside repeats
            a = draw.randrange(0, len(w) + 1)
            block = w[a:a + draw.randrange(1, 20)] * draw.randrange(1, 7)
            w[a:a] = block + block[:draw.randrange(0, 5)]
        yield w[:400]
    yield [0] * 300
    yield [0, 1] * 60 + [0] + [0, 1] * 70                      # one junction, many lags
    yield ([0, 1, 2] * 20 + [0]) * 6
    yield ([0, 1] * 30 + [2]) * 5 + [0, 1] * 9
    a, b = [0], [0, 1]                                          # Fibonacci words: as many runs as can be
    while len(b) < 380:
        a, b = b, b + a
    yield b
    yield [bin(i).count("1") % 2 for i in range(400)]           # Thue and Morse
    yield ([0] * 15 + [1]) * 12 + [0] * 40


@pytest.mark.parametrize("least", [2, 5, 12, 20])
def test_all_runs(least):
    for w in sequences():
        assert periods.runs_of(np.array(w, dtype=np.int64), least) == brute(w, least), w


def test_long_periodic_words_stay_linear():
    n = 200_000
    assert periods.runs_of(np.zeros(n, np.int64)) == [(0, n, 1)]
    line = np.arange(9, dtype=np.int64)
    assert periods.runs_of(np.tile(line, n // 9)) == [(0, n // 9 * 9, 9)]
    found = periods.runs_of(np.concatenate([np.tile([0, 1], 50_000), [0], np.tile([0, 1], 50_000)]))
    assert found[0] == (0, 100_001, 2) and len(found) > 1000
    mixed = np.tile(np.concatenate([np.zeros(40, np.int64), [1], np.zeros(17, np.int64), [2]]), 3000)
    assert (0, len(mixed), 59) in periods.runs_of(mixed)


def edited(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def expected(doc_id, text):
    words = edited(doc_id, text)
    runs = brute(words, 12)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *((top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4),
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_digests_of_edited_texts(spark):
    draw = random.Random(9)
    rows = [(i, " ".join(draw.choice(["é", "b", "c d", "e", "f.", "🙂"]) for _ in range(draw.randrange(0, 60)))) for i in range(-20, 280)]
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "la " * 500), (None, "x y " * 20), (None, None), (5, "same row"), (5, "same row")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("__words", F.lit("clash"))
    got = periods.digests(periods.periodic_runs(periods.with_planted_tails(df)))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted((expected(*r) for r in rows), key=str)
    assert periods.digests(periods.periodic_runs(df.limit(0))).collect() == []


def test_planted_tails_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: tuple(r) for r in periods.digests(periods.periodic_runs(periods.with_planted_tails(docs))).collect()}
    few = [tuple(r) for r in docs.where("length(text) < 6000").select("doc_id", "text").collect()]
    assert len(few) > 100 and all(got[i] == expected(i, t) for i, t in few)
