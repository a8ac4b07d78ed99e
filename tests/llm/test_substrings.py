"""Repeated passages against brute force, also with groups too large for one task."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from annospark.llm import substrings


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    starts = Counter(tuple(w[k:k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - window + 1):
            if starts[tuple(w[k:k + window])] > 1:
                gone |= set(range(k, k + window))
        out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)))
    return sorted(out, key=str)


def corpus():
    rng = np.random.default_rng(7)

    def word(n):
        return [f"v{i}" for i in rng.integers(0, 3000, n)]
    shared, line = word(60), word(36)
    rows = [(i, " ".join(word(30) + shared + word(25))) for i in range(12)]
    rows += [(20 + i, "  ".join(word(5) + line + word(3) + shared[10:50])) for i in range(9)]
    rows += [(40, " ".join(shared[:34])), (41, " ".join(shared[:34])), (42, " ".join(line[:35])), (43, ""), (44, None), (45, "one\ttwo\n"),
             (46, " ".join(["ha"] * 200)), (47, " ".join(word(20) * 6)), (48, "É é " * 50), (49, " ".join(word(4000)))]
    return rows + [(50, rows[0][1]), (50, rows[0][1]), (None, rows[1][1]), (51, " ".join(word(80)))] + [(52, " ".join(word(80)))] * 2


@pytest.mark.parametrize("group_rows", [20_000, 4])
def test_against_brute_force(spark, monkeypatch, group_rows):
    monkeypatch.setattr(substrings, "GROUP_ROWS", group_rows)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("places", F.lit("clash")).withColumn("run", F.lit(1))
    got = sorted((tuple(r) for r in substrings.remove_repeats(df).collect()), key=str)
    assert got == brute(rows, 35)


def test_unchanged_texts_and_carried_columns(spark):
    df = spark.createDataFrame([(1, " a  b ", "x"), (2, None, "y")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.text, r.lang) for r in substrings.remove_repeats(df, carry=("lang",), keep_unchanged=True).collect()}
    assert got == {1: (" a  b ", "x"), 2: (None, "y")}
    assert substrings.remove_repeats(df.limit(0)).collect() == []
