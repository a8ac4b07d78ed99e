"""Fill-in-middle: wavelet ranks, cuts and forms against plain Python, round trips, odd texts."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from annospark.llm import infill


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k:k + 8], 16) for k in (0, 8, 16, 24))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def corpus():
    draw = random.Random(5)
    alphabet = "aZq é\n\t9<P>SM🙂́ſKſ_`{@["
    rows = [(i, "".join(draw.choice(alphabet) for _ in range(draw.randrange(0, 400)))) for i in range(400)]
    rows += [(1000 + i, t) for i, t in enumerate([None, "", "a", "<", "<P", "P><S", "<M>", "x" * 70_000, "é" * 70_000, "ab " * 50_000, "\u0000a\u0000"])]
    return rows + [(None, "one two"), (None, None), (7, "the same"), (7, "the same"), (-7, "minus one, two")]


def test_wavelet_ranks():
    symbols = np.random.default_rng(1).integers(0, 8, 1000).astype(np.uint8)
    matrix = infill.WaveletMatrix(symbols, 3)
    for end in (0, 1, 63, 64, 65, 500, 1000):
        assert [matrix.rank(s, end) for s in range(8)] == [int((symbols[:end] == s).sum()) for s in range(8)]


def test_against_plain_python_and_back(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("output", F.lit(1)).withColumn("form", F.lit("clash"))
    made = infill.fill_in_middle(df)
    expected = sorted((brute(*r) for r in rows), key=str)
    assert sorted((tuple(r) for r in made.collect()), key=str) == expected
    assert {r[2] for r in expected} == {"plain", "psm", "spm"}
    back = made.select("doc_id", infill.restored(F.col("output"), F.col("form")).alias("t"))
    assert sorted((tuple(r) for r in back.collect()), key=str) == sorted(((i, t or "") for i, t in rows), key=str)


def test_parameters_and_empty_table(spark):
    df = spark.createDataFrame([(i, "some words <P> here") for i in range(50)], "k string, body string")
    made = infill.fill_in_middle(df, id_col="k", text_col="body", plain_percent=0, spm_percent=100, sentinels=("[a]", "[b]", "[c]"))
    back = made.select(infill.restored(F.col("output"), F.col("form"), ("[a]", "[b]", "[c]")).alias("t"), "form").distinct().collect()
    assert [tuple(r) for r in back] == [("some words <P> here", "spm")]
    assert infill.fill_in_middle(df.limit(0), id_col="k", text_col="body").collect() == []
    with pytest.raises(ValueError):
        infill.fill_in_middle(df, id_col="k", text_col="body", sentinels=("<", "<S>", "<M>"))
