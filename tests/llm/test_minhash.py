"""Near duplicates against brute force, signature properties, defined cases."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from annospark.llm import minhash
from annospark.llm.graph import components


def brute(rows, words, percent):
    """doc_id -> (n, component) by comparing all pairs of word-shingle sets."""
    sets_ = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets_[i] = {tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    comp = {i: i for i in sets_}
    changed = True
    while changed:
        changed = False
        for a in sets_:
            for b in sets_:
                both = len(sets_[a] & sets_[b])
                if sets_[a] and sets_[b] and 100 * both >= percent * (len(sets_[a]) + len(sets_[b]) - both) and comp[b] < comp[a]:
                    comp[a], changed = comp[b], True
    return {i: (len(sets_[i]), comp[i]) for i in sets_}


def near_copies(rng, base, n, edits):
    out = []
    for k in range(n):
        words = list(base)
        for at in rng.choice(len(base), edits, replace=False):
            words[at] = f"x{k}y{at}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_against_brute_force(spark, words, percent):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 500, 90)]
    texts = (near_copies(rng, base, 40, 4) + near_copies(rng, base, 20, 2) + near_copies(rng, base, 10, 1)
             + ["", None, " \t\n", "One", "one", "one two", "A b c d e f g", "a B c d e f g", "a b c d e f g h"]
             + [" ".join(f"q{i}" for i in rng.integers(0, 80, 30)) for _ in range(40)] + ["İ a é", "İ a É", "x y z"])
    rows = list(enumerate(texts)) + [(500, texts[0]), (501, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash")).withColumn("bucket", F.lit(1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, words=words, percent=percent).collect()}
    assert got == brute(rows, words, percent)


def test_blocks_of_a_crowd(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 7)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(80)]
    rows = list(enumerate(near_copies(rng, base, 30, 4) + near_copies(rng, base, 30, 2)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect()}
    assert got == brute(rows, 3, 85)


def test_crowd_counts_are_exact():
    rng = np.random.default_rng(1)
    common = np.arange(60, dtype=np.int64)
    sets_ = [np.unique(np.concatenate([rng.choice(common, 55, replace=False), rng.integers(100, 130, 5)])) for _ in range(60)]
    a, b = minhash.same_crowd_links(np.arange(60), np.arange(60), sets_, 85)
    parent = list(range(60))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(60):
        for j in range(i):
            s = len(np.intersect1d(sets_[i], sets_[j]))
            if 100 * s >= 85 * (len(sets_[i]) + len(sets_[j]) - s):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    want = {i: root(i) for i in range(60)}
    assert {i: want[i] for i in range(60) if want[i] != i} == dict(zip(b.tolist(), a.tolist()))


def test_null_ids_repeats_long_and_empty(spark):
    long_text = " ".join(f"l{i}" for i in range(60_000))
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, long_text), (3, long_text + " end")],
                               "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, None, True)] * 2 + [(1, 1, True)] * 2 + [(2, 2, True), (3, 2, False)], key=str)
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_components_chain_and_cycle(spark):
    links = [(i, i + 1) for i in range(10, 60)] + [(100, 101), (101, 102), (102, 100), (5, 5), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 10 for i in range(10, 61)}, **{i: 100 for i in (100, 101, 102)}}


def test_signature_agrees_with_similarity():
    rng = np.random.default_rng(0)
    agree = []
    for _ in range(60):
        pool = rng.integers(0, 1 << 63, 260).astype(np.uint64)
        x, y = np.sort(pool[:230]), np.sort(pool[30:])          # 200 of 260 in common
        agree.append(np.mean(minhash.signature(x) == minhash.signature(y)))
    assert abs(np.mean(agree) - 200 / 260) < 0.03
