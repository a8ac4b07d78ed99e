"""Hashes of runs: equal for equal words only, also for the words on which polynomial hashes collide."""

import numpy as np

from annospark.llm import minhash, substrings
from annospark.llm.wordhash import Runs, WordHashes


def thue_morse(n, zero="a", one="b"):
    return "".join(one if bin(i).count("1") % 2 else zero for i in range(n))


def test_runs_are_named_by_their_words():
    rng = np.random.default_rng(4)
    words = [b"w%d" % i for i in rng.integers(0, 3, 4000)]
    runs = Runs(WordHashes().of(words))
    for k in (1, 2, 3, 5, 10, 35):
        named = {}
        for at, h in enumerate(runs.of(k).tolist()):
            assert named.setdefault(tuple(words[at:at + k]), h) == h
        assert len(runs.of(k)) == 4000 - k + 1 and len(set(named.values())) == len(named)


def test_one_word_texts_on_which_polynomials_collide(spark):
    a, b = thue_morse(2048), thue_morse(2048, "b", "a")
    rows = [(1, a), (2, b), (3, a.upper())]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 1}
    tail = " ".join(f"t{i}" for i in range(34))
    long = spark.createDataFrame([(1, f"{a} {tail}"), (2, f"{b} {tail}")], "doc_id long, text string")
    assert [r.n_removed for r in substrings.remove_repeats(long).collect()] == [0, 0]
    letters = [" ".join(thue_morse(4096, x, y)) for x, y in (("a", "b"), ("b", "a"))]
    assert not set(minhash.shingle_hashes(letters[0], 4096).tolist()) & set(minhash.shingle_hashes(letters[1], 4096).tolist())
