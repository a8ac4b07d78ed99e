"""The pipeline's stages, each held against a brute-force version on its own input."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from annospark.llm.common import stored
from test_minhash import brute as brute_groups
from test_substrings import brute as brute_repeats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(-1, None, None, None, None), (-2, "12 % 34", "en", "src0", 7), (-3, "", "en", None, 0),
                                   (None, "the and of thing", "en", "src1", 16), (0, "", None, None, None)],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    again = docs.where("doc_id < 3")
    out = [stored(docs.unionByName(extra).unionByName(again).withColumn("score", F.lit("clash")).repartition(3))]
    for _, stage in pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF)))
    return [r.collect() for r in out]


def test_columns(results):
    assert [name for name, _ in pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "mix", "bpe"]
    for rows in results[1:-1]:
        assert tuple(rows[0].asDict()) == pipeline.COLUMNS


def test_language_id_drops_only_texts_without_letters(results):
    gone = sorted(set(map(str, [r.text for r in results[0]])) - set(map(str, [r.text for r in results[1]])))
    assert gone == ["", "12 % 34", "None"]


def test_near_dedup(results):
    rows = {r.doc_id: r.text for r in results[1] if r.doc_id is not None}
    kept = sorted(i for i, (_, c) in brute_groups(list(rows.items()), 5, 80).items() if c == i)
    assert sorted(r.doc_id for r in results[2] if r.doc_id is not None) == kept
    assert sum(r.doc_id is None for r in results[2]) == 1


def test_substring_dedup(results):
    want = {(i, n): t for i, t, n, _ in brute_repeats([(r.doc_id, r.text) for r in results[2]], 35)}
    before = {r.doc_id: r.text for r in results[2]}
    for r in results[3]:
        assert " ".join(r.text.split()) == want[r.doc_id, len(before[r.doc_id].split())] and r.n_chars == len(r.text)


def test_mix_takes_about_all_words(results):
    size = lambda rows: sum(len(r.text.split()) for r in rows)
    assert 0.9 * size(results[3]) <= size(results[4]) <= size(results[3])


def test_tokens(results):
    texts = sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in results[4])
    assert sorted(r.decoded_sha256 for r in results[5]) == texts
    assert all(r.n_tokens == len(r.ids) for r in results[5])


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []


def test_near_dedup_judges_rows_of_null_and_repeated_ids(spark):
    words = lambda k: [f"{k}{i}" for i in range(60)]
    text = lambda k, end="": " ".join(words(k) + [end] * bool(end))
    rows = [(None, text("a")), (None, text("a", "x")),                   # near copies without an id: one stays
            (5, text("b")), (5, text("b", "x")),                         # near copies under one id: one stays
            (1, text("c")), (7, text("c", "x")), (7, text("d")),         # 7's copy of 1 goes, its other text stays
            (None, text("e")), (9, text("e", "x"))]                      # the row with an id stays
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.near_dedup(spark, docs, SF).collect()
    assert sorted((str(r.doc_id), r.text.split()[0]) for r in got) == [("1", "c0"), ("5", "b0"), ("7", "d0"), ("9", "e0"), ("None", "a0")]
