"""Answers and markers are found in one pass: patterns run once a text, answers are parsed once."""

import random

from pyspark.sql import functions as F

from annospark.operators import annotate as AN
from annospark.operators.metrics import markers_by_outcome


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _tables(spark, path):
    docs = [(i, f"Pensò {i}! Forse. oh", "w", "it") for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_rule_answers_lower_a_text_once(spark):
    df = spark.createDataFrame([("Oh! Forse…",), (None,), ("",)], "text string")
    out = AN.rule_answers(df)
    assert _plan(out).count("lower(") == 1
    assert [r.status for r in out.collect()] == ["ok", "error", "ok"]


def test_sought_words_are_those_of_the_plain_patterns(spark):
    rng = random.Random(5)
    words = [w for _, rx, _ in AN.MARKERS if rx.startswith(AN._B) for w in rx[len(AN._B):-len(AN._E)].split("|")]
    ends = ["", " ", ",", "x", "è", "\n", "\u0301", "9", "-", "…", "\U00020000"]
    texts = ["", *words, *("".join(rng.choice(ends) + rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(1, 2))) for _ in range(3000))]
    df = spark.createDataFrame([(t,) for t in texts], "low string")
    pairs = [(F.col("low").rlike(rx), AN._found(F.col("low"), rx)) for _, rx, _ in AN.MARKERS]
    bad = F.lit(False)
    for plain, quick in pairs:
        bad = bad | (plain != quick)
    assert df.where(bad).count() == 0
    assert all(0 < df.where(plain).count() < len(texts) for plain, _ in pairs[:3])


def test_markers_by_outcome_of_odd_lists(spark):
    rows = [("m", "TP", ["a", "b"]), ("m", "TP", ["a"]), ("m", "TP", []), ("m", "TP", None), ("m", "TP", ["a", None, "a"]), ("n", "FP", ["b"]), (None, "FP", ["b"])]
    df = spark.createDataFrame(rows, "k string, outcome string, markers array<string>")
    got = {tuple(r[c] for c in ("k", "outcome", "marker", "n", "class_size", "share")) for r in markers_by_outcome(df, by=("k",)).collect()}
    assert got == {("m", "TP", "a", 4, 5, 0.8), ("m", "TP", "b", 1, 5, 0.2), ("m", "TP", None, 1, 5, 0.2), ("n", "FP", "b", 1, 1, 1.0)}


def test_markers_are_not_sought_again_for_a_filter(spark, tmp_path):
    from annospark.plans import q_annotate
    plan = _plan(q_annotate._markers_by_outcome(spark, _tables(spark, tmp_path)))
    assert not [x for x in plan.splitlines() if "Filter" in x.split("(")[0] and "RLIKE" in x]


def test_results_of_a_run_are_parsed_once(spark, tmp_path, monkeypatch):
    from annospark.operators.resume import StoredAnnotations
    from annospark.plans import fixtures, q_annotate
    sf = _tables(spark, tmp_path)
    results = fixtures.batch_results(spark, sf)
    assert _plan(results).count("from_json") == 1
    assert results.count() > 40 * 15 * 24 // 25 - 60
    plans, merge = [], StoredAnnotations.merge
    monkeypatch.setattr(StoredAnnotations, "merge", lambda self, r, *a: (plans.append(_plan(r)), merge(self, r, *a))[1])
    assert q_annotate._merge_back(spark, sf).count() == 40 * 15
    assert len(plans) == 3 and not any("from_json" in x for x in plans)
