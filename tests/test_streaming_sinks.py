"""Streaming annotation (availableNow), scoring callback and file sinks."""

import pandas as pd
from pyspark.sql import functions as F

from annospark.operators import annotate as AN
from annospark.sources import files as FS
from annospark.streaming.annotate_stream import stream_annotate
from paths import SF0001


def test_stream_annotate_terminates_and_covers_input(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    out = stream_annotate(spark, docs.repartition(3), "doc_id", files_per_trigger=1)
    assert out.count() == docs.count()
    assert out.select("doc_id").distinct().count() == docs.count()
    assert set(r[0] for r in out.select("label").distinct().collect()) <= {"yes", "no"}


def test_score_retries_and_errors(spark):
    calls = {"n": 0}

    def flaky(texts: pd.Series) -> pd.Series:
        calls["n"] += 1
        return texts.map(lambda t: None if t == "bad" else "yes")

    df = spark.createDataFrame([(1, "ok"), (2, "bad")], "id int, text string").coalesce(1)
    rows = {r["id"]: r for r in AN.score(df, flaky, keep=["id"], max_retries=3).collect()}
    assert rows[1]["status"] == "ok" and rows[1]["attempts"] == 1
    assert rows[2]["status"] == "error" and rows[2]["attempts"] == 3


def test_attach_last_wins_missing_error(spark):
    req = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "request_id string")
    res = spark.createDataFrame([("r1", "succeeded", "no", "low", 1), ("r1", "succeeded", "yes", "high", 5),
                                 ("r2", "errored", None, None, 1)],
                                "request_id string, result_type string, label string, confidence string, arrival long")
    got = {r["request_id"]: (r["label"], r["confidence"]) for r in AN.attach_results(req, res).collect()}
    assert got == {"r1": ("yes", "high"), "r2": ("error", "unknown"), "r3": ("missing", "unknown")}


def test_pending_anti_join(spark):
    todo = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    done = spark.createDataFrame([(1, "yes"), (2, " "), (3, None)], "id int, label string")
    assert sorted(r[0] for r in AN.pending(todo, done, ["id"]).collect()) == [2, 3]


def test_blocks_csv_roundtrip(spark, tmp_path):
    rows = [("Verga", "Malavoglia", 1881, "verga_1881.txt", 'Disse: "ah, no",\nandò via.', "yes", "V1")]
    df = spark.createDataFrame(rows, FS.BLOCK_SCHEMA)
    FS.write_annotated(df, str(tmp_path / "out"), by=None)
    back = FS.read_blocks(spark, str(tmp_path / "out")).collect()
    assert back[0]["text"] == rows[0][4] and back[0]["year"] == 1881


def test_log_roundtrip_and_metrics_json(spark, tmp_path):
    import datetime
    log = spark.createDataFrame([(1, datetime.datetime(2026, 1, 1), "t", "yes", "alta", "yes", None, "r",
                                  ["a"], 10, 2, None, None, None)], FS.LOG_SCHEMA)
    FS.write_log(log, str(tmp_path / "log"))
    assert FS.read_log(spark, str(tmp_path / "log")).first()["marcatori"] == ["a"]
    import __spark_entry__ as E
    summary = E.entry(spark)
    nested = FS.metrics_nested(summary).first()["metrics"]
    assert len(nested) == 15


def test_read_annotations_directory(spark, tmp_path):
    import csv
    for key, p, lab in [("m1", "A", "yes"), ("m2", "B", "no"), ("minerva7b", "A", "yes")]:
        with open(tmp_path / f"{key}_prompt{p}_annotated.csv", "w", newline="") as fh:
            w = csv.writer(fh, quoting=csv.QUOTE_ALL)
            w.writerow(["doc_id", "text", "DIL", f"DIL_{key}_prompt{p}", f"confidence_{key}_prompt{p}"])
            w.writerow(["a_1881.txt", 'uno, "due"\ntre', "yes", lab, "high"])
    long = FS.read_annotations(spark, str(tmp_path))
    rows = sorted((r["model_key"], r["prompt"], r["label"], r["text"]) for r in long.collect())
    assert rows == [("m1", "A", "yes", 'uno, "due"\ntre'), ("m2", "B", "no", 'uno, "due"\ntre')]  # excluded model dropped


def test_read_annotations_of_an_empty_folder(spark, tmp_path):
    assert FS.read_annotations(spark, str(tmp_path)).count() == 0


def test_read_annotations_reads_folders_of_part_files(spark, tmp_path):
    df = spark.createDataFrame([("n-1850.txt", "a, \"b\"\nc", "yes", "no")], "doc_id string, text string, DIL string, DIL_m_promptA string")
    FS.write_annotated(df, f"{tmp_path}/m_annotated.csv", by=None)
    row, = FS.read_annotations(spark, str(tmp_path)).collect()
    assert (row["text"], row["model_key"], row["label"], row["source_file"]) == ("a, \"b\"\nc", "m", "no", "m_annotated.csv")


def test_concurrent_calls_keep_limit_order_and_fail_alone(spark):
    import time

    def call(text):
        time.sleep(0.002 * (int(text) % 3))           # later rows finish first
        if text == "13":
            raise RuntimeError("bad row")
        return f"<{text}>"

    df = spark.range(60).select("id", F.col("id").cast("string").alias("text")).coalesce(1)
    rows = AN.score_concurrent(df, call, keep=["id"], partitions=2, in_flight=4, max_retries=2).collect()
    assert {r.id: (r.raw_text, r.status, r.attempts) for r in rows} == {
        i: (None, "error", 2) if i == 13 else (f"<{i}>", "ok", 1) for i in range(60)}
    assert 2 <= max(r.in_flight for r in rows) <= 4 and all(1 <= r.in_flight for r in rows)
    by_task = {}
    for r in rows:
        by_task.setdefault(r.nth, []).append(r.id)
    assert sorted(by_task) == list(range(len(by_task))) and all(len(v) <= 2 for v in by_task.values())


def test_concurrent_calls_share_a_budget(spark):
    import time
    df = spark.range(40).select("id", F.lit("x").alias("text"))
    warm = AN.score_concurrent(df, lambda t: "y", keep=["id"], partitions=2).count()
    start = time.monotonic()
    assert AN.score_concurrent(df, lambda t: "y", keep=["id"], partitions=2, calls_per_second=40).count() == warm == 40
    assert time.monotonic() - start >= 0.8            # 40 calls at 40 a second, less the first of each task
    assert AN.score_concurrent(df.limit(0), lambda t: "y", keep=["id"]).collect() == []


def test_rule_answers_are_what_the_scorer_gives(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").unionByName(
        spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    a = {tuple(r) for r in AN.score(docs, AN.rule_scorer, keep=["doc_id"]).collect()}
    assert a == {tuple(r) for r in AN.rule_answers(docs, keep=["doc_id"]).collect()}


def test_latest_result_wins_over_batches_and_replays(spark, tmp_path):
    from annospark.streaming.attach_stream import attach_stream, start_latest
    req = spark.createDataFrame([(f"r{i}",) for i in range(40)], "request_id string")
    res = [(f"r{i % 37}", "succeeded", "yes" if i % 2 else "no", "high", (i * 7919) % 1009) for i in range(300)]
    results = spark.createDataFrame(res, "request_id string, result_type string, label string, confidence string, arrival long")
    want = sorted(map(tuple, AN.attach_results(req, results).collect()))
    got = attach_stream(spark, req, results, ["request_id"], landings=6, files_per_trigger=1)
    assert sorted(map(tuple, got.collect())) == want
    # more results land: the same checkpoint goes on from its state; old arrivals change nothing
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    results.where("arrival >= 500").write.parquet(source)
    start_latest(spark, source, sink, state, ["request_id"]).awaitTermination()
    results.where("arrival < 500").write.mode("append").parquet(source)
    start_latest(spark, source, sink, state, ["request_id"]).awaitTermination()
    latest = spark.read.parquet(sink).drop("batch")
    assert sorted(map(tuple, AN.attach_results(req, latest, ["request_id"]).collect())) == want


def test_merge_back_fills_pending_rows_only(spark, tmp_path):
    from annospark.operators.resume import StoredAnnotations
    base = spark.createDataFrame([("a", "yes", "high", 1), ("b", " ", None, 2), ("c", None, None, 3), ("d", None, None, 4), (None, None, None, 5)],
                                 "id string, label string, confidence string, extra int")
    results = lambda rows: spark.createDataFrame(rows, "id string, label string, confidence string, arrival int")
    table = StoredAnnotations(spark, str(tmp_path / "t"), ["id"]).create(base)
    first = results([("a", "no", "low", 1), ("b", "no", "low", 1), ("b", "yes", "low", 2), ("x", "no", "low", 1), ("c", "", "low", 1), (None, "no", "low", 1)])
    second = results([("b", "no", "high", 9), ("c", "yes", "high", 1)])
    rows = lambda t: sorted((tuple(r) for r in t.read().collect()), key=str)
    assert sorted(r.id for r in table.pending().where("id is not null").collect()) == ["b", "c", "d"]
    table.merge(first, 1)
    after = rows(table)
    assert after == sorted([("a", 1, "yes", "high", 0), ("b", 2, "yes", "low", 1), ("c", 3, None, None, None), ("d", 4, None, None, None),
                            (None, 5, "no", "low", 1)], key=str)
    table.merge(second, 2)
    done = rows(table)
    assert ("c", 3, "yes", "high", 2) in done and ("b", 2, "yes", "low", 1) in done
    assert rows(table.merge(second, 2)) == done and rows(table.merge(first, 1)) == done


def test_clustered_write_bounds_files_and_spreads_a_hot_work(spark, tmp_path):
    df = spark.range(3000).select("id", F.when(F.col("id") < 1000, "hot").otherwise(F.concat(F.lit("w"), (F.col("id") % 40).cast("string"))).alias("work"))
    FS.write_clustered(df, str(tmp_path / "t"), "work", 100, fmt="parquet")
    back = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(r.id for r in back.collect()) == list(range(3000))
    files = back.groupBy("work", F.col("_metadata.file_path").alias("f")).count().groupBy("work").agg(
        F.count(F.lit(1)).alias("files"), F.max("count").alias("most")).collect()
    assert all(r.most <= 100 and (r.files == 1 if r.work != "hot" else 10 <= r.files <= 20) for r in files)
