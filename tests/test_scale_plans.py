"""Scale-relevant behaviour: exact top-n / sampling under skew, bounded broadcasts, plan shapes."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from annospark.functions.hashing import h_parts
from annospark.operators import prep as P
from annospark.operators import inference as I
from annospark.operators.metrics import metrics_summary, pairwise_kappa
from annospark.operators.reshape import stratified_sample, top_n_per_group
from paths import SF0001


def _skewed(spark, n=20000):
    # one group holds ~1/3 of the rows
    return spark.range(n).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"),
        (h_parts("id") % 1000).alias("v"))


def test_salted_top_n_equals_plain_window(spark):
    df = _skewed(spark)
    got = top_n_per_group(df, ["g"], [F.col("v"), F.col("id")], 7, salt_col="id", buckets=16)
    w = Window.partitionBy("g").orderBy("v", "id")
    ref = df.withColumn("rank", F.row_number().over(w)).where("rank <= 7")
    a = sorted(tuple(r) for r in got.select("g", "id", "rank").collect())
    b = sorted(tuple(r) for r in ref.select("g", "id", "rank").collect())
    assert a == b


def test_stratified_sample_is_exact(spark):
    df = _skewed(spark).withColumn("label", F.when(F.col("g") == "hot", "yes").otherwise("no"))
    got = stratified_sample(df, "label", n=250, seed=9, id_col="id")
    keyed = df.withColumn("k", h_parts(F.lit(9), "id"))
    w = Window.partitionBy("label").orderBy("k", "id")
    ref = keyed.withColumn("rn", F.row_number().over(w)).where("rn <= 250")
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in ref.collect())


def test_numbered_without_one_task(spark):
    ids = spark.range(5000).select((F.col("id") * 7919 % 100003).alias("x"))
    got = I.numbered(ids.repartition(13), "x")
    assert [r.k for r in got.orderBy("x").collect()] == list(range(5000))


def _physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chunking_is_narrow(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")   # no fan-out applied
    plan = _physical(P.chunks(docs, "doc_id"))
    assert "Exchange" not in plan and "Window" not in plan


def test_metrics_one_shuffle_and_pairwise_no_block_join(spark):
    from annospark.plans import fixtures as fx
    wide = fx.annotations_wide(spark, SF0001)                  # stored parquet input
    plan = _physical(metrics_summary(wide))
    assert plan.count("Exchange hashpartitioning") == 1
    pw = _physical(pairwise_kappa(wide))
    assert "SortMergeJoin" not in pw and "NestedLoopJoin" not in pw and "CartesianProduct" not in pw
    assert "PythonUDF" not in pw and "BatchEvalPython" not in pw


def test_stored_conditions_merge_without_exchange(spark, tmp_path):
    import uuid
    from annospark.operators.reshape import merge_conditions, merge_stored, store_condition
    rows = [(1, "yes", "a"), (2, "no", "b"), (2, "yes", "c"), (None, "no", "d"), (5, "yes", "e")]
    a = spark.createDataFrame(rows, "block_id int, DIL_m_promptA string, text string")
    b = spark.createDataFrame([(2, "no"), (2, "x"), (None, "yes"), (9, "no")], "block_id int, DIL_m_promptB string")
    c = spark.createDataFrame([(1, "no"), (5, None)], "block_id int, DIL_m_promptA string")
    names = [f"t{k}_{uuid.uuid4().hex}" for k in range(3)]
    for f, name in zip((a, b, c), names):
        store_condition(f, name, str(tmp_path / name), buckets=4)
    merged = merge_stored(spark, names)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, merged.collect()), key=key) == sorted(map(tuple, merge_conditions([a, b, c]).collect()), key=key)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    for name in names:
        spark.sql(f"DROP TABLE {name}")


def _broadcasts(df):
    """Joins of the optimised plan that a broadcast of any of their sides could answer."""
    return [line for line in _physical(df).splitlines() if "BroadcastHashJoin" in line]


def test_long_rows_of_a_small_stored_table_are_not_broadcast(spark, tmp_path):
    # 40 blocks in a file of a few kB: the long rows behind the generator look small to the planner
    long = spark.range(40).select(F.col("id").alias("block_id"), F.explode(F.array(*map(F.lit, "ABC"))).alias("prompt"))
    rows = long.select("block_id", F.lit("m").alias("model"), "prompt",
                       (F.xxhash64("block_id", "prompt") % 2 == 0).cast("int").alias("correct"))
    rows.write.parquet(str(tmp_path / "lf"))
    lf = spark.read.parquet(str(tmp_path / "lf"))
    score = I.clogit_score(lf)
    assert not _broadcasts(score)
    pdf = lf.toPandas()
    per = pdf.groupby("block_id").correct.agg(["sum", "count"])
    kept = pdf.merge(per[(per["sum"] > 0) & (per["sum"] < per["count"])], left_on="block_id", right_index=True)
    want = {p: round(float((g.correct - g["sum"] / g["count"]).sum()), 6) for p, g in kept.groupby("prompt")}
    assert {r.prompt: r.u for r in score.collect()} == want


def test_answers_meet_their_blocks_without_broadcast(spark):
    from annospark.plans import catalog, q_annotate  # noqa: F401 - registers
    plan = [line for line in _broadcasts(catalog.QUERIES["pending_conditions"](spark, SF0001)) if "block_id" in line]
    assert not plan


def _optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_each_answer_is_parsed_and_hashed_once(spark):
    from annospark.operators.answers import normalize_answers
    from annospark.plans import fixtures as fx
    raw = spark.createDataFrame([('{"dil": "yes"}', "succeeded"), ("x", "errored"), ("x", None)], "raw_text string, result_type string")
    for mode in ("json_think", "structured"):
        assert _optimised(normalize_answers(raw, mode)).count("from_json(") == 1
    assert [r.status for r in normalize_answers(raw, "structured").collect()] == ["ok", "api_error", "parse_error"]
    assert _optimised(fx.raw_answers(spark, SF0001)).count("md5(") == 4       # shape, outcome, two token counts


def test_wide_table_is_dealt_by_rows(spark, monkeypatch):
    from annospark.plans import fixtures as fx
    monkeypatch.setattr(fx, "WIDE_FILE_ROWS", 25, raising=False)
    monkeypatch.setattr(fx, "_MATERIALISED", {})
    wide = fx.annotations_wide(spark, SF0001)
    rows = wide.count()
    assert rows == spark.read.parquet(f"{SF0001}/documents.parquet").count()
    assert len(wide.inputFiles()) >= rows / 25
