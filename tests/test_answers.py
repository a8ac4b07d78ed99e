"""Answer-parser truth tables (FIXTURES.md section D)."""

from pyspark.sql import functions as F

from annospark.functions import answers as A
from annospark.operators.answers import normalize_answers

JSON_CASES = [
    ('{"label":"yes","confidence":"high"}', "yes", "high"),
    ('Ecco: {"label":"no","confidence":"low"} fine', "no", "low"),
    ('<think>{"label":"no"}</think>{"label":"yes","confidence":"medium"}', "yes", "medium"),
    ('{"label":"YES ","confidence":"Max"}', "yes", "unknown"),
    ('{"label":"yes"} x {"label":"no"}', "error", "unknown"),
    ('{"label":"yes"},{"label":"no"}', "error", "unknown"),
    ('{"label": true}', "error", "unknown"),
    ('{"label": null}', "error", "unknown"),
    ("[1]", "error", "unknown"),
    ("", "error", "unknown"),
    ('{"label":"yes"', "error", "unknown"),
    ("{'label':'yes'}", "error", "unknown"),
    ('{"label":"yes","label":"no"}', "no", "unknown"),
    ('{"label":{"a":1}}', "error", "unknown"),
]


def _df(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, raw_text string")


def test_json_truth_table(spark):
    out = normalize_answers(_df(spark, [c[0] for c in JSON_CASES]), "json_think").orderBy("i").collect()
    for (raw, lab, conf), r in zip(JSON_CASES, out):
        assert (r["label"], r["confidence"]) == (lab, conf), raw


def test_json_without_think_stripping(spark):
    r = normalize_answers(_df(spark, ['<think>{"label":"no"}</think>{"label":"yes"}']), "json").first()
    assert r["label"] == "error"


def test_plain_tokens(spark):
    rows = normalize_answers(_df(spark, ["no low yes", "yes, high", None, " YES  Medium "]), "plain").orderBy("i").collect()
    assert [(r["label"], r["confidence"]) for r in rows] == [
        ("no", "low"), ("error", "high"), ("error", "unknown"), ("yes", "medium")]


def test_contains_prefix_legacy(spark):
    df = _df(spark, ["NON LO SO", "boh", None, "Forse", "sicuramente no", "yes indeed", "No."])
    c = [r["label"] for r in normalize_answers(df, "contains").orderBy("i").collect()]
    assert c == ["NO", "UNCLEAR", "ERROR", "UNCLEAR", "NO", "YES", "NO"]
    p = [r["label"] for r in normalize_answers(df, "prefix").orderBy("i").collect()]
    assert p == ["no", "no", "no", "no", "no", "yes", "no"]
    leg = [r["label"] for r in normalize_answers(df, "legacy").orderBy("i").collect()]
    assert leg[4] == "yes"      # 'sicuramente' contains 'si' (kept for parity)
    assert leg[1] == "no"


def test_structured(spark):
    df = spark.createDataFrame([
        (0, '{"dil":"yes","confidenza":"alta","ragionamento":"r","marcatori":["a","b"]}', "succeeded"),
        (1, '{"confidenza":"alta"}', "succeeded"),
        (2, "not json", "succeeded"),
        (3, None, "errored"),
        (4, None, "expired"),
    ], "i int, raw_text string, result_type string")
    rows = normalize_answers(df, "structured").orderBy("i").collect()
    assert [r["status"] for r in rows] == ["ok", "ok", "parse_error", "api_error", "expired"]
    assert rows[0]["marcatori"] == ["a", "b"] and rows[0]["dil"] == "yes"
    assert rows[1]["dil"] == "error" and rows[1]["confidenza"] == "alta"
    assert rows[2]["raw_prefix"] == "not json"


def test_strip_think_and_answer_text(spark):
    df = spark.createDataFrame([("<THINK>x\ny</think>ok", "  ", "r")], "a string, b string, c string")
    r = df.select(A.strip_think(F.col("a")).alias("s"), A.answer_text(F.col("b"), F.col("c")).alias("t")).first()
    assert r["s"] == "ok" and r["t"] == "r"


def test_output_text_items(spark):
    schema = ("i int, direct string, items array<struct<type:string,text:string,summary:array<string>>>")
    df = spark.createDataFrame([
        (0, " yes high ", [("text", "ignored", None)]),
        (1, None, [("reasoning", None, ["r1"]), ("text", "ye", None), ("text", "s", None)]),
        (2, "", [("reasoning", None, ["a", "b"]), ("reasoning", None, ["c"]), ("text", "", None)]),
        (3, None, []),
    ], schema)
    got = [r[0] for r in df.orderBy("i").select(A.output_text(F.col("direct"), F.col("items"))).collect()]
    assert got == ["yes high", "yes", "a b c", ""]
