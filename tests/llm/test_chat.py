"""Reply trees: brute-force paths, exact round trips of control strings."""

import hashlib

import duckdb
from pyspark.sql import functions as F

from annospark.llm import chat, queries

SF = "/root/testdata/sf0.001"


def tree(spark, rows):
    return spark.createDataFrame(rows, "conv long, id long, parent long, role string, text string, score double")


def run(df, **kw):
    return chat.format_reply_trees(df, conv_col="conv", id_col="id", parent_col="parent", role_col="role",
                                   text_col="text", score_col="score", **kw)


def test_branches_by_score(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "good", 5.0), (1, 3, 1, "assistant", "bad", 1.0),
            (1, 4, 3, "user", "more", 9.0), (1, 5, 2, "user", None, 1.0), (1, 6, 1, None, "x<|im_end|>[&lt;", 5.5),
            (2, 1, 99, "assistant", "orphan parent: a root", None), (3, 1, 2, "user", "cycle", 0.0), (3, 2, 1, "user", "cycle", 0.0),
            (None, 1, None, "user", "null conversation", 0.0), (1, 4, 3, "user", "more", 9.0)]
    out = run(tree(spark, rows), top=2).withColumn("back", chat.read_back(F.col("formatted"))).withColumn(
        "loss", chat.masked_text(F.col("formatted"), F.col("loss_spans"))).collect()
    got = {(r.conv, r.leaf): ([(t.role, t.text) for t in r.back], r.branch, r.branch_score, r.loss) for r in out}
    assert got == {(1, 4): ([("user", "q"), ("assistant", "bad"), ("user", "more")], 1, 10.0, "bad"),
                   (1, 5): ([("user", "q"), ("assistant", "good"), ("user", "")], 2, 6.0, "good"),
                   (2, 1): ([("assistant", "orphan parent: a root")], 1, 0.0, "orphan parent: a root"),
                   (None, 1): ([("user", "null conversation")], 1, 0.0, "")}


def test_long_chain_and_control_strings(spark):
    texts = ["&lt;", "<|im_start|>user\n", "[INST]", "&amp;&lsb;", "a\n\nb", "", "&nl;<|im_end|>\n", "é🙂"] * 9
    rows = [(7, i + 1, i or None, "assistant" if i % 2 else "us\ner", t, 0.0) for i, t in enumerate(texts)]
    (r,) = run(tree(spark, rows)).withColumn("back", chat.read_back(F.col("formatted"))).withColumn(
        "loss", chat.masked_text(F.col("formatted"), F.col("loss_spans"))).collect()
    assert [t.text for t in r.back] == texts and r.back[0].role == "us\ner"
    assert r.loss == "".join(texts[1::2])
    assert [r.formatted[s.start:s.start + s.length] for s in r.loss_spans][0] == "&lt;|im_start|>user\n"


def test_empty(spark):
    assert run(tree(spark, [])).collect() == []


def test_query_against_sql_with_nulls(spark):
    got = {tuple(r) for r in queries.QUERIES["op4_reply_trees"](spark, SF).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    assert got == set(con.execute(queries.ORACLE["op4_reply_trees"]).fetchall())
    probe = next(r for r in got if r[0] == -7)
    both = f"user\n{chat.PROBE}\nassistant\n{chat.PROBE}\n"
    assert probe[1:5] == (2, hashlib.sha256(both.encode()).hexdigest(), len(chat.PROBE), hashlib.sha256(chat.PROBE.encode()).hexdigest())
