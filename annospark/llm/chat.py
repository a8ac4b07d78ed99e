"""Reply trees: root-to-leaf paths, ranked by score, each formatted as one conversation.

Messages point to the message they answer.  Paths are enumerated by iterative
self-joins with doubling pointers: after round k every leaf knows its last
2^k ancestors and every message the one 2^k steps up, so a conversation of n
turns takes about log2(n) rounds.  Only ids travel through the rounds; texts
are joined to the chosen paths once.

Template, per turn:  <|im_start|>role NEWLINE text <|im_end|> NEWLINE
Inside roles and texts `&`, `<` and `[` are written `&amp;`, `&lt;`, `&lsb;` (in
roles a newline is `&nl;` too), so no control string of this or of another
template can occur there, and the escape is undone exactly.  The loss mask is a
list of spans (start, length), in code points of the formatted text, of the
texts of the trained role.

Defined cases: null texts and roles are empty; a message whose parent is null or
absent is a root; messages on a cycle belong to no path; of repeated message ids
the smallest row counts; a null conversation id is a conversation; an empty
table gives an empty result.  Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annospark.llm.common import same, stored

START, END = "<|im_start|>", "<|im_end|>\n"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsb;"))
SALTS = 64


def escape(c: Column, newline: bool = False) -> Column:
    for raw, safe in (*ESCAPES, *([("\n", "&nl;")] if newline else [])):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for raw, safe in (("\n", "&nl;"), *reversed(ESCAPES)):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def reply_paths(messages: DataFrame) -> DataFrame:
    """(conv, id, parent) -> (conv, leaf, id, back): the messages of every leaf's path, `back` steps above the leaf."""
    up = stored(messages.alias("m").join(
        messages.select(F.col("conv").alias("p_conv"), F.col("id").alias("p_id")),
        same(F.col("conv"), F.col("p_conv")) & (F.col("parent") == F.col("p_id")), "left")
        .select("conv", "id", F.col("p_id").alias("up")))
    answered = up.where("up is not null").select(F.col("conv").alias("a_conv"), F.col("up").alias("a_id")).distinct()
    path = up.join(answered, same(F.col("conv"), F.col("a_conv")) & (F.col("id") == F.col("a_id")), "left_anti").select(
        "conv", F.col("id").alias("leaf"), "id", F.lit(0).cast("bigint").alias("back"))
    most = up.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    step = 1
    while step < most:                             # a path has at most `most` messages; cycles end here too
        links = up.where("up is not null").select(F.col("conv").alias("l_conv"), F.col("id").alias("l_id"), F.col("up").alias("l_up"))
        if links.isEmpty():
            break
        above = path.join(links, same(F.col("conv"), F.col("l_conv")) & (F.col("id") == F.col("l_id"))).select(
            "conv", "leaf", F.col("l_up").alias("id"), (F.col("back") + step).alias("back"))
        path = stored(path.unionByName(above))
        up = stored(up.where("up is not null").join(
            links, same(F.col("conv"), F.col("l_conv")) & (F.col("up") == F.col("l_id"))).select(
                "conv", "id", F.col("l_up").alias("up")))
        step *= 2
    return path


def best_branches(paths: DataFrame, scores: DataFrame, top: int) -> DataFrame:
    """(conv, leaf, branch_score, branch): the `top` paths of each conversation by summed score, ties to the smaller leaf."""
    s = scores.select(F.col("conv").alias("s_conv"), F.col("id").alias("s_id"), "score")
    total = (paths.join(s, same(F.col("conv"), F.col("s_conv")) & (F.col("id") == F.col("s_id")))
             .groupBy("conv", "leaf").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("branch_score"),
                                          F.max("back").alias("above"))
             .withColumn("salt", F.pmod(F.xxhash64("leaf"), F.lit(SALTS))))
    order = (F.col("branch_score").desc(), F.col("leaf"))
    within = Window.partitionBy("conv", "salt").orderBy(*order)
    return (total.withColumn("branch", F.row_number().over(within)).where(F.col("branch") <= top)
            .withColumn("branch", F.row_number().over(Window.partitionBy("conv").orderBy(*order)))
            .where(F.col("branch") <= top).drop("salt"))


def format_reply_trees(messages: DataFrame, *, conv_col: str, id_col: str, parent_col: str, role_col: str, text_col: str,
                       score_col: str | None = None, top: int = 1, trained_role: str = "assistant") -> DataFrame:
    """One row per chosen path: conv, leaf, branch, branch_score, formatted, loss_spans array<struct<start,length>>."""
    score = F.col(score_col).cast("double") if score_col else F.lit(0.0)
    rows = stored(messages.select(
        F.col(conv_col).alias("conv"), F.col(id_col).alias("id"), F.col(parent_col).alias("parent"), score.alias("score"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        .groupBy("conv", "id").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m"))
        .select("conv", "id", "m.*"))
    paths = reply_paths(rows.select("conv", "id", "parent"))
    chosen = best_branches(paths, rows.select("conv", "id", "score"), top)
    texts = rows.select(F.col("conv").alias("t_conv"), F.col("id").alias("t_id"), "parent", "role",
                        escape(F.col("text")).alias("safe"))
    c = chosen.select(F.col("conv").alias("c_conv"), F.col("leaf").alias("c_leaf"), "branch", "branch_score", "above")
    turns = (paths.join(c, same(F.col("conv"), F.col("c_conv")) & (F.col("leaf") == F.col("c_leaf")))
             .join(texts, same(F.col("conv"), F.col("t_conv")) & (F.col("id") == F.col("t_id")))
             .withColumn("head", F.concat(F.lit(START), escape(F.col("role"), newline=True), F.lit("\n")))
             .withColumn("turn", F.concat("head", "safe", F.lit(END))))
    order = Window.partitionBy("conv", "leaf").orderBy(F.col("back").desc())
    before = F.coalesce(F.sum(F.length("turn")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    span = F.struct((before + F.length("head")).cast("bigint").alias("start"), F.length("safe").cast("bigint").alias("length"))
    placed = turns.withColumn("span", F.when(F.col("role") == trained_role, span)).withColumn("pos", F.col("above") - F.col("back"))
    return (placed.groupBy("conv", "leaf", "branch", "branch_score")
            .agg(F.sort_array(F.collect_list(F.struct("pos", "turn", "span"))).alias("turns"))
            .select("conv", "leaf", "branch", "branch_score",
                    F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
                    F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans")))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>."""
    parts = F.filter(F.split(formatted, START.replace("|", r"\|")), lambda p: p != "")
    body = lambda p: F.substring(p, F.lit(1), F.length(p) - len(END))
    return F.transform(parts, lambda p: F.struct(
        unescape(F.substring_index(body(p), "\n", 1)).alias("role"),
        unescape(F.substring(body(p), F.instr(p, F.lit("\n")) + 1, F.length(p))).alias("text")))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return unescape(F.array_join(F.transform(spans, lambda s: F.substring(
        formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))), ""))


def linear_messages(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                    text_col: str = "text") -> DataFrame:
    """Conversations without reply links: every row answers the one before it (nulls last; ties by role and text)."""
    r = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    return (r.withColumn("id", F.row_number().over(order).cast("bigint"))
            .withColumn("parent", F.when(F.col("id") > 1, F.col("id") - 1)))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted text."""
    turns, loss = F.col("turns"), F.col("loss")
    back = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (formatted.withColumn("turns", read_back(F.col("formatted")))
            .withColumn("loss", masked_text(F.col("formatted"), F.col("loss_spans")))
            .select(F.col("conv").alias("conv_id"), F.size(turns).cast("bigint").alias("n_turns"),
                    F.sha2(back, 256).alias("turns_sha256"), F.length(loss).cast("bigint").alias("loss_chars"),
                    F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars")))


PROBE = "</s>[INST] ok [/INST]"


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table's rows and a conversation -7 whose two texts are control strings."""
    extra = conversations.sparkSession.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


def oracle() -> str:
    safe = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '[', '&lsb;')"
    order = "ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST"
    role, text = "coalesce(role, '')", "coalesce(text, '')"
    loss = f"coalesce(string_agg({text}, '' {order}) FILTER (WHERE role = 'assistant'), '')"
    size = f"length({safe.format(text)}) + length(replace({safe.format(role)}, chr(10), '&nl;'))"
    return f"""
WITH rows_ AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}')
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg({role} || chr(10) || {text} || chr(10), '' {order})) AS turns_sha256,
       length({loss})::BIGINT AS loss_chars, sha256({loss}) AS loss_sha256,
       sum({size} + {len(START) + 1 + len(END)})::BIGINT AS formatted_chars
FROM rows_ GROUP BY conv_id"""
