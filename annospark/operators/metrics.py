"""Agreement and quality metrics as single-pass aggregates.

Every metric is column math over confusion counts computed by one
`groupBy(...).agg(count_if(...))` (map-side partial aggregation, so a
condition holding a third of all rows costs one partial row per task).
Kappa is formed from exact integer counts in one division so that any SQL
engine gets the identical double.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annospark.constants import KAPPA_BAND_TOP, KAPPA_BANDS, MODEL_LABELS
from annospark.operators.reshape import binarize, detect_conditions, display_name, to_long

_D = "double"


def _ratio(num: Column, den: Column, zero: Column | None) -> Column:
    r = F.try_divide(num.cast(_D), den.cast(_D))
    return r if zero is None else F.coalesce(r, zero)


def kappa_from_counts(a11: Column, a10: Column, a01: Column, a00: Column) -> Column:
    """Cohen's kappa of a 2x2 table (rows: rater 1 = 1/0, cols: rater 2 = 1/0).

    kappa = (n*(a11+a00) - S) / (n*n - S), S = r1*c1 + r0*c0; NULL when pe = 1.
    """
    n = (a11 + a10 + a01 + a00).cast(_D)
    s = ((a11 + a10).cast(_D) * (a11 + a01).cast(_D) + (a01 + a00).cast(_D) * (a10 + a00).cast(_D))
    return F.try_divide(n * (a11 + a00).cast(_D) - s, n * n - s)


def confusion(df: DataFrame, group_cols: list[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """TP/FP/FN/TN and n_total/n_valid/n_error per group (rows with NULL gold or pred are errors)."""
    g, p = F.col(gold), F.col(pred)
    valid = g.isNotNull() & p.isNotNull()
    return df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(valid).alias("n_valid"),
        F.count_if(~valid | valid.isNull()).alias("n_error"),
        F.count_if(valid & (g == 1) & (p == 1)).alias("TP"),
        F.count_if(valid & (g == 0) & (p == 1)).alias("FP"),
        F.count_if(valid & (g == 1) & (p == 0)).alias("FN"),
        F.count_if(valid & (g == 0) & (p == 0)).alias("TN"),
    )


def add_rates(df: DataFrame, digits: int | None = 4, spec_zero: float | None = None,
              kappa_zero: float | None = None, acc_den: Column | None = None) -> DataFrame:
    """accuracy, precision, recall, f1 (0 on zero division), specificity, kappa."""
    tp, fp, fn, tn = (F.col(c) for c in ("TP", "FP", "FN", "TN"))
    zero = F.lit(0.0)
    den = acc_den if acc_den is not None else (tp + fp + fn + tn)
    rates = {
        "accuracy": _ratio(tp + tn, den, None),
        "precision": _ratio(tp, tp + fp, zero),
        "recall": _ratio(tp, tp + fn, zero),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn, zero),
        "specificity": _ratio(tn, tn + fp, None if spec_zero is None else F.lit(spec_zero)),
        "kappa": kappa_from_counts(tp, fn, fp, tn),
    }
    if kappa_zero is not None:
        rates["kappa"] = F.coalesce(rates["kappa"], F.lit(kappa_zero))
    out = df
    for name, expr in rates.items():
        out = out.withColumn(name, F.round(expr, digits) if digits is not None else expr)
    return out


def condition_long(wide: DataFrame, id_cols: list[str] | None = None) -> DataFrame:
    """Long rows with case-sensitive binarised gold and pred (compute-metrics semantics)."""
    ids = ["block_id", "DIL"] + [c for c in (id_cols or []) if c not in ("block_id", "DIL")]
    lg = to_long(wide, ids)
    return (lg.withColumn("gold", binarize(F.col("DIL")))
              .withColumn("pred", binarize(F.col("label"))))


# ---------------------------------------------------------------- M1 / M2
def metrics_summary(wide: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per condition: model, model_key, prompt, counts and 4-dp rates."""
    by = by or []
    lg = condition_long(wide, by)
    conf = confusion(lg, [*by, "model_key", "prompt"])
    out = add_rates(conf, digits=4)
    return out.select(*by, display_name(F.col("model_key")).alias("model"), "model_key",
                      F.concat(F.lit("Prompt "), F.col("prompt")).alias("prompt"),
                      "n_total", "n_valid", "n_error", "accuracy", "precision", "recall",
                      "f1", "specificity", "kappa", "TP", "FP", "FN", "TN")


def confusion_table(wide: DataFrame) -> DataFrame:
    lg = condition_long(wide)
    return confusion(lg, ["model_key", "prompt"])


# ---------------------------------------------------------------- M3
def metrics_strict(wide: DataFrame) -> DataFrame:
    """Only rows where both labels are exactly 'yes'/'no' (case-sensitive); every zero division -> 0; unrounded."""
    lg = to_long(wide, ["block_id", "DIL"])
    lg = (lg.withColumn("gold", binarize(F.col("DIL")))
            .withColumn("pred", binarize(F.col("label")))
            .where(F.col("gold").isNotNull() & F.col("pred").isNotNull()))
    conf = confusion(lg, ["model_key", "prompt"])
    out = add_rates(conf, digits=None, spec_zero=0.0, kappa_zero=0.0)
    return out.select("model_key", "prompt", "n_valid", "TP", "FP", "FN", "TN",
                      "accuracy", "precision", "recall", "f1", "specificity", "kappa")


def metrics_legacy(wide: DataFrame) -> DataFrame:
    """Older variant: drop only NULL labels; sentinels count as wrong in the accuracy denominator."""
    lg = to_long(wide, ["block_id", "DIL"])
    lg = (lg.where(F.col("label").isNotNull() & F.col("DIL").isNotNull())
            .withColumn("gold", binarize(F.col("DIL")))
            .withColumn("pred", binarize(F.col("label"))))
    conf = confusion(lg, ["model_key", "prompt"])
    out = add_rates(conf, digits=None, spec_zero=0.0, kappa_zero=0.0, acc_den=F.col("n_total"))
    return out.select("model_key", "prompt", "n_total", "n_valid", "TP", "FP", "FN", "TN",
                      "accuracy", "precision", "recall", "f1", "specificity")


# ---------------------------------------------------------------- M4
def kappa_multiclass(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa for k labels (rows where both are non-null).

    One groupBy(a, b) gives the k x k table; column marginals are joined back
    by label (equi-join on a k-row table) and a single aggregate forms
    n, agreement and sum_l row_l * col_l = sum_(a,b) count * col(a).
    """
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("c"))
    cols = pairs.groupBy(F.col(b).alias("__l")).agg(F.sum("c").alias("cb"))
    j = pairs.join(cols, pairs[a] == cols["__l"], "left")  # one row per label
    agg = j.agg(F.sum("c").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("c")).otherwise(0)).alias("agree"),
                F.sum(F.col("c").cast(_D) * F.coalesce(F.col("cb"), F.lit(0)).cast(_D)).alias("s"))
    n = F.col("n").cast(_D)
    return agg.select(F.col("n").cast("bigint").alias("n"),
                      F.round(F.try_divide(n * F.col("agree").cast(_D) - F.col("s"), n * n - F.col("s")), 6).alias("kappa"))


def kappa_band(k: Column) -> Column:
    expr = None
    for ub, lab in KAPPA_BANDS:
        expr = F.when(k < ub, lab) if expr is None else expr.when(k < ub, lab)
    return F.when(k.isNull(), F.lit(None)).otherwise(expr.otherwise(KAPPA_BAND_TOP))


# ---------------------------------------------------------------- M5
def compare_annotators(wide: DataFrame, col_a: str, col_b: str) -> DataFrame:
    """Two-annotator agreement table over rows where both say yes/no."""
    a, b = binarize(F.col(col_a)), binarize(F.col(col_b))
    both = a.isNotNull() & b.isNotNull()
    return wide.agg(
        F.count_if(both).alias("total"),
        F.count_if(both & (a == b)).alias("agreement"),
        F.count_if(both & (a == 1) & (b == 1)).alias("both_yes"),
        F.count_if(both & (a == 0) & (b == 0)).alias("both_no"),
        F.count_if(both & (a == 1) & (b == 0)).alias("yes_no"),
        F.count_if(both & (a == 0) & (b == 1)).alias("no_yes"),
    ).withColumn("rate", F.round(F.coalesce(F.try_divide(F.col("agreement").cast(_D), F.col("total").cast(_D)),
                                            F.lit(0.0)), 6))


def pair_cells(wide: DataFrame, columns: list[str], labels: list[str], gold: Column | None = None) -> DataFrame:
    """(i, j, a, b, g, c): for every two columns i < j, how often they say labels[a] and labels[b] (a, b from 0), by `gold`.

    A row is coded once as a vector of label numbers and counted in one group-by over (column, label, gold), which
    keeps counters for every other column and label: no pairs of rows or columns are emitted.
    """
    code = lambda c: F.coalesce(*[F.when(F.col(c) == x, F.lit(k)) for k, x in enumerate(labels, 1)], F.lit(0)).cast("tinyint")
    coded = wide.select(F.array(*[code(c) for c in columns]).alias("cs"), (F.lit(None).cast("int") if gold is None else gold).alias("g"))
    rows = coded.select(F.posexplode("cs").alias("i", "a"), "cs", "g").where("a > 0")
    cells = [(j, v) for j in range(1, len(columns)) for v in range(1, len(labels) + 1)]
    counts = rows.groupBy("i", "a", "g").agg(*[F.count_if(F.col("cs")[j] == v).alias(f"c_{j}_{v}") for j, v in cells])
    each = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(v - 1).alias("b"), F.col(f"c_{j}_{v}").alias("c")) for j, v in cells])
    return counts.select("i", (F.col("a") - 1).cast("int").alias("a"), "g", F.inline(each)).where("i < j and c > 0").select("i", "j", "a", "b", "g", "c")


def _named(cells: DataFrame, names: list[str], pair: tuple[str, str] = ("system_A", "system_B")) -> DataFrame:
    """Pairs by name instead of number."""
    name = F.array(*[F.lit(x) for x in names])
    return cells.select(name[F.col("i")].alias(pair[0]), name[F.col("j")].alias(pair[1]), *[c for c in cells.columns if c not in ("i", "j")])


def kappa_multiclass_pairs(wide: DataFrame, columns: list[str], labels: list[str]) -> DataFrame:
    """(system_A, system_B, n, kappa): Cohen's kappa for k labels of every two columns, over rows where both are among the labels."""
    cells = pair_cells(wide, columns, labels)
    c = F.col("c").cast(_D)
    # sum over cells of count * (column total of the row's label): each label's row total times its column total
    own = (cells.groupBy("i", "j", F.col("b").alias("l")).agg(F.sum("c").alias("total"))
           .select(F.col("i").alias("t_i"), F.col("j").alias("t_j"), "l", "total"))
    met = cells.join(own, (F.col("i") == F.col("t_i")) & (F.col("j") == F.col("t_j")) & (F.col("a") == F.col("l")), "left")
    agg = met.groupBy("i", "j").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("agree"),
                                    F.sum(c * F.coalesce("total", F.lit(0)).cast(_D)).alias("s"))
    n = F.col("n").cast(_D)
    kappa = F.round(F.try_divide(n * F.col("agree").cast(_D) - F.col("s"), n * n - F.col("s")), 6)
    return _named(agg.select("i", "j", F.col("n").cast("bigint").alias("n"), kappa.alias("kappa")), columns)


def compare_annotators_pairs(wide: DataFrame) -> DataFrame:
    """The two-annotator agreement table of every two conditions."""
    conds = [c for c, _, _ in detect_conditions(wide)]
    yes, no = 0, 1
    of = lambda a, b: F.sum(F.when((F.col("a") == a) & (F.col("b") == b), F.col("c")).otherwise(0))
    agg = pair_cells(wide, conds, ["yes", "no"]).groupBy("i", "j").agg(
        F.sum("c").alias("total"), (of(yes, yes) + of(no, no)).alias("agreement"), of(yes, yes).alias("both_yes"), of(no, no).alias("both_no"),
        of(yes, no).alias("yes_no"), of(no, yes).alias("no_yes"))
    return _named(agg.withColumn("rate", F.round(F.try_divide(F.col("agreement").cast(_D), F.col("total").cast(_D)), 6)), conds)


def disagreements_pairs(wide: DataFrame) -> DataFrame:
    """Where every two conditions disagree: direction, count, share, and which side matches gold."""
    conds = [c for c, _, _ in detect_conditions(wide)]
    gold = F.when(F.col("DIL") == "yes", 0).when(F.col("DIL") == "no", 1)
    cells = pair_cells(wide, conds, ["yes", "no"], gold).where("a <> b")
    direction = F.when(F.col("a") == 0, "yes->no").otherwise("no->yes").alias("direction")
    match = lambda side: F.sum(F.when(F.col("g") == F.col(side), F.col("c")).otherwise(0))
    agg = cells.groupBy("i", "j", direction).agg(F.sum("c").alias("n"), match("a").alias("v1_matches_gold"), match("b").alias("v2_matches_gold"))
    share = F.round(F.col("n").cast(_D) / F.sum("n").over(Window.partitionBy("i", "j")).cast(_D), 6)     # two rows a pair
    return _named(agg.withColumn("share", share), conds)


# ---------------------------------------------------------------- M6 / M7
def pairwise_kappa(wide: DataFrame, min_n: int = 10) -> DataFrame:
    """Kappa between every pair of conditions, pairwise-complete rows.

    No pair rows are emitted.  Each block is coded once as a vector of
    condition codes (0 invalid, 1 no, 2 yes); the block then contributes one
    row per valid condition i (its long form) carrying that vector, and a
    groupBy(i) accumulates, for every j, the 4 cells of the (i, j) table
    (a Gram-matrix pass: 4 x conditions counters per group, partial
    aggregation, so a hot condition costs one partial row per task).
    """
    conds = detect_conditions(wide)
    m = len(conds)
    code = lambda c: F.when(F.col(c) == "yes", 2).when(F.col(c) == "no", 1).otherwise(0).cast("tinyint")
    coded = wide.select(F.array(*[code(c) for c, _, _ in conds]).alias("cs"))
    rows = coded.select(F.posexplode("cs").alias("i", "ci"), "cs").where(F.col("ci") > 0)
    ci, cs = F.col("ci"), F.col("cs")
    aggs = []
    for j in range(m):
        cj = cs[j]
        aggs += [F.count_if((ci == 2) & (cj == 2)).alias(f"a11_{j}"), F.count_if((ci == 2) & (cj == 1)).alias(f"a10_{j}"),
                 F.count_if((ci == 1) & (cj == 2)).alias(f"a01_{j}"), F.count_if((ci == 1) & (cj == 1)).alias(f"a00_{j}")]
    per_i = rows.groupBy("i").agg(*aggs)
    cells = per_i.select("i", F.inline(F.array(*[F.struct(
        F.lit(j).alias("j"), *[F.col(f"{c}_{j}").alias(c) for c in ("a11", "a10", "a01", "a00")]) for j in range(m)])))
    names = F.create_map(*[x for i, (_, k, p) in enumerate(conds)
                           for x in (F.lit(i), F.lit(f"{MODEL_LABELS.get(k, k)} / Prompt {p}"))])
    n = F.col("a11") + F.col("a10") + F.col("a01") + F.col("a00")
    return (cells.where(F.col("i") < F.col("j")).withColumn("n", n.cast("bigint")).where(F.col("n") >= min_n)
            .select(F.element_at(names, F.col("i")).alias("system_A"), F.element_at(names, F.col("j")).alias("system_B"),
                    F.round(kappa_from_counts(F.col("a11"), F.col("a10"), F.col("a01"), F.col("a00")), 4).alias("kappa"),
                    "n"))


# ---------------------------------------------------------------- M8
def label_bias(wide: DataFrame) -> DataFrame:
    """Per condition: yes/no counts of annotator and gold on rows valid for both, bias in points."""
    lg = condition_long(wide).where(F.col("gold").isNotNull() & F.col("pred").isNotNull())
    agg = lg.groupBy("model_key", "prompt").agg(
        F.count(F.lit(1)).alias("n_valid"),
        F.count_if(F.col("pred") == 1).alias("pred_yes"),
        F.count_if(F.col("gold") == 1).alias("gold_yes"))
    return agg.select("model_key", "prompt", "n_valid", "pred_yes",
                      (F.col("n_valid") - F.col("pred_yes")).alias("pred_no"), "gold_yes",
                      F.round((F.col("pred_yes") - F.col("gold_yes")).cast(_D) / F.col("n_valid").cast(_D) * 100, 6).alias("bias_pct"))


# ---------------------------------------------------------------- M9
METRIC_COLS = ["accuracy", "precision", "recall", "f1", "specificity", "kappa"]


def metric_delta(summary: DataFrame, prompt_a: str = "Prompt C", prompt_b: str = "Prompt A") -> DataFrame:
    """Per model and metric: value under prompt_a, under prompt_b, and their difference."""
    melt = summary.select("model_key", "prompt", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRIC_COLS])))
    a = melt.where(F.col("prompt") == prompt_a).select("model_key", "metric", F.col("value").alias("value_a"))
    b = melt.where(F.col("prompt") == prompt_b).select("model_key", "metric", F.col("value").alias("value_b"))
    return (a.join(b, ["model_key", "metric"])
            .withColumn("delta", F.round(F.col("value_a") - F.col("value_b"), 4)))


# ---------------------------------------------------------------- M10 - M14
def mean_4dp(c: str) -> Column:
    """Mean of values rounded to 4 dp, summed exactly in units of 1e-4 (ties stay exact)."""
    return F.sum(F.round(F.col(c) * 10000).cast("bigint")).cast(_D) / F.count(c).cast(_D) / 10000.0


def rank_models(summary: DataFrame) -> DataFrame:
    agg = summary.groupBy("model_key").agg(
        mean_4dp("kappa").alias("kappa_mean"), F.stddev_samp("kappa").alias("kappa_std"),
        mean_4dp("f1").alias("f1_mean"), mean_4dp("accuracy").alias("accuracy_mean"))
    w = Window.orderBy(F.desc("kappa_mean"), "model_key")  # one row per model: tiny
    return agg.select(F.row_number().over(w).cast("bigint").alias("rank"), "model_key",
                      display_name(F.col("model_key")).alias("model_label"),
                      *[F.round(c, 6).alias(c) for c in ("kappa_mean", "kappa_std", "f1_mean", "accuracy_mean")])


def rank_prompts(summary: DataFrame) -> DataFrame:
    agg = summary.groupBy("prompt").agg(
        mean_4dp("kappa").alias("kappa_mean"), F.stddev_samp("kappa").alias("kappa_std"),
        mean_4dp("f1").alias("f1_mean"))
    w = Window.orderBy(F.desc("kappa_mean"), "prompt")
    return agg.select(F.row_number().over(w).cast("bigint").alias("rank"), "prompt",
                      *[F.round(c, 6).alias(c) for c in ("kappa_mean", "kappa_std", "f1_mean")])


def best_per_model(summary: DataFrame) -> DataFrame:
    """Argmax kappa per model, first prompt on ties."""
    w = Window.partitionBy("model_key").orderBy(F.desc_nulls_last("kappa"), "prompt")
    return (summary.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1)
            .select("model", "model_key", "prompt", "kappa", "f1", "accuracy"))


def best_overall(summary: DataFrame) -> DataFrame:
    m = rank_models(summary).where(F.col("rank") == 1).select(
        "rank", F.col("model_label").alias("best_model"), F.round("kappa_mean", 4).alias("best_model_kappa"))
    p = rank_prompts(summary).where(F.col("rank") == 1).select(
        "rank", F.col("prompt").alias("best_prompt"), F.round("kappa_mean", 4).alias("best_prompt_kappa"))
    return m.join(p, "rank").drop("rank")   # one row each, joined on rank = 1


def metric_matrix(summary: DataFrame, metric: str) -> DataFrame:
    """model x prompt matrix of one metric (fixed pivot values: no extra job)."""
    return (summary.groupBy("model").pivot("prompt", ["Prompt A", "Prompt B", "Prompt C"])
            .agg(F.first(metric))
            .select("model", *[F.col(f"Prompt {p}").alias(p) for p in "ABC"]))


# ---------------------------------------------------------------- M15 / M16 / M20
def errors_by(long: DataFrame, keys: list[str], min_n: int = 1) -> DataFrame:
    agg = long.groupBy("model", "prompt", *keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("correct") == 0).alias("errors"))
    return (agg.where(F.col("n") >= min_n)
            .withColumn("error_rate", F.round(F.col("errors").cast(_D) / F.col("n").cast(_D), 6))
            .withColumn("accuracy", F.round(1 - F.col("errors").cast(_D) / F.col("n").cast(_D), 6)))


def errors_by_author(long: DataFrame, top: int = 10, min_n: int = 5) -> DataFrame:
    e = errors_by(long, ["author"], min_n)
    w = Window.partitionBy("model", "prompt").orderBy(F.desc("error_rate"), "author")
    return e.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= top)


def coverage_rollup(long_all: DataFrame) -> DataFrame:
    """Coverage / yes-rate / error-rate at work, author, decade, period and total level."""
    valid = F.col("pred").isNotNull()
    long_all = long_all.withColumn("decade", (F.floor(F.col("year") / 10) * 10).cast("int"))
    return (long_all.rollup("period", "decade", "author", "work").agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(valid).alias("n_valid"),
        F.count_if(F.col("pred") == 1).alias("n_yes"))
        .withColumn("coverage", F.round(F.col("n_valid").cast(_D) / F.col("n_rows").cast(_D), 6))
        .withColumn("yes_rate", F.round(F.try_divide(F.col("n_yes").cast(_D), F.col("n_valid").cast(_D)), 6))
        .withColumn("error_rate", F.round(1 - F.col("n_valid").cast(_D) / F.col("n_rows").cast(_D), 6)))


# ---------------------------------------------------------------- M17
def disagreements(wide: DataFrame, col_v1: str, col_v2: str) -> DataFrame:
    """Where two annotators disagree: direction, count, share, and which side matches gold."""
    g, a, b = binarize(F.col("DIL")), binarize(F.col(col_v1)), binarize(F.col(col_v2))
    d = wide.select(g.alias("g"), a.alias("a"), b.alias("b")).where(
        F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    kind = F.when(F.col("a") == 1, "yes->no").otherwise("no->yes")
    agg = d.groupBy(kind.alias("direction")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("g") == F.col("a")).alias("v1_matches_gold"),
        F.count_if(F.col("g") == F.col("b")).alias("v2_matches_gold"))
    tot = F.sum("n").over(Window.partitionBy())  # <= 2 rows
    return agg.withColumn("share", F.round(F.col("n").cast(_D) / tot.cast(_D), 6))


# ---------------------------------------------------------------- M18 / M19
def outcome(gold: Column, pred: Column) -> Column:
    return (F.when((gold == 1) & (pred == 1), "TP").when((gold == 0) & (pred == 1), "FP")
            .when((gold == 1) & (pred == 0), "FN").when((gold == 0) & (pred == 0), "TN"))


def markers_by_outcome(scored: DataFrame, markers_col: str = "markers", by: tuple[str, ...] = ()) -> DataFrame:
    """Marker frequency per outcome class (within each `by` group) and its share of the class size."""
    keys = [*by, "outcome"]
    # equal lists are counted first, so both figures come from one pass over the rows
    lists = scored.groupBy(*keys, F.col(markers_col).alias("__list")).agg(F.count(F.lit(1)).alias("__n"))
    sized = lists.groupBy(*keys).agg(F.sum("__n").alias("class_size"))
    # the outer form: of the other Spark makes a filter that finds the markers once more
    counts = (lists.select(*keys, "__n", F.posexplode_outer("__list").alias("__at", "marker")).where(F.col("__at").isNotNull())
              .groupBy(*keys, "marker").agg(F.sum("__n").alias("n")))
    return (counts.join(sized, keys)
            .withColumn("share", F.round(F.col("n").cast(_D) / F.col("class_size").cast(_D), 6)))
