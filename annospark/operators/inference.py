"""Inferential and stability statistics over the long fact, as Spark jobs.

Design notes (scale):
  * Confusion counts are additive, so every resampling statistic is built
    from per-(cluster, condition) counts computed once with partial
    aggregation; the resampling itself touches only clusters x replicates.
  * Global orderings (Holm, ranks) run on aggregated tables whose size is
    the number of contrasts or clusters, never on block-level rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annospark.constants import (COMMERCIAL_MODELS, CONTRAST_MODEL_PAIRS, HIGHCONF_MODELS,
                                 MODEL_ORDER, PERIOD_LABELS, PREVALENCE_NEG, PREVALENCE_POS,
                                 PREVALENCE_TOTAL)
from annospark.functions.hashing import h_parts
from annospark.operators.joins import grows
from annospark.operators.metrics import kappa_from_counts
from annospark.session import checkpoint_dir

_D = "double"
#: Distinct values per block when ranks are summed.
RANK_BLOCK = 100_000

# FIXED VALUES: names of the decision rules of the period-stability table.
HIGHCONF_SUFFIX = ", solo alta confidenza"
VOTE_RULES = ["maggioranza tre commerciali", "unanimità tre commerciali", "unanimità cinque modelli"]


# ---------------------------------------------------------------- counts
def cluster_counts(lf: DataFrame, cluster: str = "doc_id") -> DataFrame:
    """Per (cluster, model, prompt): TP, FN, FP, TN of pred against gold."""
    g, p = F.col("gold"), F.col("pred")
    return lf.groupBy(cluster, "model", "prompt").agg(
        F.count_if((g == 1) & (p == 1)).alias("TP"), F.count_if((g == 1) & (p == 0)).alias("FN"),
        F.count_if((g == 0) & (p == 1)).alias("FP"), F.count_if((g == 0) & (p == 0)).alias("TN"))


def _kappa_cols(prefix: str = "") -> F.Column:
    c = lambda n: F.col(prefix + n)
    return kappa_from_counts(c("TP"), c("FN"), c("FP"), c("TN"))


# ---------------------------------------------------------------- I2
def cluster_counts_checkpointed(spark: SparkSession, lf: DataFrame, cluster: str = "doc_id") -> DataFrame:
    """Per-cluster counts, materialised once in the shared checkpoint folder (clusters x conditions rows)."""
    checkpoint_dir(spark)
    return cluster_counts(lf, cluster).checkpoint(eager=True)


def numbered(df: DataFrame, by: str) -> DataFrame:
    """`df` of distinct `by` with k = 0, 1, ... in that order: ranks inside range partitions plus the
    partitions' offsets, so that no task orders the whole table."""
    parts = df.repartitionByRange(by).withColumn("__part", F.spark_partition_id()).checkpoint(eager=True)
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))     # one row per partition
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__part").orderBy(by)) - 1
    return parts.withColumn("__nth", nth).join(offsets, "__part").withColumn("k", F.col("__before") + F.col("__nth")) \
                .drop("__part", "__nth", "__before")


def bootstrap_replicates(spark: SparkSession, lf: DataFrame, n_boot: int = 2000, seed: int = 42,
                         cluster: str = "doc_id", counts: DataFrame | None = None) -> DataFrame:
    """(b, model, prompt, kappa) for n_boot cluster-bootstrap replicates.

    Replicate b draws D clusters with replacement: draw j picks cluster
    h(seed|b|j) mod D.  Draws are generated by `spark.range` (no driver
    loop), folded to multiplicities per (b, cluster), then joined with the
    additive per-cluster counts.  Rows handled: n_boot x D x conditions,
    independent of the number of blocks.
    """
    counts = counts if counts is not None else cluster_counts_checkpointed(spark, lf, cluster)
    checkpoint_dir(spark)
    idx = numbered(counts.select(cluster).distinct(), cluster).checkpoint(eager=True)
    n_clusters = idx.count()
    draws = (spark.range(n_boot * n_clusters)
             .select(F.expr(f"id div {n_clusters}").alias("b"), F.expr(f"id % {n_clusters}").alias("j"))
             .select("b", (h_parts(F.lit(seed), "b", "j") % n_clusters).alias("k"))
             .groupBy("b", "k").agg(F.count(F.lit(1)).alias("mult")))
    # the counts take their cluster's number first, so the draws are joined once; the planner picks the join
    rep = (draws.join(counts.join(idx, cluster), "k")
           .groupBy("b", "model", "prompt")
           .agg(*[F.sum(F.col(c) * F.col("mult")).alias(c) for c in ("TP", "FN", "FP", "TN")]))
    return rep.select("b", "model", "prompt", _kappa_cols().alias("kappa"))


def point_kappa(lf: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    c = (counts if counts is not None else cluster_counts(lf)).groupBy("model", "prompt").agg(
        *[F.sum(x).alias(x) for x in ("TP", "FN", "FP", "TN")])
    return c.select("model", "prompt", _kappa_cols().alias("kappa"))


def bootstrap_kappa(spark: SparkSession, lf: DataFrame, n_boot: int = 2000, seed: int = 42,
                    replicates: DataFrame | None = None) -> DataFrame:
    """Point kappa on all rows and the 2.5 / 97.5 percentile interval (linear interpolation)."""
    counts = cluster_counts_checkpointed(spark, lf)
    rep = replicates if replicates is not None else bootstrap_replicates(spark, lf, n_boot, seed, counts=counts)
    ci = rep.groupBy("model", "prompt").agg(F.percentile("kappa", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return (point_kappa(lf, counts).join(ci, ["model", "prompt"])
            .select(F.col("model").alias("modello"), "prompt", F.round("kappa", 6).alias("kappa"),
                    F.round(F.col("q")[0], 6).alias("ic_inf"), F.round(F.col("q")[1], 6).alias("ic_sup")))


#: A hash of 32 bits counts 0, 1, 2, ... for Poisson(1) by how many of these it reaches: the cumulative probabilities in 2^-32.
POISSON_STEPS = [int(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 2 ** 32) for k in range(12)]


def poisson_weight(u: Column) -> Column:
    return sum((F.when(u >= step, 1).otherwise(0) for step in POISSON_STEPS), F.lit(0))


def poisson_replicates(lf: DataFrame, n_boot: int = 2000, seed: int = 42, cluster: str = "doc_id") -> DataFrame:
    """(b, model, prompt, kappa) of n_boot Poisson bootstrap replicates.

    In replicate b a cluster counts Poisson(1) times, by h(seed|b|cluster); nothing is numbered or drawn beforehand.
    A cluster's counts are one row, whose weights are made and summed where it is: one pass, and only sums
    per (replicate, condition) are shuffled.
    """
    cells = cluster_counts(lf, cluster).groupBy(cluster).agg(F.collect_list(F.struct("model", "prompt", "TP", "FN", "FP", "TN")).alias("cells"))
    drawn = (cells.select(cluster, "cells", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b"))
             .select("cells", "b", poisson_weight(h_parts(F.lit(seed), "b", cluster)).alias("w")).where("w > 0"))
    rep = (drawn.select("b", "w", F.inline("cells")).groupBy("b", "model", "prompt")
           .agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in ("TP", "FN", "FP", "TN")]))
    return rep.select("b", "model", "prompt", _kappa_cols().alias("kappa"))


def bootstrap_poisson(lf: DataFrame, n_boot: int = 2000, seed: int = 42) -> DataFrame:
    """`bootstrap_kappa` with Poisson weights: for very many clusters."""
    ci = poisson_replicates(lf, n_boot, seed).groupBy("model", "prompt").agg(F.percentile("kappa", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return (point_kappa(lf).join(ci, ["model", "prompt"])
            .select(F.col("model").alias("modello"), "prompt", F.round("kappa", 6).alias("kappa"),
                    F.round(F.col("q")[0], 6).alias("ic_inf"), F.round(F.col("q")[1], 6).alias("ic_sup")))


# ---------------------------------------------------------------- I3 / I4
def contrast_table(spark: SparkSession) -> DataFrame:
    rows = [(f"{a} C - {b} C", a, "C", b, "C") for a, b in CONTRAST_MODEL_PAIRS]
    for m in MODEL_ORDER:
        rows += [(f"{m} C - {m} A", m, "C", m, "A"), (f"{m} B - {m} A", m, "B", m, "A")]
    return spark.createDataFrame(rows, "contrasto string, m1 string, p1 string, m2 string, p2 string")


def bootstrap_contrasts(spark: SparkSession, lf: DataFrame, n_boot: int = 2000, seed: int = 42,
                        replicates: DataFrame | None = None) -> DataFrame:
    """Paired contrasts on the same draws: delta, percentile CI, two-sided p, Holm-adjusted p."""
    counts = cluster_counts_checkpointed(spark, lf)
    rep = replicates if replicates is not None else bootstrap_replicates(spark, lf, n_boot, seed, counts=counts)
    # replicates: n_boot x conditions rows, materialised once and reused by both sides of the pairing
    rep = rep.checkpoint(eager=True)
    con = F.broadcast(contrast_table(spark))  # fixed 16 rows
    r1 = rep.select("b", F.col("model").alias("m1"), F.col("prompt").alias("p1"), F.col("kappa").alias("k1"))
    r2 = rep.select("b", F.col("model").alias("m2"), F.col("prompt").alias("p2"), F.col("kappa").alias("k2"))
    d = (con.join(r1, ["m1", "p1"]).join(r2, ["b", "m2", "p2"])
         .select("contrasto", (F.col("k1") - F.col("k2")).alias("d")))
    stats = d.groupBy("contrasto").agg(
        F.percentile("d", F.array(F.lit(0.025), F.lit(0.975))).alias("q"),
        F.avg((F.col("d") <= 0).cast(_D)).alias("le"), F.avg((F.col("d") >= 0).cast(_D)).alias("ge"))
    pk = point_kappa(lf, counts)
    delta = (con.join(pk.select(F.col("model").alias("m1"), F.col("prompt").alias("p1"), F.col("kappa").alias("k1")), ["m1", "p1"])
             .join(pk.select(F.col("model").alias("m2"), F.col("prompt").alias("p2"), F.col("kappa").alias("k2")), ["m2", "p2"])
             .select("contrasto", (F.col("k1") - F.col("k2")).alias("delta_kappa")))
    out = (delta.join(stats, "contrasto")
           .select("contrasto", "delta_kappa", F.col("q")[0].alias("ic_inf"), F.col("q")[1].alias("ic_sup"),
                   F.least(F.lit(1.0), 2 * F.least("le", "ge")).alias("p")))
    out = holm(out, "p")
    return out.select("contrasto", *[F.round(c, 6).alias(c) for c in ("delta_kappa", "ic_inf", "ic_sup", "p", "p_holm")])


def holm(df: DataFrame, p_col: str = "p", tie: str = "contrasto") -> DataFrame:
    """Holm step-down: running max of min(1, (m - j) * p_(j)) in ascending p order.

    The ordering window spans the table of tests (m rows), not data rows.
    """
    w = Window.orderBy(F.col(p_col), F.col(tie))
    m = F.count(F.lit(1)).over(Window.partitionBy())
    x = df.withColumn("__j", F.row_number().over(w) - 1).withColumn("__m", m)
    x = x.withColumn("__a", F.least(F.lit(1.0), (F.col("__m") - F.col("__j")).cast(_D) * F.col(p_col)))
    run = F.max("__a").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return x.withColumn("p_holm", run).drop("__j", "__m", "__a")


# ---------------------------------------------------------------- I7 - I9
def rule_rows(lf: DataFrame, kind: str) -> DataFrame:
    """(rule, gold, period, f) rows feeding the stability table, prompt C only."""
    c = lf.where(F.col("prompt") == "C")
    if kind == "model":
        return c.select(F.col("model").alias("rule"), "gold", "period", (F.col("pred") == 1).cast("int").alias("f"))
    if kind == "highconf":
        return (c.where(F.col("model").isin(HIGHCONF_MODELS))
                .select(F.concat("model", F.lit(HIGHCONF_SUFFIX)).alias("rule"), "gold", "period",
                        ((F.col("pred") == 1) & F.col("high")).cast("int").alias("f")))
    if kind == "votes":
        v = votes(lf)
        return v.select("gold", "period", F.inline(F.array(
            F.struct(F.lit(VOTE_RULES[0]).alias("rule"), F.col("majority3").cast("int").alias("f")),
            F.struct(F.lit(VOTE_RULES[1]).alias("rule"), F.col("unanimity3").cast("int").alias("f")),
            F.struct(F.lit(VOTE_RULES[2]).alias("rule"), F.col("unanimity5").cast("int").alias("f")))))
    raise ValueError(kind)


def votes(lf: DataFrame, models: list[str] = COMMERCIAL_MODELS) -> DataFrame:
    """Per block at prompt C: yes votes of the listed models and of all models (missing = 0)."""
    c = lf.where(F.col("prompt") == "C")
    # gold and period are block attributes: grouping keys, not string aggregates (keeps a hash aggregate)
    return (c.groupBy("block_id", "gold", "period").agg(
        F.sum(F.when(F.col("model").isin(models), F.col("pred")).otherwise(0)).alias("yes_commercial"),
        F.sum("pred").alias("yes_all"))
        .withColumn("majority3", F.col("yes_commercial") >= 2)
        .withColumn("unanimity3", F.col("yes_commercial") == 3)
        .withColumn("unanimity5", F.col("yes_all") == 5))


def stability(rows: DataFrame, periods: list[str] = PERIOD_LABELS, base_rate: float = 0.03) -> DataFrame:
    """Recall, specificity and recall per period, delta_sp and its equivalent effect, per rule."""
    f, g, per = F.col("f").cast(_D), F.col("gold"), F.col("period")
    aggs = [F.avg(F.when(g == 1, f)).alias("recall")]
    for p in periods:
        aggs += [(1 - F.avg(F.when((g == 0) & (per == p), f))).alias(f"sp_{p}"),
                 F.avg(F.when((g == 1) & (per == p), f)).alias(f"rec_{p}")]
    out = rows.groupBy(F.col("rule").alias("regola")).agg(*aggs)
    out = out.withColumn("delta_sp", F.col(f"sp_{periods[-1]}") - F.col(f"sp_{periods[0]}"))
    out = out.withColumn("effetto_equivalente_punti",
                         F.try_divide(-F.col("delta_sp") * (1 - base_rate), F.col("recall")) * 100)
    return out.select("regola", *[F.round(c, 6).alias(c) for c in out.columns if c != "regola"])


# ---------------------------------------------------------------- I10
def ppv(lf: DataFrame) -> DataFrame:
    """Sensitivity, specificity and PPV at the true prevalence; expected counts (half-even)."""
    c = lf.where(F.col("prompt") == "C")
    agg = c.groupBy(F.col("model").alias("modello")).agg(
        F.avg(F.when(F.col("gold") == 1, F.col("correct").cast(_D))).alias("recall"),
        F.avg(F.when(F.col("gold") == 0, F.col("correct").cast(_D))).alias("specificita"))
    prev = PREVALENCE_POS / PREVALENCE_TOTAL
    se, sp = F.col("recall"), F.col("specificita")
    return agg.select(
        "modello", F.round(se, 6).alias("recall"), F.round(sp, 6).alias("specificita"),
        F.round(F.try_divide(se * prev, se * prev + (1 - sp) * (1 - prev)), 6).alias("ppv_prevalenza_reale"),
        F.bround(se * PREVALENCE_POS, 0).cast("bigint").alias("blocchi_dil_recuperati_su_865"),
        F.bround((1 - sp) * PREVALENCE_NEG, 0).cast("bigint").alias("segnalazioni_non_confermate"))


# ---------------------------------------------------------------- I12 / I13 / I14
def doc_specificity(lf: DataFrame, n_models: int = 5) -> DataFrame:
    """Per document at prompt C: year, negatives per model, specificity."""
    c = lf.where(F.col("prompt") == "C")
    return c.groupBy("doc_id").agg(
        F.first("year").alias("year"),
        (F.count_if(F.col("gold") == 0).cast(_D) / n_models).alias("nneg"),
        F.avg(F.when(F.col("gold") == 0, F.col("correct").cast(_D))).alias("sp"))


def spearman_year(lf: DataFrame, min_neg: float = 5) -> DataFrame:
    """Spearman rho of year vs per-document specificity (average ranks), documents with >= min_neg negatives."""
    checkpoint_dir(lf.sparkSession)
    d = doc_specificity(lf).where(F.col("nneg") >= min_neg)

    d = d.select("year", "sp").checkpoint(eager=True)

    def ranks(col):
        """Average rank of each distinct value: the rows below it and the middle of its own."""
        per = numbered(d.groupBy(col).agg(F.count(F.lit(1)).alias("__n")), col)
        block = F.floor(F.col("k") / RANK_BLOCK)
        sums = per.groupBy(block.alias("__b")).agg(F.sum("__n").alias("__s"))    # one row per RANK_BLOCK values
        lower = F.sum("__s").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
        inside = F.sum("__n").over(Window.partitionBy("__b").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
        full = per.withColumn("__b", block).join(sums.select("__b", F.coalesce(lower, F.lit(0)).alias("__lower")), "__b")
        rank = F.col("__lower") + F.coalesce(inside, F.lit(0)) + (F.col("__n") + 1) / 2.0
        return full.select(F.col(col).alias(f"__{col}"), rank.alias(f"r_{col}"))

    r = (d.join(ranks("year"), F.col("year").eqNullSafe(F.col("__year")))
         .join(ranks("sp"), F.col("sp").eqNullSafe(F.col("__sp")))
         .select(F.col("r_year").alias("ry"), F.col("r_sp").alias("rs")))
    return r.agg(F.round(F.corr("ry", "rs"), 6).alias("rho"), F.count(F.lit(1)).alias("romanzi"))


def leave_one_out(lf: DataFrame, periods: list[str] = PERIOD_LABELS) -> DataFrame:
    """Min / max over documents of delta_sp (last - first period) with that document left out."""
    c = lf.where(F.col("prompt") == "C")
    first, last = periods[0], periods[-1]
    neg = F.col("gold") == 0
    per_doc = c.groupBy("doc_id").agg(
        F.sum(F.when(neg & (F.col("period") == first), F.col("correct")).otherwise(0)).alias("s1"),
        F.count_if(neg & (F.col("period") == first)).alias("n1"),
        F.sum(F.when(neg & (F.col("period") == last), F.col("correct")).otherwise(0)).alias("s2"),
        F.count_if(neg & (F.col("period") == last)).alias("n2"))
    # corpus totals as four scalars (one aggregate), then each document's leave-out values
    tot = per_doc.agg(*[F.sum(k).alias(k) for k in ("s1", "n1", "s2", "n2")]).first()
    x = per_doc.select(*[(F.lit(float(tot[k] or 0)) - F.col(k).cast(_D)).alias(k) for k in ("s1", "n1", "s2", "n2")])
    delta = F.try_divide(F.col("s2"), F.col("n2")) - F.try_divide(F.col("s1"), F.col("n1"))
    return x.agg(F.round(F.min(delta), 6).alias("min_delta_sp"), F.round(F.max(delta), 6).alias("max_delta_sp"))


# ---------------------------------------------------------------- I5 / I6 sufficient statistics
def block_signatures(rows: DataFrame, cond: F.Column, extra_sig: F.Column | None = None) -> DataFrame:
    """Per block: k = successes, m = observations, signature = sorted condition list (+ extra),
    and the list of conditions answered correctly.

    Blocks without variation (k = 0 or k = m) carry no conditional likelihood
    and are dropped; the rest are grouped by (signature, k).  Lists are
    bounded by the number of conditions.
    """
    b = rows.groupBy("block_id").agg(
        F.sum("correct").alias("k"), F.count(F.lit(1)).alias("m"),
        F.array_join(F.sort_array(F.collect_list(cond)), ",").alias("sig"),
        F.collect_list(F.when(F.col("correct") == 1, cond)).alias("succ"),
        *([F.max(extra_sig).alias("extra")] if extra_sig is not None else []))
    if extra_sig is not None:
        b = b.withColumn("sig", F.concat_ws("#", "sig", "extra"))
    return b.where((F.col("k") > 0) & (F.col("k") < F.col("m")))


def clogit_stats(rows: DataFrame, cond: F.Column, extra_sig: F.Column | None = None) -> DataFrame:
    """(signature, k, n_blocks): the sufficient statistics of the conditional logit."""
    return (block_signatures(rows, cond, extra_sig).groupBy("sig", "k")
            .agg(F.count(F.lit(1)).alias("n_blocks")).withColumnRenamed("sig", "signature"))


def informative_blocks(lf: DataFrame) -> DataFrame:
    """Per model: blocks whose prompts disagree in correctness (min <> max)."""
    b = lf.groupBy("model", "block_id").agg(F.min("correct").alias("lo"), F.max("correct").alias("hi"))
    return b.groupBy(F.col("model").alias("modello")).agg(
        F.count_if(F.col("lo") != F.col("hi")).alias("blocchi_informativi"))


def clogit_score(lf: DataFrame) -> DataFrame:
    """Score test at beta 0 of the conditional logit by block, condition by condition: (model, prompt, n_blocks, u, v, z).

    Given k right answers among a block's m, each condition is right with probability k / m: u sums right
    minus expected, v the variances k (m - k) / m^2.  Closed sums over any number of signatures.
    """
    per_block = lf.groupBy("block_id").agg(F.count(F.lit(1)).alias("m"), F.sum("correct").alias("k")).where("k > 0 and k < m")
    rows = lf.select("block_id", "model", "prompt", "correct").join(grows(per_block), "block_id")
    # m takes few values: sums of whole numbers by m keep the result the same in any order
    sums = rows.groupBy("model", "prompt", "m").agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("right"), F.sum("k").alias("k"),
                                                    F.sum(F.col("k") * (F.col("m") - F.col("k"))).alias("kv"))
    total = sums.groupBy("model", "prompt").agg(
        F.sum("n").alias("n_blocks"), F.array_sort(F.collect_list(F.struct(
            "m", (F.col("right").cast(_D) - F.col("k").cast(_D) / F.col("m")).alias("u"), (F.col("kv").cast(_D) / (F.col("m") * F.col("m"))).alias("v")))).alias("by_m"))
    add = lambda f: F.aggregate("by_m", F.lit(0.0), lambda acc, x: acc + x[f])
    return total.select("model", "prompt", "n_blocks", add("u").alias("u"), add("v").alias("v")).select(
        "model", "prompt", "n_blocks", F.round("u", 6).alias("u"), F.round("v", 6).alias("v"),
        F.round(F.try_divide(F.col("u"), F.sqrt("v")), 6).alias("z"))
