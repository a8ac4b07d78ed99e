"""Mixing sources to target weights by weighted fair queueing.

Every source is one queue of its documents in a hash-shuffled order, repeated
up to `max_repeats` times.  A document's virtual finish time is the number of
words its source has sent by then, divided by the source's target.  All copies
are ordered by that time and the mix is the longest prefix of this order whose
words stay within the total budget.

Targets are filled like connected vessels: a source's share of the budget is
in proportion to its weight, stops at `max_repeats` times the source's size,
and the excess goes to the other sources by weight.

Both running sums are distributed.  Inside a source they run over slices of
the shuffle hash, so a source that holds a third of all rows is many slices;
globally only the slice of virtual time in which the budget ends is ordered.

Defined cases: a null text has size 0; rows of size 0 are never taken; a null
source is a source of its own and comes last; null document ids sort first;
repeated rows are separate documents; an empty table gives an empty result.
Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annospark.functions.hashing import h, sql_h
from annospark.llm.common import WORD, same, slices, stored, word_count

HASH_SPACE = 1 << 32


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int, budget: float) -> DataFrame:
    """(source, source_size) -> also rank, weight, target.  One row per source: a configured dimension."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), F.col("rank") % len(weights) + 1)
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", w.cast("bigint"))
    cap = F.lit(max_repeats).cast("bigint") * F.col("source_size")
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (ranked.withColumn("cap", cap)
              .withColumn("place", F.row_number().over(by_cap))
              .withColumn("rest", F.lit(budget) * F.sum("source_size").over(whole)
                          - F.coalesce(F.sum("cap").over(before), F.lit(0)))
              .withColumn("rest_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
              .withColumn("open", F.col("rest") * F.col("weight") <= F.col("cap") * F.col("rest_weight")))
    first = F.min(F.when(F.col("open"), F.struct("place", "rest", "rest_weight"))).over(whole)
    return (filled.withColumn("level", first)
            .select("source", "source_size", "rank", "weight",
                    F.when(F.col("place") < F.coalesce(F.col("level.place"), F.lit(1 << 30)), F.col("cap").cast("double"))
                    .otherwise(F.col("weight") * F.col("level.rest") / F.col("level.rest_weight")).alias("target")))


def queue_positions(rows: DataFrame, targets: DataFrame, n_rows: int) -> DataFrame:
    """Adds `sent`: the words of the source up to and including this row in its shuffled order, and a row key."""
    n = slices(n_rows)
    rows = rows.withColumn("slice", F.expr(f"key * {n} div {HASH_SPACE}"))
    per_slice = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    t = targets.withColumnRenamed("source", "t_source")
    offsets = (per_slice.withColumn("offset", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)))
               .join(t, same(F.col("source"), F.col("t_source")))
               .select(F.col("source").alias("o_source"), F.col("slice").alias("o_slice"), "offset", "source_size", "rank", "target"))
    order = Window.partitionBy("rank", "slice").orderBy("key", "doc_id", "size")
    return (rows.join(offsets, same(F.col("source"), F.col("o_source")) & (F.col("slice") == F.col("o_slice")))
            .withColumn("sent", F.col("offset") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("nth", F.row_number().over(order))
            .drop("o_source", "o_slice", "offset"))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None,
                text_col: str = "text", weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3,
                budget: float = 1.0) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    `weights` go to the sources in code point order, repeating; `budget` is a
    share of all words.
    """
    size = word_count(F.col(text_col)) if size is None else size
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                              F.coalesce(size, F.lit(0)).cast("bigint").alias("size"),
                              F.coalesce(h(id_col), F.lit(0)).alias("key")))
    n_rows = rows.count()
    time_slices = slices(n_rows * max_repeats)    # of about SLICE_ROWS copies at any size of the corpus
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats, budget)
    queued = stored(queue_positions(rows, targets, n_rows))

    copies = (queued.where("size > 0").select("rank", "slice", "nth", "size", F.col("key"), F.col("doc_id"), F.explode(F.sequence(
        F.lit(0), F.lit(max_repeats - 1))).alias("copy"), "sent", "source_size", "target")
        .withColumn("finish", (F.col("copy") * F.col("source_size") + F.col("sent")) / F.col("target"))
        .withColumn("tick", F.least(F.floor(F.col("finish") * time_slices), F.lit(2 * time_slices))))
    running = Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    total = F.floor(F.lit(budget) * F.sum("size")).alias("budget")
    ticks = (copies.groupBy("tick").agg(F.sum("size").alias("words"))          # at most 2 * time_slices + 1 rows
             .withColumn("through", F.sum("words").over(running)))
    edge = (ticks.crossJoin(queued.agg(total)).where("through > budget")        # one-row side
            .agg(F.min(F.struct("tick", (F.col("budget") - F.col("through") + F.col("words")).alias("left"))).alias("edge"))
            .first()["edge"])
    last, left = (edge["tick"], edge["left"]) if edge else (1 << 60, 0)
    in_order = Window.orderBy("finish", "rank", "copy", "key", "doc_id", "slice", "nth")
    edge_rows = (copies.where(F.col("tick") == last)
                 .withColumn("through", F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
                 .where(F.col("through") <= left)
                 .groupBy(F.col("rank").alias("e_rank"), F.col("slice").alias("e_slice"), F.col("nth").alias("e_nth"))
                 .agg(F.count(F.lit(1)).alias("at_edge")))
    surely = sum((F.when(F.least(F.floor((c * F.col("source_size") + F.col("sent")) / F.col("target") * time_slices),
                                 F.lit(2 * time_slices)) < last, 1).otherwise(0) for c in range(max_repeats)), F.lit(0))
    n_copies = F.when(F.col("size") > 0, surely + F.coalesce(F.col("at_edge"), F.lit(0))).otherwise(F.lit(0))
    return (queued.join(edge_rows, (F.col("rank") == F.col("e_rank")) & (F.col("slice") == F.col("e_slice"))
                        & (F.col("nth") == F.col("e_nth")), "left")
            .withColumn("copies", n_copies.cast("bigint"))
            .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")))


def oracle(table: str = "documents", *, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> str:
    """The same mix in DuckDB SQL, with plain windows instead of slices (one copy of the whole order)."""
    weight = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return f"""
WITH rows_ AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         coalesce({sql_h('doc_id')}, 0) AS key, row_number() OVER () AS rid
  FROM {table}),
s1 AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows_ GROUP BY source),
s2 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM s1),
s3 AS (SELECT *, (CASE rnk % {len(weights)} {weight} END)::BIGINT AS weight, {max_repeats} * source_size AS cap FROM s2),
s4 AS (SELECT *, row_number() OVER w AS place, sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS rest_weight
       FROM s3 WINDOW w AS (ORDER BY cap / weight, rnk), b AS (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lvl AS (SELECT place, rest, rest_weight FROM s4 WHERE rest * weight <= cap * rest_weight ORDER BY place LIMIT 1),
targets AS (SELECT s4.source, s4.source_size, s4.rnk,
         CASE WHEN s4.place < lvl.place THEN s4.cap::DOUBLE ELSE s4.weight * lvl.rest::DOUBLE / lvl.rest_weight::DOUBLE END AS target
       FROM s4 LEFT JOIN lvl ON true),
queued AS (SELECT r.*, t.source_size, t.rnk, t.target,
         sum(r.size) OVER (PARTITION BY t.rnk ORDER BY r.key, r.doc_id NULLS FIRST, r.size, r.rid ROWS UNBOUNDED PRECEDING) AS sent
       FROM rows_ r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT rid, doc_id, size, key, rnk, c.copy, (c.copy * source_size + sent)::DOUBLE / target AS finish, sent
       FROM queued, (SELECT unnest(range({max_repeats})) AS copy) c WHERE size > 0),
ordered AS (SELECT rid, size, sum(size) OVER (ORDER BY finish, rnk, copy, key, doc_id NULLS FIRST, sent ROWS UNBOUNDED PRECEDING) AS through FROM copies),
picked AS (SELECT rid, count(*) AS n FROM ordered WHERE through <= (SELECT sum(size) FROM rows_) GROUP BY rid)
SELECT q.doc_id, q.source, q.size, q.source_size::BIGINT AS source_size, q.target,
       coalesce(p.n, 0)::BIGINT AS copies, (q.size * coalesce(p.n, 0))::BIGINT AS taken
FROM queued q LEFT JOIN picked p ON q.rid = p.rid"""
