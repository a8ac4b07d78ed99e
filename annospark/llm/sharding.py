"""K-d tree partitioning of documents into shards of near-equal bytes.

Equal texts form a group that stays together; a group is a point whose
coordinates are metadata (log of its size, smallest document id, hash place of
its smallest source and of its smallest language) and whose weight is its
bytes.  A node with more than one leaf to come is split along its widest
dimension at the distributed weighted median (at a fraction of the weight, if
its leaves do not halve evenly) until every leaf holds about the target bytes.

The medians of all nodes of a level are found together by histograms: each pass sums
the weights of at most BINS bins per open node and goes on inside the bin where the
wanted weight is crossed, first over the coordinate, then, among equal coordinates,
over the content hash.  Nodes, bins and cuts are rows of tables; each level's points are
stored with their node, so neither plans nor the driver grow with the number of leaves.

Law: `bytes`.  A group heavier than a leaf is a shard of its own size.

Defined cases: a null text counts as empty (size 1, CRC of no bytes); null ids,
sources and languages take the place of -1 or of the empty string; repeated
rows are rows of one group; an empty table gives an empty result.  Only the
named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annospark.llm.common import slices, stored

BINS = 1024
DIMS = ("d_size", "d_id", "d_source", "d_lang")
GROUP = ("size", "text_crc32", "text_hash")


def place(c: Column) -> Column:
    """A string's place in [0, 1) by its CRC."""
    return F.crc32(F.coalesce(c, F.lit("")).cast("binary")) / F.lit(float(1 << 32))


def crossing(rows: DataFrame, value: Column, state: DataFrame) -> DataFrame:
    """Where the running weight of `value` reaches what its node wants: shard, at, want, w.

    rows: shard, weight and the value's columns; state: s_shard, lo, hi, want of every open node.  `want`
    comes back as what is left of it at the value `at`, whose rows weigh w.  Each pass sums at
    most BINS bins a node and goes on inside the bin that is crossed, until that holds a single value.
    """
    after = Window.partitionBy("s_shard").orderBy("bin")
    found, state = None, stored(state)
    while True:
        inside = rows.join(state, F.col("shard") == F.col("s_shard")).withColumn("value", value).where("value between lo and hi")
        place = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))
        bins = (inside.groupBy("s_shard", F.when(F.col("hi") > F.col("lo"), place).otherwise(0).alias("bin"))
                .agg(F.sum("weight").alias("w"), F.min("value").alias("b_lo"), F.max("value").alias("b_hi"), F.first("want").alias("want"))
                .withColumn("through", F.sum("w").over(after)))
        reached = F.col("through") >= F.col("want")
        # the first bin that reaches it; the last one if rounding lets none
        best = F.min(F.struct((~reached).alias("late"), F.when(reached, F.col("bin")).otherwise(-F.col("bin")).alias("nth"),
                              F.col("b_lo").alias("lo"), F.col("b_hi").alias("hi"), (F.col("want") - F.col("through") + F.col("w")).alias("want"), "w"))
        state = stored(bins.groupBy("s_shard").agg(best.alias("b")).select("s_shard", "b.lo", "b.hi", "b.want", "b.w"))
        done = state.where("lo = hi").select(F.col("s_shard").alias("c_shard"), F.col("lo").alias("at"), "want", "w")
        found = done if found is None else found.unionByName(done)
        state = state.where("lo < hi").drop("w")
        if state.isEmpty():
            return found


def kd_leaves(points: DataFrame, leaves: int) -> DataFrame:
    """`points` with their leaf number `shard`.

    A point's node is named by its first leaf; `open` is how many leaves it is to have.  Each level's
    cuts are rows that join the points by node, and its points are stored.
    """
    extent = points.agg(*[f(d).alias(f"{n}_{d}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max))]).first()
    span = {d: (extent[f"hi_{d}"] - extent[f"lo_{d}"]) or 1.0 for d in DIMS}
    points = points.withColumn("shard", F.lit(0)).withColumn("open", F.lit(leaves))
    widest = leaves
    while widest > 1:
        here = points.where("open > 1")
        nodes = stored(here.groupBy(F.col("shard").alias("s_shard")).agg(
            *[f(d).alias(f"{n}_{d}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max))],
            (F.sum("weight") * F.floor(F.first("open") / 2) / F.first("open")).alias("want")))
        width = [(F.col(f"hi_{d}") - F.col(f"lo_{d}")) / span[d] for d in DIMS]
        most = F.greatest(*width)
        axis = F.coalesce(*[F.when(w == most, F.lit(k + 1)) for k, w in enumerate(width)])
        choose = lambda names: F.element_at(F.array(*[F.col(c) for c in names]), F.col("axis"))
        nodes = nodes.withColumn("axis", axis)
        axes = nodes.select(F.col("s_shard").alias("a_shard"), "axis")
        valued = here.join(axes, F.col("shard") == F.col("a_shard")).select("shard", "weight", choose(DIMS).alias("coordinate"), "d_hash")
        state = nodes.select("s_shard", choose([f"lo_{d}" for d in DIMS]).alias("lo"), choose([f"hi_{d}" for d in DIMS]).alias("hi"), "want")
        at = stored(crossing(valued, F.col("coordinate"), state))
        ties = (valued.join(at.select("c_shard", "at"), (F.col("shard") == F.col("c_shard")) & (F.col("coordinate") == F.col("at")))
                .select("shard", "weight", "d_hash"))
        among = at.select(F.col("c_shard").alias("s_shard"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), "want")
        hashes = crossing(ties, F.col("d_hash"), among).select(
            F.col("c_shard").alias("h_shard"), F.col("at").alias("h_at"), (F.col("want") >= F.col("w") / 2).alias("keep"))
        cuts = (at.select("c_shard", "at").join(hashes, F.col("c_shard") == F.col("h_shard")).join(axes, F.col("c_shard") == F.col("a_shard"))
                .select("c_shard", "at", "h_at", "keep", "axis"))
        value = choose(DIMS)
        right = (value > F.col("at")) | ((value == F.col("at")) & (
            (F.col("d_hash") > F.col("h_at")) | ((F.col("d_hash") == F.col("h_at")) & ~F.col("keep"))))
        half = F.floor(F.col("open") / 2).cast("int")
        moved = F.when(F.col("open") > 1, F.coalesce(right, F.lit(False)))
        points = stored(points.join(cuts, F.col("shard") == F.col("c_shard"), "left").select(
            *GROUP, "weight", *DIMS, "d_hash", (F.col("shard") + F.when(moved, half).otherwise(0)).alias("shard"),
            F.when(moved, F.col("open") - half).when(F.col("open") > 1, half).otherwise(F.col("open")).alias("open")))
        widest -= widest // 2
    return points


def kd_shards(docs: DataFrame, *, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id",
              text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    Give the number of shards, or the bytes a leaf should hold.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"),
        F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang")))
    points = stored(rows.groupBy(*GROUP).agg(
        F.sum("size").alias("weight"), F.count(F.lit(1)).alias("n"),
        F.log2(F.first("size").cast("double")).alias("d_size"),
        F.coalesce(F.min("doc_id"), F.lit(-1)).cast("double").alias("d_id"),
        place(F.min("source")).alias("d_source"), place(F.min("lang")).alias("d_lang"))
        .withColumn("d_hash", (F.shiftrightunsigned("text_hash", 11)) / F.lit(float(1 << 53))))
    total = points.agg(F.sum("weight").alias("w"), F.sum("n").alias("n")).first()
    leaves = shards or max(1, -(-(total.w or 0) // target_bytes))
    leaf = kd_leaves(points, leaves) if total.n else points.withColumn("shard", F.lit(0))
    where = leaf.select(*[F.col(c).alias(f"g_{c}") for c in GROUP], F.col("shard").cast("int").alias("shard"))
    key = [F.col(c) == F.col(f"g_{c}") for c in GROUP]
    placed = rows.join(where, key[0] & key[1] & key[2]).select(
        "doc_id", "size", "text_crc32", "text_hash", "shard",
        F.pmod(F.xxhash64("doc_id"), F.lit(slices(total.n or 0))).alias("slice"))
    placed = stored(placed)
    earlier = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
               .select(F.col("shard").alias("o_shard"), F.col("slice").alias("o_slice"),
                       F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")))
    order = Window.partitionBy("shard", "slice").orderBy("doc_id", "size", "text_crc32", "text_hash")
    return (placed.join(offsets, (F.col("shard") == F.col("o_shard")) & (F.col("slice") == F.col("o_slice")))
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("offset") + F.row_number().over(order) - 1).cast("bigint").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
