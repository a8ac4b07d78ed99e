"""Connected components of a table of links, as rounds of joins and aggregates.

A round points every vertex to the smallest id among itself and its neighbours,
follows the pointers to their ends by doubling, and replaces the ends of all links
by what they point to; links inside one set vanish, equal ones merge, and each
round at least halves the sets that are left.  A hot vertex is only the key of
partial aggregates and of joins that may be split; nothing reaches the driver but
whether rows are left.  Every step is written to the shared folder.

Defined cases: links with a null end or to itself are ignored; repeated links
count once; no links give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annospark.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (id, component): every id that has a link, and the smallest id it reaches."""
    def oriented(rows: DataFrame) -> DataFrame:
        return stored(rows.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    links, label = oriented(links), None
    while label is None or not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("up")))
        while True:
            next_ = to.select(F.col("id").alias("n_id"), F.col("up").alias("further"))
            jumped = stored(to.join(next_, F.col("up") == F.col("n_id")).select("id", F.col("further").alias("up"), F.col("up").alias("was")))
            to = jumped.select("id", "up")
            if jumped.where("up <> was").isEmpty():
                break
        a_to, b_to = to.select(F.col("id").alias("a_id"), F.col("up").alias("a_up")), to.select(F.col("id").alias("b_id"), F.col("up").alias("b_up"))
        links = oriented(links.join(a_to, F.col("a") == F.col("a_id")).join(b_to, F.col("b") == F.col("b_id"))
                         .select(F.col("a_up").alias("a"), F.col("b_up").alias("b")))
        label = to.withColumnRenamed("up", "component") if label is None else stored(
            label.join(a_to, F.col("component") == F.col("a_id"), "left").select("id", F.coalesce("a_up", "component").alias("component")))
    return label
