"""Exact top-k inner products with norm buckets.

Vectors are turned into integers, floor(SCALE * x), and grouped by length: a
bucket is a quarter of an octave of the norm, dealt into blocks of about
BLOCK_ROWS vectors.  Queries are dealt into blocks of about QUERY_ROWS.  A first
pass over one block gives each query a score that its k-th best reaches at least.
A bucket whose greatest norm times the query's norm stays below that score is
skipped.  In the others the score, divided by both norms, is the local cosine
threshold: below COORDINATE it prunes by length (candidates too short to reach
the score), else by coordinates (the products of the query's largest coordinates
plus the Cauchy-Schwarz bound of the rest).  What is left is verified by its exact
product, and the k best of each block meet in one ranking per query.

A task holds one block of vectors and one of queries.  Results are exact: bounds
are widened by rounding errors, products are integers below 2^53 in doubles, or
Python integers where the vectors are too large for that.

Defined cases: vectors that are null, or hold a null or a non-finite component, or
whose id is null, take no part; products are taken between vectors of one
dimension; a query is compared with all rows but those of its own id; repeated
candidates hold a rank each, equal queries are asked once; ties go to the smaller
id; scores beyond 64 bits are set to its ends; empty vectors have score 0; an empty
table gives an empty result.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annospark.llm.common import shipped, stored

SCALE = 1024
BLOCK_ROWS, QUERY_ROWS = 8192, 1024
COORDINATE = 0.5
EXACT = float(1 << 53)
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def integer_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, dims, data (doubles with integer values), norm, bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, data, norms, buckets = [], [], [], [], []
            for id_, vec in zip(batch.column(0).to_pylist(), batch.column(1)):
                if id_ is None or vec.values is None or vec.values.null_count:
                    continue
                x = vec.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                x = np.floor(x * SCALE)
                if not np.isfinite(x).all():
                    continue
                norm = float(np.linalg.norm(x))
                ids.append(id_)
                dims.append(len(x))
                data.append(x.tobytes())
                norms.append(norm)
                buckets.append(int(np.floor(4 * np.log2(norm))) if 0 < norm < np.inf else -10_000 if norm == 0 else 10_000)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(data, pa.binary()),
                                              pa.array(norms, pa.float64()), pa.array(buckets, pa.int32())],
                                             names=["vec_id", "dims", "data", "norm", "bucket"])

    small = rows.select(F.col(id_col).cast("bigint"), F.col(vec_col))
    return small.mapInArrow(run, "vec_id long, dims int, data binary, norm double, bucket int")


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray | list[int]:
    """Exact integer products of the rows of x with q."""
    if x.size == 0:
        return np.zeros(len(x))
    if np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(1, len(q)) < EXACT:
        return x @ q
    whole = [int(v) for v in q]
    return [sum(int(a) * b for a, b in zip(row, whole)) for row in x]


def survivors(x: np.ndarray, norms: np.ndarray, q: np.ndarray, q_norm: float, least: float) -> np.ndarray:
    """Rows of one bucket that may reach the score `least`."""
    longest = norms.max(initial=0.0)
    if not np.isfinite(least) or q_norm == 0 or longest == 0 or not np.isfinite(longest * q_norm):
        return np.arange(len(x))
    slack = 1e-9 * longest * q_norm + 1e-6
    if least / (q_norm * longest) < COORDINATE:    # the local cosine threshold
        return np.flatnonzero(norms * q_norm + slack >= least)
    focus = np.argsort(-np.abs(q), kind="stable")[:max(1, len(q) // 4)]
    part = x[:, focus]
    rest_x = np.sqrt(np.maximum(0.0, norms ** 2 - np.einsum("ij,ij->i", part, part)) + 1e-6 * norms)
    rest_q = np.sqrt(max(0.0, q_norm ** 2 - float(q[focus] @ q[focus])) + 1e-6 * q_norm)
    return np.flatnonzero(part @ q[focus] + rest_x * rest_q + slack >= least)


def best_of_block(query_id: int, q: np.ndarray, q_norm: float, least: float, ids: np.ndarray, x: np.ndarray, norms: np.ndarray,
                  k: int) -> list[tuple[int, int]]:
    """(score, vec_id) of the k best rows, ties to the smaller id; all that tie with `least` are considered."""
    keep = survivors(x, norms, q, q_norm, least)
    keep = keep[ids[keep] != query_id]
    scores = products(x[keep], q)
    if isinstance(scores, np.ndarray):
        order = np.lexsort((ids[keep], -scores))[:k]
        return [(int(scores[i]), int(ids[keep][i])) for i in order]
    return sorted(((max(LOWEST, min(HIGHEST, s)), int(i)) for s, i in zip(scores, ids[keep])), key=lambda t: (-t[0], t[1]))[:k]


def dealt_search(candidates: DataFrame, queries: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Both sides' rows dealt by `keys`; the k best candidates of every group for each of its queries."""
    cols = [*keys, "side", "vec_id", "query_key", "data", "norm", "least"]
    both = candidates.select(*keys, F.lit(0).alias("side"), "vec_id", F.lit(0).cast("bigint").alias("query_key"), "data", "norm",
                             F.lit(0.0).alias("least")).unionByName(queries.select(
                                 *keys, F.lit(1).alias("side"), "vec_id", "query_key", "data", "norm", "least"))
    parts = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = both.select(*cols).repartition(parts, *keys).sortWithinPartitions(*keys, "side", "vec_id")
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, block = None, [], None
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(i).to_pylist() for i in range(len(cols))]
            for row in zip(*columns):
                key, (side, vec_id, query_key, data, norm, least) = row[:n], row[n:]
                if key != now:
                    now, rows, block = key, [], None
                if side == 0:
                    rows.append((vec_id, data, norm))
                elif rows:
                    if block is None:
                        x = np.frombuffer(b"".join(r[1] for r in rows)).reshape(len(rows), -1)
                        block = np.array([r[0] for r in rows]), x, np.array([r[2] for r in rows])
                    found = best_of_block(vec_id, np.frombuffer(data), norm, least, *block, k)
                    out += [(vec_id, query_key, i, s) for s, i in found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)],
                                                 names=["query_id", "query_key", "vec_id", "score"])

    return ordered.mapInArrow(run, "query_id long, query_key long, vec_id long, score long")


def exact_top_k(rows: DataFrame, is_query: Column, *, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the highest products for each row that is a query (by `vec_id`)."""
    vectors = stored(integer_vectors(rows, id_col, vec_col))
    buckets = vectors.groupBy("dims", "bucket").agg(F.max("norm").alias("longest"), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"),
                                                    F.count(F.lit(1)).alias("n"))
    b = stored(buckets).select(F.col("dims").alias("b_dims"), F.col("bucket").alias("b_bucket"), "longest", "blocks", "n")
    placed = vectors.join(b, (F.col("dims") == F.col("b_dims")) & (F.col("bucket") == F.col("b_bucket"))).withColumn(
        "block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).drop("b_dims", "b_bucket")
    asked = vectors.where(is_query).select("vec_id", "dims", "data", "norm").distinct().withColumn("query_key", F.xxhash64("data"))
    per_dims = asked.groupBy(F.col("dims").alias("q_dims")).agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("q_blocks"))
    queries = stored(asked.join(per_dims, F.col("dims") == F.col("q_dims")).withColumn(
        "q_block", F.pmod(F.xxhash64("vec_id"), F.col("q_blocks")).cast("int")).drop("q_dims"))

    seed = b.groupBy(F.col("b_dims").alias("s_dims")).agg(F.max(F.struct("n", "b_bucket")).alias("s"))
    all_q = queries.select(F.col("dims").alias("a_dims"), "q_blocks").distinct()
    seeds = (placed.where("block = 0").join(seed, (F.col("dims") == F.col("s_dims")) & (F.col("bucket") == F.col("s.b_bucket")))
             .join(all_q, F.col("dims") == F.col("a_dims"))
             .withColumn("q_block", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1))))
    endless = F.lit(float("-inf"))
    first = dealt_search(seeds, queries.withColumn("least", endless), ["dims", "q_block"], k)
    reached = first.groupBy(F.col("query_id").alias("r_id"), F.col("query_key").alias("r_key")).agg(
        F.min("score").cast("double").alias("score"), F.count(F.lit(1)).alias("found"))
    known = stored(queries.join(reached, (F.col("vec_id") == F.col("r_id")) & (F.col("query_key") == F.col("r_key")), "left")
                   .withColumn("least", F.when(F.col("found") >= k, F.col("score")).otherwise(endless))
                   .drop("r_id", "r_key", "score", "found"))

    wanted = stored(known.join(b, F.col("dims") == F.col("b_dims"))                        # a few hundred buckets at most
                    .where(F.col("norm") * F.col("longest") * (1 + 1e-9) + 1e-6 >= F.col("least"))
                    .select("dims", F.col("b_bucket").alias("bucket"), "blocks", "q_block", "vec_id", "query_key", "data", "norm", "least"))
    asking = wanted.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks_for = wanted.groupBy(F.col("dims").alias("w_dims"), F.col("bucket").alias("w_bucket")).agg(F.collect_set("q_block").alias("q_blocks"))
    held = (placed.join(blocks_for, (F.col("dims") == F.col("w_dims")) & (F.col("bucket") == F.col("w_bucket")))
            .withColumn("q_block", F.explode("q_blocks")))
    best = dealt_search(held, asking, ["dims", "bucket", "block", "q_block"], k)
    order = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(k: int = 10) -> str:
    return f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""


shipped(__name__)
