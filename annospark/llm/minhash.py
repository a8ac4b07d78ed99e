"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star edges.

A document is the set of its distinct n-word shingles (one 64-bit hash each, made of its words' hashes).
One permutation deals the hashes into BANDS * ROWS bins by their leading bits and
keeps each bin's smallest; an empty bin copies the bin that a hash sequence of
its own number finds first among the filled ones (optimal densification).
ROWS bins are a band, and equal bands of two documents meet in a bucket.  A pair
at the similarity 0.85 misses all buckets with probability (1 - 0.85^6)^40, 6e-9.

Documents with equal sets are one class from the start.  Within a bucket the
candidate edges are a star, from the class whose buckets are most crowded to
the others, so a bucket of n classes gives n - 1 pairs; pairs are confirmed on
the full sets.
A star can miss a link between two of its outer members.  Where the classes of a
bucket are not all of one component after the stars, the classes that meet in
such buckets, directly or by way of others, form a crowd, and each two blocks of
a crowd's sets meet once in a task, which counts all their intersections exactly
and returns only edges that join components.  So no link is lost, no pair is a
row, and what the first stars have joined costs nothing more.

Shuffled are bands, class ids and, for the confirmation, the sets of classes that
have a candidate; texts are not, but for the one join that reads these sets.

Defined cases: a null or empty text, or one without a word, has the empty set
and is its own component; rows with a null id are linked with nothing, and their
component is null; rows that share an id are one vertex, linked by any of their
texts; an empty table gives an empty result.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annospark.llm.common import bounded, shipped, stored, worker_state
from annospark.llm.graph import components
from annospark.llm.wordhash import ODD, Runs, WordHashes, mixed

BANDS, ROWS = 40, 6
BINS = BANDS * ROWS
DENSE = 32                                        # shingles with so many holders are counted as matrix columns
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 1_000_000
SALT = np.uint64(0xF1DE83E19937733D)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of `words` lower-cased words (of the whole text, if it has fewer)."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    k = min(words, len(parts))
    known = worker_state("words").setdefault("lower", WordHashes())
    return np.unique(mixed(Runs(known.of(parts)).of(k) + np.uint64(k)))


def probe_order() -> np.ndarray:
    """For every bin, the sequence of bins it asks for a value: hashes of its own number and the attempt."""
    state = worker_state("minhash")
    if "probes" not in state:
        bins, tries = np.arange(BINS, dtype=np.uint64), np.arange(16 * BINS, dtype=np.uint64)
        state["probes"] = (mixed(bins[:, None] * np.uint64(1 << 20) + tries[None, :] + ODD) % np.uint64(BINS)).astype(np.int32)
    return state["probes"]


def signature(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash of each bin; empty bins densified. `hashes` sorted, not empty."""
    bins = ((hashes >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    filled = bins[first]
    source, has = np.full(BINS, filled[0]), np.zeros(BINS, bool)
    source[filled], has[filled] = filled, True
    values = np.zeros(BINS, np.uint64)
    values[filled] = hashes[first]
    empty, tried, width, probes = np.flatnonzero(~has), 0, 8, probe_order()
    while len(empty) and tried < probes.shape[1]:
        asked = probes[empty, tried:tried + width]
        hit = has[asked]
        found = hit.any(axis=1)
        source[empty[found]] = asked[found, hit[found].argmax(axis=1)]
        empty, tried, width = empty[~found], tried + width, 2 * width
    return values[source]


def band_hashes(hashes: np.ndarray) -> np.ndarray:
    rows = signature(hashes).reshape(BANDS, ROWS)
    h = np.arange(BANDS, dtype=np.uint64) * ODD
    for i in range(ROWS):
        h = mixed(h * ODD + rows[:, i])
    return h.view(np.int64)


def set_name(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that name the set: two different sums of its mixed members."""
    a = mixed(hashes * ODD + np.uint64(1)).sum(dtype=np.uint64)
    b = mixed(hashes * SALT + np.uint64(2)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, name_a, name_b, bands array<long> (empty of empty sets)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            n, names, bands = [], [], []
            for text in batch.column(1).to_pylist():
                h = shingle_hashes(text, words)
                n.append(len(h))
                names.append(set_name(h) if len(h) else (0, 0))
                bands.append(band_hashes(h) if len(h) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array([a for a, _ in names], pa.int64()),
                 pa.array([b for _, b in names], pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "name_a", "name_b", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, name_a long, name_b long, bands array<long>")


def sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text) -> doc_id, the hashes of its set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            made = [shingle_hashes(t, words).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], names=["doc_id", "members"])

    return docs.mapInArrow(run, "doc_id long, members array<long>")


def confirmed(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(a, b) whose sets satisfy 100 * intersection >= percent * union."""
    m = members.select(F.col("doc_id").alias("m_id"), "members")
    both = (pairs.join(m, F.col("a") == F.col("m_id")).select("a", "b", F.col("members").alias("left"))
            .join(m, F.col("b") == F.col("m_id")).select("a", "b", "left", F.col("members").alias("right")))
    shared = F.size(F.array_intersect("left", "right"))
    return both.where((100 + percent) * shared >= percent * (F.size("left") + F.size("right"))).select("a", "b")


def same_crowd_links(ids: np.ndarray, comps: np.ndarray, sets_: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the components which links between these sets join. Intersections are counted exactly."""
    m, sizes = len(ids), np.array([len(x) for x in sets_], dtype=np.int64)
    owner = np.repeat(np.arange(m), sizes)
    _, element, held_by = np.unique(np.concatenate(sets_), return_inverse=True, return_counts=True)
    shared = np.zeros((m, m), np.float32)          # counts below 2^24 are exact
    rank = np.argsort(element, kind="stable")
    element, owner = element[rank], owner[rank]
    for common in np.array_split(np.flatnonzero(held_by >= DENSE), max(1, -(-int((held_by >= DENSE).sum()) // 4096))):
        if len(common):
            at = np.searchsorted(common, element)
            mine = (at < len(common)) & (common[np.minimum(at, len(common) - 1)] == element)
            grid = np.zeros((m, len(common)), np.float32)
            grid[owner[mine], at[mine]] = 1
            shared += grid @ grid.T
    rare = held_by[element] < DENSE
    element, owner = element[rare], owner[rare]
    for k in range(1, DENSE):                      # the k-th next holder of the same element
        hit = element[k:] == element[:-k]
        if not hit.any():
            break
        both = np.bincount(owner[:-k][hit] * m + owner[k:][hit], minlength=m * m).reshape(m, m)
        shared += both + both.T
    total = sizes[:, None] + sizes[None, :]
    linked = ((100 + percent) * shared.astype(np.int64) >= percent * total) & (comps[:, None] != comps[None, :])
    label = np.arange(m)
    while True:
        lower = np.minimum(label, np.where(linked, label[None, :], m).min(axis=1))
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    moved = label != np.arange(m)
    return ids[label[moved]], ids[moved]


def links_in_crowds(rows: DataFrame, crowd: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(doc_id, component), crowds (id, component) -> (a, b): components of a crowd that have a link.

    Every two members of a crowd are compared, in tasks of two blocks; a block holds about BLOCK_DOCS sets and
    BLOCK_SHINGLES shingles at most, and each set travels once for every other block of its crowd.
    """
    c = crowd.select(F.col("id").alias("w_id"), F.col("component").alias("crowd"))
    sized = (rows.join(c, F.col("doc_id") == F.col("w_id")).drop("w_id")
             .join(full.select(F.col("doc_id").alias("f_id"), "members"), F.col("doc_id") == F.col("f_id")).drop("f_id"))
    per_crowd = sized.groupBy(F.col("crowd").alias("p_crowd")).agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum(F.size("members")) / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    pairs = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("block")),
                    lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j"))))
    dealt = (sized.join(per_crowd, F.col("crowd") == F.col("p_crowd")).withColumn("block", mine)
             .select("crowd", F.explode(pairs).alias("p"), "doc_id", "component", "members")
             .select("crowd", "p.i", "p.j", "doc_id", "component", "members"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(parts, "crowd", "i", "j").sortWithinPartitions("crowd", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def close():
            if len({h[1] for h in held}) < 2:
                return []
            a, b = same_crowd_links(np.array([h[0] for h in held]), np.array([h[1] for h in held]), [h[2] for h in held], percent)
            of = {h[0]: h[1] for h in held}
            return [pa.RecordBatch.from_arrays([pa.array([of[x] for x in ends.tolist()], pa.int64()) for ends in (a, b)], names=["a", "b"])]

        for batch in batches:
            columns = [x.to_pylist() for x in batch.columns[:5]]
            for i, (*now, doc, component) in enumerate(zip(*columns)):
                if now != key:
                    yield from close()
                    held, key = [], now
                held.append((doc, component, batch.column(5)[i].values.to_numpy()))
        yield from close()

    return ordered.mapInArrow(run, "a long, b long")


def crowded_buckets(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """heads: one document for each distinct set; buckets: the rows of buckets that hold two heads or more.

    A head's rank in its buckets is by how crowded all its buckets are: the text that most others derive from,
    which shares most buckets with them, is the centre of its stars.
    """
    heads = stored(signed.where("n_shingles > 0 and doc_id is not null").groupBy("name_a", "name_b")
                   .agg(F.min(F.struct("doc_id", "n_shingles")).alias("h"))
                   .select("name_a", "name_b", F.col("h.doc_id").alias("head"), F.col("h.n_shingles").alias("n")))
    h = heads.select(F.col("name_a").alias("h_a"), F.col("name_b").alias("h_b"), "head")
    rows = (signed.join(h, (F.col("doc_id") == F.col("head")) & (F.col("name_a") == F.col("h_a")) & (F.col("name_b") == F.col("h_b")))
            .select("doc_id", F.col("n_shingles").alias("size"), F.explode("bands").alias("bucket")).distinct())
    crowded = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("heads")).where("heads > 1")
    full = stored(rows.join(crowded.withColumnRenamed("bucket", "c_bucket"), F.col("bucket") == F.col("c_bucket")).drop("c_bucket"))
    crowd = full.groupBy("doc_id").agg(F.sum("heads").alias("crowd"), F.min("size").alias("lo"), F.max("size").alias("hi"))
    ranked = full.select("bucket", "doc_id").join(crowd.withColumnRenamed("doc_id", "w_id"), F.col("doc_id") == F.col("w_id"))
    return heads, stored(ranked.select("bucket", F.struct((-F.col("crowd")).alias("crowd"), "doc_id").alias("v"), "lo", "hi"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document; links need percent % of the union in common."""
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stored(signatures(base, words))
    heads, buckets = crowded_buckets(signed)
    wanted = buckets.select(F.col("v.doc_id").alias("w_id")).distinct()
    full = stored(sets(base.join(wanted, F.col("doc_id") == F.col("w_id"), "left_semi"), words))
    possible = 100 * F.least("hi", "c_hi") >= percent * F.greatest("lo", "c_lo")    # no intersection exceeds the smaller set

    def pairs_with(centres: DataFrame, rows: DataFrame, cond) -> DataFrame:
        """Links of each row to its bucket's centres; a pair is tested once however many buckets it shares."""
        met = rows.join(centres, F.col("bucket") == F.col("c_bucket")).where(cond & possible)
        return confirmed(met.select(F.col("c.doc_id").alias("a"), F.col("v.doc_id").alias("b")).distinct(), full, percent)

    stars = buckets.groupBy(F.col("bucket").alias("c_bucket")).agg(F.min(F.struct("v", "lo", "hi")).alias("m")).select(
        "c_bucket", F.col("m.v").alias("c"), F.col("m.lo").alias("c_lo"), F.col("m.hi").alias("c_hi"))
    links = stored(pairs_with(stars, buckets, F.col("v") > F.col("c")))
    label = components(links)

    named = (buckets.join(label, F.col("v.doc_id") == F.col("id"), "left")
             .select("bucket", "v", F.coalesce("component", "v.doc_id").alias("component")))
    split = (named.groupBy(F.col("bucket").alias("s_bucket")).agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("heads"))
        .where((F.col("low") < F.col("high")) & (F.col("heads") > 2)).select("s_bucket"))
    open_rows = stored(named.join(split, F.col("bucket") == F.col("s_bucket")).drop("s_bucket"))
    meet = open_rows.join(stars.select("c_bucket", "c"), F.col("bucket") == F.col("c_bucket"))
    crowd = components(meet.select(F.col("c.doc_id").alias("a"), F.col("v.doc_id").alias("b")))
    outer = links_in_crowds(open_rows.select(F.col("v.doc_id").alias("doc_id"), "component").distinct(), crowd, full, percent)
    joined = components(outer).select(F.col("id").alias("j_id"), F.col("component").alias("joined"))

    names = (heads.join(label, F.col("head") == F.col("id"), "left")
             .withColumn("own", F.coalesce("component", "head")).join(joined, F.col("own") == F.col("j_id"), "left")
             .select(F.col("name_a").alias("h_a"), F.col("name_b").alias("h_b"), F.coalesce("joined", "own").alias("component")))
    lone = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    rest = (signed.where("n_shingles > 0 and doc_id is not null")
            .join(names, (F.col("name_a") == F.col("h_a")) & (F.col("name_b") == F.col("h_b")))
            .select("doc_id", "n_shingles", F.col("component").alias("component_id")))
    return rest.unionByName(lone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def oracle(table: str = "documents", *, words: int = 3, percent: int = 85) -> str:
    """The same classes in DuckDB SQL, from all pairs that share a shingle."""
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x20\\x09-\\x0D]+') AS words FROM {table}),
sh AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {words} THEN [array_to_string(words, ' ')]
         ELSE list_distinct(list_transform(range(1, len(words) - {words} + 2), lambda i: array_to_string(words[i:i + {words - 1}], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM sh),
u AS (SELECT doc_id, unnest(s) AS g FROM sh),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON p.x = nx.doc_id JOIN n ny ON p.y = ny.doc_id
      WHERE 100 * both_ >= {percent} * (nx.n + ny.n - both_)),
d AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT doc_id AS id, doc_id AS reach FROM n UNION SELECT r.id, d.y FROM r JOIN d ON r.reach = d.x),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN c ON n.doc_id = c.id"""


shipped(__name__)
