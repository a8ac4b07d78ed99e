"""Quartile digests, weighted fair mix and k-d shards: brute force and defined cases."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from annospark.llm import digest, mixing, queries, sharding

SF = "/root/testdata/sf0.001"
WEIRD = [(None, None, None, None), (5, "", "b", "en"), (7, "one two three", "a", "en"), (7, "one two three", "a", "en"), (9, "é" * 5000, None, "fr"),
         (11, "x " * 30000, "b", None), (12, "a b", "c", "de")]


@pytest.fixture(scope="module")
def weird(spark):
    return spark.createDataFrame(WEIRD, "doc_id long, text string, source string, lang string").withColumn("target", F.lit("clash")).withColumn("size", F.lit("clash"))


def plain_counts(data: bytes) -> np.ndarray:
    out = np.zeros(digest.BUCKETS, np.int64)
    for k, (i, j, m) in enumerate(digest.PATTERNS):
        for p in range(len(data) - m):
            h = (data[p + i] | data[p + j] << 8 | data[p + m] << 16) + ((k + 1) << 24)
            h = h * 0x9E3779B1 % 2**32
            h ^= h >> 15
            out[(h * 0x85EBCA77 % 2**32) >> 25] += 1
    return out


def test_counts_and_likeness():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 4, 5, 300):
        data = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        assert (digest.counts(data) == plain_counts(data)).all()
    a, b = digest.fingerprint(b"the same text " * 40), digest.fingerprint(bytes(rng.integers(0, 256, 4000, dtype=np.uint8)))
    assert digest.likeness(a, a) == 1.0 and digest.likeness(a, b) == digest.likeness(b, a) and 0 <= digest.likeness(a, b) < 0.9


def expected(rows, tie):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), tie[r[1] or ""]))
    out = []
    for (i, t, *_), (_, following, *_) in zip(order, order[1:] + order[:1]):
        t, following = t or "", following or ""
        half = len(t) // 2
        edited = (t[:len(t) - half] + following[:half]).encode()
        own, changed = digest.fingerprint(t.encode()), digest.fingerprint(edited)
        out.append((i, len(t), hashlib.sha256(edited).hexdigest(), own, changed, digest.likeness(own, changed),
                    digest.likeness(own, digest.fingerprint(following.encode()))))
    return sorted(out, key=str)


def ties(spark, rows):
    texts = spark.createDataFrame([(t,) for t in {r[1] or "" for r in rows}], "t string")
    return {r.t: r.h for r in texts.select("t", F.xxhash64("t").alias("h")).collect()}


@pytest.mark.parametrize("partitions,range_rows", [(8, 256), (8, 1), (3000, 1)])
def test_neighbours(spark, weird, monkeypatch, partitions, range_rows):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(digest, "RANGE_ROWS", range_rows)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert sorted((tuple(r) for r in digest.edited_neighbours(weird).collect()), key=str) == expected(WEIRD, ties(spark, WEIRD))
        one = weird.where("doc_id = 12")
        assert digest.edited_neighbours(one).first().near_next == 1.0
        assert digest.edited_neighbours(weird.limit(0)).collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_neighbours_on_the_table_and_with_hot_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((tuple(r) for r in digest.edited_neighbours(docs).collect()), key=str) == expected(rows, ties(spark, rows))
    hot = [(None, "no id")] * 700 + [(5, f"text {i % 40}") for i in range(700)] + [(i, "other") for i in range(600)]
    got = digest.edited_neighbours(spark.createDataFrame(hot, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == expected(hot, ties(spark, hot))


def test_mix_contract(spark):
    rows = queries.QUERIES["op9_weighted_fair_mix"](spark, SF).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, rows), key=key) == sorted(con.execute(queries.ORACLE["op9_weighted_fair_mix"]).fetchall(), key=key)
    longest = max(r.size for r in rows)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * longest
        assert all(r.taken <= 3 * r.size for r in own)


def test_mix_targets_are_capped_and_weird_rows(spark, weird):
    sizes = spark.createDataFrame([("a", 10), ("b", 10), ("c", 1000), (None, 5)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes, (1, 2, 3), 3, 1.0).collect()}
    assert got == {"a": 30.0, "b": 30.0, "c": 950.0, None: 15.0}
    out = mixing.mix_sources(weird).collect()
    assert len(out) == len(WEIRD) and all(r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size for r in out)
    assert sorted(map(str, mixing.mix_sources(weird).collect())) == sorted(map(str, out))
    assert mixing.mix_sources(weird.limit(0)).collect() == []


def test_shards_contract(spark, weird):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = queries.QUERIES["op3_kd_shards"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.size == len(docs[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) for r in rows)
    shard_of: dict = {}
    for r in rows:
        assert shard_of.setdefault(docs[r.doc_id], r.shard) == r.shard and r.law == "bytes" and r.grown_shard is None
    heaviest = max(sum(r.size for r in rows if docs[r.doc_id] == t) for t in set(docs.values()))
    total = sum(r.size for r in rows)
    for s in range(8):
        own = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 8) <= 2 * heaviest
    assert len(sharding.kd_shards(weird, shards=3).collect()) == len(WEIRD)
    assert {r.shard for r in sharding.kd_shards(weird, target_bytes=10**9).collect()} == {0}
    assert sharding.kd_shards(weird.limit(0), shards=8).collect() == []


def exact_tree(points, leaves):
    """Leaf of every point (weight, coordinates, hash): split at the exact weighted median along the widest dimension."""
    dims = range(len(points[0][1]))
    span = [(max(p[1][d] for p in points) - min(p[1][d] for p in points)) or 1.0 for d in dims]
    out = {}

    def split(rows, first, k):
        if k == 1 or not rows:
            out.update({r[2]: first for r in rows})
            return
        width = [(max(r[1][d] for r in rows) - min(r[1][d] for r in rows)) / span[d] for d in dims]
        d = width.index(max(width))
        rows, want, below = sorted(rows, key=lambda r: (r[1][d], r[2])), sum(r[0] for r in rows) * (k // 2) / k, 0
        for at, r in enumerate(rows):
            if below + r[0] >= want or at == len(rows) - 1:
                at += want - below >= r[0] / 2
                break
            below += r[0]
        split(rows[:at], first, k // 2)
        split(rows[at:], first + k // 2, k - k // 2)

    split(points, 0, leaves)
    return out


@pytest.mark.parametrize("leaves", [1, 2, 7, 61])
def test_leaves_are_those_of_the_exact_tree(spark, leaves):
    draw = np.random.default_rng(leaves)
    rows = [(int(w), int(i), int(h), int(w), 1, float(d), float(i), float(s), 0.5, float(h) / 2 ** 53) for i, (w, d, s, h) in enumerate(zip(
        draw.integers(1, 400, 600), draw.integers(0, 5, 600), draw.random(600), draw.permutation(2 ** 20)[:600] * 2 ** 33))]
    points = spark.createDataFrame(rows, "size long, text_crc32 long, text_hash long, weight long, n long, d_size double, d_id double, "
                                         "d_source double, d_lang double, d_hash double")
    got = {r.d_hash: r.shard for r in sharding.kd_leaves(points, leaves).collect()}
    assert got == exact_tree([(r[3], r[5:9], r[9]) for r in rows], leaves)


def test_target_bytes_of_many_leaves(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    total = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0]
    rows = sharding.kd_shards(docs, target_bytes=total // 40).groupBy("shard").agg(F.sum("size").alias("b"), F.max("size").alias("m")).collect()
    assert 15 <= len(rows) <= 41 and all(r.b <= total // 40 * 2 + r.m for r in rows)
