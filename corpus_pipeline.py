"""A training corpus from `documents`: language ID, near-dedup, substring dedup, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept;
its result is written as Parquet to the shared folder and read again.  All but
the last return the columns of `documents`.

Defined cases: near-dedup judges each row, whether its id is null, repeated or
neither; repeated rows become one there; a document that loses all its words keeps its
row until the mix, which takes nothing of it; an empty table gives an empty
result; other columns of the input are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annospark.llm import bpe, langid, minhash, mixing, substrings
from annospark.llm.common import same, stored, table, word_count

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts of which the languages know less than of the documents that taught them."""
    judged = langid.predict(docs, langid.fit(docs, own=True), carry=COLUMNS[1:], typical=True)
    return judged.where("typical").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates (five words, similarity 0.8): the smallest id, null ids last.

    Rows are told apart by a stored key, so null and repeated ids are judged row by row.
    """
    rows = stored(docs.select(*COLUMNS).withColumn("__row", F.monotonically_increasing_id()))
    groups = minhash.near_duplicates(rows, id_col="__row", words=5, percent=80).select(F.col("doc_id").alias("__g_row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row"))
    kept = (rows.select("doc_id", "__row").join(groups, F.col("__row") == F.col("__g_row"))
            .groupBy("component_id").agg(first.alias("first")).select(F.col("first.__row").alias("__kept")))
    left = rows.join(kept, F.col("__row") == F.col("__kept"), "left_semi").withColumn("__hash", F.xxhash64("text"))
    repeat = F.row_number().over(Window.partitionBy("doc_id", "__hash").orderBy("lang", "source", "__row"))   # texts without a word
    return left.withColumn("__repeat", repeat).where(F.col("__repeat") == 1).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out every passage of 35 words or more that begins in two places."""
    kept = substrings.remove_repeats(docs, carry=("lang", "source"), keep_unchanged=True)
    return kept.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the weighted fair mix takes; equal ids of one source and size share a decision."""
    d = (mixing.mix_sources(docs).where("copies > 0").groupBy(F.col("doc_id").alias("d_id"), F.col("source").alias("d_source"), F.col("size").alias("d_size"))
         .agg(F.max("copies").alias("copies")))
    sized = docs.withColumn("__size", word_count(F.col("text")))
    taken = sized.join(d, same(F.col("doc_id"), F.col("d_id")) & same(F.col("source"), F.col("d_source")) & (F.col("__size") == F.col("d_size")))
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of the ids and of what they decode to."""
    if vocabulary_path is None:
        import public_tokenizers
        vocabulary_path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode_decode(docs, vocabulary_path, outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mix", mix), ("bpe", tokens)]

#: No SQL: language ID and byte-pair encoding are not expressible; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
