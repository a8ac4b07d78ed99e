"""Registered queries of the training-data operators: key -> builder, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annospark.llm import bpe, chat, digest, infill, langid, minhash, mixing, periods, pii, sharding, substrings, topk, urlfilter
from annospark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


@register("op1_minhash", minhash.oracle())
def op1(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


@register("op2_quartile_digest")
def op2(spark, sf_dir):
    return digest.edited_neighbours(table(spark, sf_dir, "documents"))


@register("op3_kd_shards")
def op3(spark, sf_dir):
    return sharding.kd_shards(table(spark, sf_dir, "documents"), shards=8)


@register("op4_reply_trees", chat.oracle())
def op4(spark, sf_dir):
    rows = chat.linear_messages(chat.with_probe(table(spark, sf_dir, "conversations")))
    return chat.digests(chat.format_reply_trees(rows, conv_col="conv", id_col="id", parent_col="parent",
                                                role_col="role", text_col="text"))


@register("op5_suffix_trees", substrings.oracle())
def op5(spark, sf_dir):
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@register("op6_url_language_models")
def op6(spark, sf_dir):
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"))


@register("op7_language_bitmasks")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs, model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@register("op8_backtracking_bpe")
def op8(spark, sf_dir, vocabulary_path: str | None = None):
    if vocabulary_path is None:
        import public_tokenizers
        vocabulary_path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary_path,
                             outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


@register("op9_weighted_fair_mix", mixing.oracle())
def op9(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@register("op10_norm_buckets", topk.oracle())
def op10(spark, sf_dir):
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@register("op11_infill", infill.oracle())
def op11(spark, sf_dir):
    return infill.digests(infill.fill_in_middle(table(spark, sf_dir, "documents")))


@register("op12_periods")
def op12(spark, sf_dir):
    return periods.digests(periods.periodic_runs(periods.with_planted_tails(table(spark, sf_dir, "documents"))))


@register("op13_pii_boosting")
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pii.digests(pii.find(docs, pii.fit(docs)))
