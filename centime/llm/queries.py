"""The thin ``opN_<name>`` queries: each applies its operator, with production
parameters, to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (conversation_repair, decontaminate, exact_dedup, language_id, lm_scoring, sentencepiece_codec, sharding, simhash,
               spelling, suffix_dedup, token_counts, token_ids, toxicity)
from .common import crc_bucket, documents, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.annotate(documents(spark, sf_dir))


ORACLES["op3_exact_dedup"] = r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256
           from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = min(doc_id) over w as kept, text_sha256
from d window w as (partition by text_sha256)"""


@register
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = simhash.components_of(documents(spark, sf_dir), shingle=3, max_bits=2)
    return c.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decontaminate.annotate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13)
    return d.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                    decontaminate.contaminated().alias("contaminated"))


@register
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = sentencepiece_codec.encode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return e.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
                    F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                    F.sha2("decoded", 256).alias("decoded_sha256"))


def seen(doc_id, m: int, held_out: int):
    """Documents that a model may learn from."""
    return crc_bucket(doc_id, m) != held_out


@register
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = language_id.fit(docs.where(seen(F.col("doc_id"), 4, 2)))
    p = language_id.predict(docs, net, F.col("doc_id"))
    return p.select(F.col("id").alias("doc_id"), (~seen(F.col("id"), 4, 2)).alias("held_out"), "lang_pred", "score")


@register
def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_ids.shard_path(spark)
    token_ids.write(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    rows = token_ids.read(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    rows = token_ids.with_start(written(rows, "token-rows"))
    return rows.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


@register
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = suffix_dedup.dedup(documents(spark, sf_dir), length=50)
    return d.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@register
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lm_scoring.score(documents(spark, sf_dir), seen(F.col("doc_id"), 10, 0))
    return s.select(F.col("id").alias("doc_id"), (~seen(F.col("id"), 10, 0)).alias("held_out"), "n_tokens", "n_known",
                    "train_tokens", "base_score", "score")


@register
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(seen(F.col("doc_id"), 5, 0))
    s = toxicity.score(docs, toxicity.fit(docs, labels))
    return s.select(F.col("id").alias("doc_id"), (~seen(F.col("id"), 5, 0)).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = token_counts.count(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return c.select(F.col("id").alias("doc_id"), "n_words", "n_tokens", F.col("most").alias("max_tokens_of_word"))


def mistyped():
    """``run``, or the run without one of its code points for one in 31 (document, run)s."""
    h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    p = (h % F.length("run")).cast("int")
    return F.when(h % 31 == 0, F.concat(F.substr("run", F.lit(1), p), F.substr("run", p + 2))).otherwise(F.col("run"))


@register
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.vocabulary(mistyped(), spelling.runs(documents(spark, sf_dir), least=7), least=7, least_n=2)
    return spelling.forms(words, ratio=10).select("word", "form", "root", "n", "n_near", "form_n")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, repeated or given another role, by a hash of conversation and turn."""
    space = F.lit(" ")
    k = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                         F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    d = conversations.select(
        "conv_id", "turn", F.when(k == 4, "user").otherwise(role).alias("role"),
        F.when(k == 1, "").when(k == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("times"))
    return d.select(F.explode(F.array_repeat(F.lit(0), F.col("times"))), "*").drop("col", "times")


@register
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    r = conversation_repair.repair(damaged(conversations), conversations)
    return r.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                    F.col("digest").alias("repaired_sha256"))


@register
def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.write(documents(spark, sf_dir), sharding.shard_path(spark), shards=24)
    text = F.coalesce(F.col("doc.text"), F.lit("")).cast("binary")
    return rows.select(F.col("doc.doc_id").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))
