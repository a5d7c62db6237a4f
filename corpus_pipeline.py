"""A training-corpus pipeline of the operators in ``centime.llm``.

Language ID, exact dedup, SimHash near-dedup, benchmark decontamination, then
SentencePiece ids.  Each stage takes all documents its predecessor kept, with
the columns of ``documents``; the last returns the encoded documents.

Defined results: a null text or one without a letter goes in the first stage,
as does every document if no row has both a text and a language to learn from;
repeated rows are copies, of which one stays; an empty table gives an empty
table; columns beyond those of ``documents`` are kept up to the last stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from centime.llm import decontaminate, exact_dedup, language_id, sentencepiece_codec, simhash
from centime.llm.common import crc_bucket
from centime.session import scratch_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the network can name a language stay: those with a letter."""
    net = language_id.fit(docs.where(crc_bucket(F.col("doc_id"), 4) != 2))
    found = language_id.predict(docs, net, F.struct("*"))
    return found.where(F.col("lang_pred") != language_id.UNKNOWN).select("id.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the smallest id stays."""
    return simhash.dedup(docs, shingle=3, max_bits=2)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows make up a twentieth or more go."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and digests of the ids and of the decoded text."""
    keyed = docs.select(F.struct("doc_id", "lang", "source").alias("key"), "text")
    e = sentencepiece_codec.encode(keyed, public_tokenizers.path("piece_bpe_32k.model"), "key")
    return e.select("id.*", F.size("ids").cast("long").alias("n_tokens"), "ids",
                    F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                    F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language id", identify_language),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None  # a network, bit majorities and encodings are not SQL; tests/llm holds a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = scratch_path(spark, f"stage-{k}-{uuid.uuid4().hex}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
