"""The operators' queries: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bytebpe, embdedup, jaccard, langid, merkle, negatives, packing, repair, substring, unigram, urlfilter, warc
from .common import table
from .oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).withColumnRenamed("page", "page_id")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), k=3, percent=90)


def op8_embdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.dedup(table(spark, sf_dir, "embeddings"), 0.98)


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(table(spark, sf_dir, "documents"), 20)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.HOST_RULES + urlfilter.PATH_RULES + urlfilter.PATTERN_RULES)


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0, scale=256, positives=5, negatives=10, least=30, most=90)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc_id, source, lang, n_chars, text = map(F.col, ("doc_id", "source", "lang", "n_chars", "text"))
    touched = F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0
    other = F.when(touched, merkle.leaf(doc_id, source, lang, F.try_add(n_chars, F.lit(1)), text))
    m = merkle.build(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"doc_id": doc_id, "other": other})
    root, path = F.lit(m.root), F.col("path")
    folded = m.leaves.withColumns({"proof_sha256": merkle.digest(merkle.siblings(path)), "folded_root": merkle.folded(F.coalesce("other", "h"), path)})
    return folded.select("doc_id", F.col("h").alias("leaf"), "subroot", root.cast("string").alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def op13_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = repair.store(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
