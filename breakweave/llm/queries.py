"""The registered queries of the text operators, on their whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breakweave.llm import merkle, sql
from breakweave.llm.common import table
from breakweave.llm.decontaminate import template_leaks
from breakweave.llm.media_chunks import media_columns
from breakweave.llm.mixing import mix_sources
from breakweave.llm.pii import find_private
from breakweave.llm.prefix_trie import conversation_trie
from breakweave.llm.pu_quality import score_quality
from breakweave.llm.simhash import near_duplicates
from breakweave.llm.suffix_dedup import remove_repeats
from breakweave.llm.token_count import token_counts
from breakweave.llm.token_files import token_files
from breakweave.llm.top_k import top_k
from breakweave.llm.url_trust import judge_pages


def op1_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"), spark)


def op3_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), spark, public_tokenizers.path("word_bpe_49k.json"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).withColumn("mix_rate", F.round("mix_rate", 6))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: The rules that pages are judged by (host, path, verdict).
PAGE_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op10_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"select * from values {', '.join(map(str, PAGE_RULES))} as t(rule_host, rule_path, rule_verdict)")
    return judge_pages(table(spark, sf_dir, "pages"), rules)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    checked = merkle.verified_documents(table(spark, sf_dir, "documents"), even, F.translate("text", "\n", ""))
    texts = [merkle.as_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")]
    proof = F.sha2(merkle.proof_text(F.col("steps")), 256).alias("proof_sha256")
    return checked.select("doc_id", *texts, proof, merkle.as_text(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations")).nodes.drop("turn_id", "points")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    registered = (
        op1_token_count,
        op2_media_chunks,
        op3_template_leaks,
        op4_pu_quality,
        op5_token_files,
        op6_mixing,
        op7_suffix_dedup,
        op8_pii,
        op9_simhash,
        op10_url_trust,
        op11_merkle_manifest,
        op12_top_k,
        op13_prefix_trie,
    )
    return {f.__name__: f for f in registered}


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": sql.MIXING, "op10_url_trust": sql.pages(PAGE_RULES), "op11_merkle_manifest": sql.MERKLE, "op12_top_k": sql.TOP_K, "op13_prefix_trie": sql.TRIE}
