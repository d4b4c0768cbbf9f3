"""The queries of the operators, as `__spark_entry__.py` registers them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.oracles import oracle_sql  # noqa: F401

#: The tokenizer of the counting and encoding queries.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.langid import fit, held_out, identify

    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("text", "lang"))
    found = identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.line_dedup import dedup

    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.substring_dedup import dedup

    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.license_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.sharding import place

    docs = table(spark, sf_dir, "documents").select("doc_id")
    return place(docs, ["doc_id"], [f"shard-{i:03d}" for i in range(100)])


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.decontaminate import find_matches

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_matches(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hits").cast("bigint")
    ids = F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), ids.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.token_counts import count_with_edits

    def edit(start, length, insert):
        return F.struct(start.cast("int").alias("start"), F.lit(length).alias("length"), F.lit(insert).alias("insert"))

    size = F.length("text")
    # a replacement in the middle, an insertion after a third and a deletion after three quarters
    edits = F.array(edit(F.floor(size / 2), 3, " edit 42"), edit(F.floor(size / 3), 0, " the"), edit(F.floor(size * 0.75), 5, ""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", edits.alias("edits"))
    return count_with_edits(docs, RANKS, PATTERN).select("doc_id", "n_tokens", "n_tokens_edited", "n_reencoded", "n_pretokens")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.topk import top_k

    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where(F.col("vec_id") % 50 == 0))


def op9_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.bpe import encode_decode

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, RANKS, PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.suffix_dedup import dedup

    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.conversations import repair_damaged

    found = repair_damaged(table(spark, sf_dir, "conversations"))
    return found.withColumn("repaired_sha256", F.sha2(F.col("repaired").cast("binary"), 256)).drop("repaired")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_language_id,
        op2_line_dedup,
        op3_substring_dedup,
        op4_license_scan,
        op5_sharding,
        op6_decontaminate,
        op7_token_counts,
        op8_exact_top_k,
        op9_bpe_roundtrip,
        op10_simhash_near_dedup,
        op11_embedding_whitening,
        op12_suffix_array_dedup,
        op13_conversation_repair,
    )
    return {f.__name__: f for f in found}
