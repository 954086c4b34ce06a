"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, divergence, exact_dedup, line_dedup, minhash_dedup, packing, pii, piece_fst, prefix_trie, simhash_dedup, substring_dedup, toxicity
from .store import table, tokenizer


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"), F.size("spans").cast("bigint").alias("n_spans"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), equal_words=1)
    return found.select("doc_id", "n_lines", "n_removed", "text")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_piece_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_fst.digested(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    formatted = chat.format_chats(chat.canonical_turns(rows))
    loss = F.array_join("loss_texts", "")
    back = chat.read_back(formatted.withColumn("formatted_chars", F.length("formatted").cast("bigint")), keep=("formatted_chars",))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id", F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("version")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = (
        op1_ann, op2_substring_dedup, op3_packing, op4_pii, op5_line_dedup, op6_exact_dedup, op7_piece_fst, op8_chat, op9_toxicity,
        op10_minhash_dedup, op11_divergence, op12_prefix_trie, op13_simhash_dedup,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": substring_dedup.ORACLE, "op6_exact_dedup": exact_dedup.ORACLE, "op8_chat": chat.ORACLE, "op10_minhash_dedup": minhash_dedup.ORACLE,
        "op11_divergence": divergence.ORACLE, "op12_prefix_trie": prefix_trie.ORACLE,
    }
