"""The queries that the package registers for these operators."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import chat, common, media, mixing, pieces, quality_model, quality_rules, secrets, simhash, token_store, toxicity

TOKENIZERS = os.environ.get("POINTLOOM_TOKENIZERS")


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file: below POINTLOOM_TOKENIZERS, else where its package keeps it."""
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_store.write_tokens(common.table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"))
    return token_store.read_tokens(spark, path)


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table holds no calls, so they are derived from its numbers; whatever calls a text holds itself are linked too."""
    return chat.format_chats(chat.with_calls(common.table(spark, sf_dir, "conversations")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = common.staged(mixing.units(common.table(spark, sf_dir, "documents")), "mix-units")
    return mixing.mix(unit).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_documents(common.table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), ["doc_id"])
    return coded.drop("ids")


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.train(docs, common.table(spark, sf_dir, "labels")))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.shared_dir(spark)}/media-{uuid.uuid4().hex}"
    media.store_texts(common.table(spark, sf_dir, "documents"), path)
    return media.read_stored(spark, path)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    trusted = quality_rules.trusted_ids(common.table(spark, sf_dir, "labels"))
    ratio = common.staged(quality_rules.ratios(docs, trusted), "quality-ratios")
    judged = quality_rules.judge(docs, ratio)
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps = common.staged(simhash.fingerprints(common.table(spark, sf_dir, "documents")), "fingerprints")
    return simhash.near_duplicates(fps).select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(common.table(spark, sf_dir, "documents"), keep=["doc_id"])
    counts = [secrets.count_of("spans", k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("row.doc_id", *counts, F.sha2(secrets.listed("spans", base=True), 256).alias("base_sha256"), secrets.listed("spans").alias("spans"))


QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_tool_calls": op2_tool_calls,
    "op3_mixing": op3_mixing,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_quality_model": op5_quality_model,
    "op6_media": op6_media,
    "op7_toxicity": op7_toxicity,
    "op8_quality_rules": op8_quality_rules,
    "op9_simhash": op9_simhash,
    "op10_secrets": op10_secrets,
}
ORACLES: dict[str, str] = {"op2_tool_calls": chat.oracle(), "op10_secrets": secrets.oracle()}
