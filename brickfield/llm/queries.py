"""The queries of this subpackage: each applies one operator to its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brickfield.llm import alignment, chat, codes, decontam, forest, mixing, pii, quality, secrets, simhash, tokens, topk, warc
from brickfield.llm.common import materialize, new_path, spread, word_count
from brickfield.llm.oracles import ORACLE_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leak_digest(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_digest(documents(spark, sf_dir))


def vocabulary() -> str:
    """Path of the tokenizer that the token-id output uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_digest(spark, table(spark, sf_dir, "documents"), new_path(spark, "tokens"), vocabulary())


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_digest(spark, table(spark, sf_dir, "pages"), new_path(spark, "warc"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_digest(documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels")).drop("row")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    sized = materialize(docs.select("doc_id", "source", word_count(docs["text"]).alias("words")), "mix-words")
    return mixing.mix_sources(sized, size="words").select("doc_id", "size", "source_size", "target", "taken")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(documents(spark, sf_dir))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(spark, documents(spark, sf_dir), a, b)[0]


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.code_digest(table(spark, sf_dir, "embeddings"))


def op13_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.link_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_decontam, op2_chat, op3_simhash, op4_tokens, op5_topk, op6_warc, op7_secrets, op8_quality, op9_mixing, op10_pii, op11_alignment, op12_codes, op13_forest)}
