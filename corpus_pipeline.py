"""Training corpus: good documents, one of each near-duplicate group, without benchmark leaks, mixed, as token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from brickfield.functions.scratch import remove
from brickfield.llm import decontam, mixing, quality, simhash, tokens
from brickfield.llm.common import new_path
from brickfield.llm.queries import table, vocabulary


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from the labels of those at hand."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash.keep_one(docs)


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each repetition in the mix of sources; n_chars follows a shortened text."""
    rows = mixing.repeat_rows(mixing.mix_sources(docs, prefix="_mix_"), "_mix_")
    return rows.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids in files, and what the files hold of each."""
    return tokens.token_digest(spark, docs, new_path(spark, "corpus"), vocabulary())


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("decontamination", no_leaks), ("mixing", mixed), ("token_ids", token_ids)]

#: Neither the classifier nor the tokenizer can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's documents go as soon as the next stage has written its own."""
    docs, held = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        kept, path = stage(spark, docs, sf_dir), new_path(spark, f"corpus-{name}")
        kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if held:
            remove(spark, held)
        held = path
    digest = STAGES[-1][1](spark, docs, sf_dir)  # its files are written by now, and are all that it reads
    remove(spark, held)
    return digest
