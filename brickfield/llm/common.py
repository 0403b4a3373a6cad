"""Helpers shared by the text operators: written tables, bounded broadcasts, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from brickfield.functions.scratch import new_path, written  # noqa: F401

#: ASCII white space, as a Java and RE2 character class body.
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows (doc_id, hash of the text) of a broadcast list of documents to drop at most; about 50 bytes each.
MOST_DROPPED = 500_000
#: Bytes of strings in a broadcast table at most.
MOST_BYTES = 32 << 20


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back; this cuts its lineage."""
    return written(df, tag)


def packed(df: DataFrame, *beside: Column) -> DataFrame:
    """df's columns in one struct, `row`, with others beside it, so that no name of a helper meets one of the caller's."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), *beside)


def unpacked(columns: list[str], **put: Column) -> list[Column]:
    """The columns that packed() holds, under their names and in their order, some of them replaced."""
    return [put[c].alias(c) if c in put else F.col("row").getField(c).alias(c) for c in columns]


def spread(df: DataFrame) -> DataFrame:
    """df, read from files, over all cores where it lies in fewer partitions than there are cores; a larger table stays as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores or df.select(F.spark_partition_id()).distinct().count() >= cores:
        return df
    return df.repartition(cores)


def bounded(df: DataFrame, most: int, most_bytes: int = MOST_BYTES) -> DataFrame:
    """df, to be broadcast by a join while it has at most so many rows and its strings so many bytes; beyond that the join shuffles both sides."""
    return F.broadcast(df) if fits(df, most, most_bytes) else df.hint("merge")


def fits(df: DataFrame, most: int, most_bytes: int = MOST_BYTES) -> bool:
    """True if df has at most so many rows, and its strings, those in arrays too, at most so many bytes in all."""
    sizes = [F.lit(0)]
    for f in df.schema.fields:
        if f.dataType.simpleString() == "string":
            sizes.append(F.coalesce(F.octet_length(f.name), F.lit(0)))
        elif f.dataType.simpleString() == "array<string>":
            sizes.append(F.coalesce(F.aggregate(f.name, F.lit(0), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0)) + 40), F.lit(0)))
    found = df.agg(F.count("*").alias("n"), F.sum(sum(sizes[1:], sizes[0]).cast("long")).alias("bytes")).first()
    return found["n"] <= most and (found["bytes"] or 0) <= most_bytes


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z alone."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")
