"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the wanted words in proportion to its weight, clamped at `cap` times its own size; what
is clamped off is shared again by weight until no source is above its cap. A source's documents are then taken in whole
repetitions, and a last fractional one goes to documents in the order of a seeded hash, (key, doc_id, size).

That order needs no sort of a source: sums over its hash ranges tell the range in which the fractional repetition ends,
and a running sum over that range alone the document. So a source is one row, joined to documents that stay where they
lie; only rows that are equal to the last one in key, doc_id and size are numbered among themselves.

Defined cases: a null text has size 0; the null source is a source of its own, last in order; documents of size 0 take
0 words; repeated rows are mixed as rows of their own; an empty table gives an empty result; extra columns pass through,
but for those that bear the names of the mix's own four, which a prefix changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from brickfield.llm.common import SPACE, bounded, materialize, packed, unpacked, word_count
from brickfield.operators.graphs import numbered

#: Hash ranges a source's documents are dealt to; a range holds this fraction of the source, so no source meets in one task.
BUCKET_BITS = 12
KEY_BITS = 60
#: Sources whose rows are broadcast at most.
MOST_SOURCES = 200_000


def order_key(seed: int) -> Column:
    """60 bits of the MD5 of seed and doc_id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def water_fill(sources: DataFrame, total: float, cap: float) -> DataFrame:
    """sources: source_size and weight. Adds target, a share of total by weight, at most cap * source_size.

    Each round is one aggregation; the driver sees its two sums and a count.
    """
    room = F.lit(cap) * F.col("source_size")
    rest, weights, clamped = total, None, -1
    weights = sources.agg(F.sum("weight")).first()[0] or 1
    share = F.col("weight") * F.lit(float(rest)) / F.lit(float(weights))
    while True:
        over = share > room
        now = sources.agg(
            F.count(F.when(over, 1)).alias("n"), F.sum(F.when(over, room)).alias("held"), F.sum(F.when(~over, F.col("weight"))).alias("w")
        ).first()
        if now["n"] <= max(clamped, 0) or not now["w"]:
            return sources.withColumn("target", F.when(over, room).otherwise(share).cast("double"))
        clamped, rest, weights = now["n"], total - (now["held"] or 0.0), now["w"]
        share = F.col("weight") * F.lit(float(rest)) / F.lit(float(weights))


def plan_sources(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """A row per source of sizes (_skey, _key, doc_id, _size): source_size, target, whole repetitions, and where the last one ends.

    Rows before the cut (a struct of key, doc_id and size) are taken once more, the first of those equal to it `left` words'
    worth, and none after it. The cut is null where the last repetition is empty or, by rounding, a whole one.
    """
    bucket = F.shiftright("_key", KEY_BITS - BUCKET_BITS)
    buckets = materialize(sizes.groupBy("_skey", bucket.alias("_b")).agg(F.sum("_size").alias("in_bucket")), "mix-buckets")
    sources = buckets.groupBy("_skey").agg(F.sum("in_bucket").alias("source_size")).withColumn("last", F.col("_skey") == "")
    sources = numbered(sources, "last", "_skey").withColumn("weight", F.array(*map(F.lit, weights))[(F.col("number") % len(weights)).cast("int")])
    everything = sources.agg(F.sum("source_size")).first()[0] or 0
    sources = water_fill(sources, share * everything, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("whole", whole).withColumn("part", F.floor("target").cast("long") - F.col("whole") * F.col("source_size"))
    sources = materialize(sources.select("_skey", "source_size", "target", "whole", "part"), "mix-targets")
    by_source = Window.partitionBy("_skey").orderBy("_b")
    upto = buckets.withColumn("before", F.sum("in_bucket").over(by_source) - F.col("in_bucket"))
    cuts = upto.join(sources.select("_skey", "part"), "_skey").where("before <= part AND part < before + in_bucket")
    cuts = cuts.select("_skey", "_b", (F.col("part") - F.col("before")).alias("rest"))
    rows = sizes.where("_size > 0").withColumn("_b", bucket).join(bounded(cuts, MOST_SOURCES), ["_skey", "_b"])
    alike = rows.groupBy("_skey", "rest", F.struct("_key", "doc_id", "_size").alias("cut")).agg(F.count("*").alias("alike"))
    words = F.col("alike") * F.col("cut._size")
    alike = alike.withColumn("left", F.col("rest") - F.sum(words).over(Window.partitionBy("_skey").orderBy("cut")) + words)
    return sources.join(alike.where((F.col("left") >= 0) & (F.col("left") < words)).select("_skey", "cut", "left", "alike"), "_skey", "left")


def mix_sources(docs: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 7, size: str | None = None, prefix: str = "") -> DataFrame:
    """docs (doc_id, source, text or the column named by `size`) with size, source_size, target and taken, under a prefix.

    weights repeat over the sources in code-point order, null last; share is the wanted total over all sizes. The last
    document of a fractional repetition gives a leading part, so a source's taken words miss its target by less than one.
    """
    own = [prefix + c for c in ("size", "source_size", "target", "taken")]
    measured = packed(
        docs, "doc_id", (F.col(size).cast("long") if size else word_count(F.col("text"))).alias("_size"),
        order_key(seed).alias("_key"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_skey"),
    )
    sizes = materialize(measured.select("_skey", "_key", "doc_id", "_size"), "mix-sizes")
    plan = materialize(plan_sources(sizes, weights, share, cap), "mix-plan")
    held = measured.join(bounded(plan, MOST_SOURCES), "_skey")
    here = F.struct("_key", "doc_id", "_size")
    at_cut = F.col("cut").isNotNull() & (here == F.col("cut"))
    before = F.when(F.col("cut").isNotNull(), here < F.col("cut")).otherwise(F.col("part") > 0)
    extra = F.when(at_cut, F.col("left")).when(before, F.col("_size")).otherwise(0)
    if plan.where("alike > 1").isEmpty():
        mixed = held.withColumn("_extra", extra)
    else:
        tied = at_cut & (F.col("alike") > 1)
        number = F.row_number().over(Window.partitionBy("_skey").orderBy("_key")) - 1
        several = held.where(tied).withColumn("_extra", F.greatest(F.lit(0), F.least(F.col("_size"), F.col("left") - number * F.col("_size"))))
        mixed = held.where(~tied).withColumn("_extra", extra).unionByName(several)
    kept = unpacked([c for c in docs.columns if c not in own])
    taken = (F.col("whole") * F.col("_size") + F.col("_extra")).cast("long")
    return mixed.select(*kept, *[F.col(c).alias(n) for c, n in zip(("_size", "source_size", "target"), own)], taken.alias(own[3]))


def repeat_rows(mixed: DataFrame, prefix: str = "") -> DataFrame:
    """A row for each repetition that mix_sources() takes; a fractional one keeps the document's leading words."""
    size, source_size, target, taken = (F.col(prefix + c) for c in ("size", "source_size", "target", "taken"))
    lead = F.regexp_replace("row.text", f"^[{SPACE}]+", "")
    words = F.split(lead, f"(?<=[{SPACE}])(?=[^{SPACE}])")
    copies = F.when(size > 0, F.floor(taken / size)).otherwise(F.when(target >= source_size, 1).otherwise(0)).cast("int")
    rows = packed(mixed, copies.alias("full"), F.when(size > 0, taken % size).otherwise(0).cast("int").alias("part"))
    rows = rows.withColumn("n", F.col("full") + (F.col("part") > 0).cast("int")).where("n > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    text = F.when(F.col("copy") <= F.col("full"), F.col("row.text")).otherwise(F.array_join(F.slice(words, 1, F.col("part")), ""))
    return rows.select(*unpacked(mixed.columns, text=text))
