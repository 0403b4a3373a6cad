"""Chat formatting: snapshots of growing conversations collapse to the longest ones, which are rendered.

A logged conversation that is the beginning of a longer one, turn by turn, is left out, and of equal ones that with the
smallest conv_id stays. Every turn is hashed with its place; the XOR of the hashes so far is the rolling hash of a prefix.
Distinct prefixes are gathered, and an anti-join drops the conversations whose whole hash is a prefix of another.

Turns are dealt by ranges of (conv_id, turn), so one conversation may span tasks: places and rolling hashes are counted
within each range and carried over from the ranges before. These steps move two hashes of a turn instead of its text. Texts
are shuffled once, to be gathered, and those of conversations of over PART turns once more: no conversation is gathered in
one task, but in parts of at most PART turns, and one part is a row.

Defined cases: turns are in the order of turn, null first, then of their hash; a null role counts as "user" and a null text
as empty; the null conv_id is a conversation of its own, after all others; repeated turns are turns of their own; an empty
table gives an empty result; extra columns are not read. Markers in a text are broken by a space.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from brickfield.llm.common import MOST_DROPPED, bounded, materialize

#: Turns in a rendered row at most.
PART = 1000
#: A turn's place in its conversation, but for turns that are alike.
ORDER = ("turn", "_h", "_g")


def hashed(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and _h and _g, two hashes of the latter."""
    said = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return said.withColumn("_h", F.xxhash64("role", "text")).withColumn("_g", F.xxhash64(F.lit(2), "role", "text"))


def place_turns(turns: DataFrame) -> DataFrame:
    """conv_id and the ORDER columns of turns with _p, their range, and place, from 1 in each conversation."""
    order = ("conv_id", *ORDER)
    keys = hashed(turns).select(*order)
    ranged = keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    ranged = materialize(ranged, "chat-ranges")
    rows = ranged.withColumn("_key", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    before = Window.partitionBy("_key").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy("_p", "_key").agg(F.count("*").alias("own")).withColumn("before", F.coalesce(F.sum("own").over(before), F.lit(0))).drop("own")
    here = F.row_number().over(Window.partitionBy("_p", "_key").orderBy("_i"))
    return rows.join(carry, ["_p", "_key"]).select("conv_id", *ORDER, (F.col("before") + here).alias("place"), "_p", "_key")


def rolling_hashes(placed: DataFrame) -> DataFrame:
    """conv_id, the ORDER columns, place and the hash (a, b) of the conversation up to there."""
    rows = placed.select("*", *[F.xxhash64(F.lit(salt), "place", "_h", "_g").alias(c) for salt, c in ((1, "a"), (2, "b"))])
    sums = rows.groupBy("_p", "_key").agg(*[F.bit_xor(c).alias(f"own_{c}") for c in "ab"])
    before = Window.partitionBy("_key").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("_p", "_key", *[F.coalesce(F.bit_xor(f"own_{c}").over(before), F.lit(0)).alias(f"before_{c}") for c in "ab"])
    upto = Window.partitionBy("_p", "_key").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(carry, ["_p", "_key"])
    return joined.select("conv_id", *ORDER, "place", *[F.bit_xor(c).over(upto).bitwiseXOR(F.col(f"before_{c}")).alias(c) for c in "ab"])


def maximal(hashes: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that stay."""
    sizes = hashes.groupBy("conv_id").agg(F.max("place").alias("n_turns"))
    same = F.col("h.conv_id").eqNullSafe(F.col("s.conv_id"))
    ended = hashes.select("conv_id", "place", "a", "b").alias("h").join(sizes.alias("s"), same).select("h.conv_id", "place", "a", "b", "n_turns")
    prefixes = ended.where("place < n_turns").select("place", "a", "b").distinct()
    whole = ended.where("place = n_turns").groupBy("n_turns", "a", "b").agg(F.min("conv_id").alias("conv_id")).withColumnRenamed("n_turns", "place")
    return whole.join(prefixes, ["place", "a", "b"], "left_anti").select("conv_id", F.col("place").alias("n_turns"))


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, part and text of the conversations that stay, in the form of <|im_start|>role ... <|im_end|>."""
    hashes = materialize(rolling_hashes(place_turns(turns)), "chat-hashes")
    stay = materialize(maximal(hashes), "chat-maximal")
    plain = lambda c: F.replace(F.col(c), F.lit("<|"), F.lit("< |"))
    turn = F.concat(F.lit("<|im_start|>"), plain("role"), F.lit("\n"), plain("text"), F.lit("<|im_end|>\n"))
    said = hashed(turns).withColumn("said", turn)

    def of(kept: DataFrame, rows: DataFrame) -> DataFrame:
        """rows of the kept conversations, with n_turns."""
        ids = bounded(kept.select(F.col("conv_id").alias("_id"), "n_turns"), MOST_DROPPED)
        return rows.join(ids, F.col("conv_id").eqNullSafe(F.col("_id"))).drop("_id")

    short, long = stay.where(F.col("n_turns") <= PART), stay.where(F.col("n_turns") > PART)
    rows = of(short, said).select("conv_id", "n_turns", F.lit(0).cast("long").alias("part"), F.struct(*ORDER, "said").alias("t"), F.lit(1).cast("long").alias("copies"))
    if not long.isEmpty():
        # Turns that are alike are one row, whose first place is that of its hashes.
        distinct = of(long, said).groupBy("conv_id", *ORDER, "n_turns").agg(F.first("said").alias("said"))
        places = of(long, hashes).groupBy("conv_id", *ORDER).agg(F.min("place").alias("place"), F.count("*").alias("n"))
        same = [F.col(f"d.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("conv_id", *ORDER)]
        first, last = F.floor((F.col("place") - 1) / PART), F.floor((F.col("place") + F.col("n") - 2) / PART)
        parts = distinct.alias("d").join(places.alias("p"), same).withColumn("part", F.explode(F.sequence(first, last)))
        copies = F.least(F.col("place") + F.col("n"), (F.col("part") + 1) * PART + 1) - F.greatest("place", F.col("part") * PART + 1)
        rows = rows.unionByName(parts.select("d.conv_id", "n_turns", "part", F.struct(*[F.col(f"d.{c}") for c in ORDER], "said").alias("t"), copies.cast("long").alias("copies")))
    gathered = rows.groupBy("conv_id", "n_turns", "part").agg(F.array_sort(F.collect_list(F.struct("t", "copies"))).alias("turns"))
    return gathered.select("conv_id", "n_turns", "part", F.array_join(F.transform("turns", lambda x: F.repeat(x["t"]["said"], x["copies"].cast("int"))), "").alias("text"))
