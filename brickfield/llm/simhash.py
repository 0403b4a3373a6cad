"""SimHash near-duplicates through a Gray-order hierarchical index.

A fingerprint bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of a text's 3-word shingles. Distinct
fingerprints within `reach` differing bits are linked; the components of the links are the groups.

Fingerprints are cut into reach + 2 blocks. Two within reach agree on at least two blocks, so they meet in the shard of
some pair of equal blocks; a shard over MOST_IN_SHARD fingerprints is dealt once more by the blocks of what is left. In
its shard every fingerprint is looked up in an index: members in the order of their Gray rank, so that neighbours differ
in few bits; each node holds the bits that its whole group shares and its parent doesn't, and a group is left out as soon
as the differences added up on the way down exceed reach. A shard passes on a spanning star for each component it sees, at
most one edge per fingerprint and no pairs. operators.graphs.components joins the stars of all shards.

Defined cases: null, empty and blank texts have the fingerprint zero and are linked like any other; documents of equal
fingerprints are one group; component_id is the smallest non-null doc_id of a group, or null if it has none; repeated
rows are reported as often as they stand; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from brickfield.llm.common import MOST_DROPPED, bounded, materialize, packed, unpacked
from brickfield.operators.graphs import components

BITS = 64
#: Children of an index node, and members of a leaf.
FAN = 16
#: Distinct fingerprints in a shard beyond which it is dealt once more.
MOST_IN_SHARD = 1024
#: Look-ups that go down the index together, and hashes whose bits are counted together.
TOGETHER, HASHES = 512, 1 << 15


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    runs = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    hashes = np.fromiter((digest(join(r), 42) for r in runs), dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), HASHES):
        bits = np.unpackbits(hashes[i : i + HASHES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text and fp (the fingerprint as a signed long) of every row."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.fromiter((fingerprint(t or b"") for t in b.column("text").to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "row": b.column("row"), "fp": pa.array(prints.view(np.int64))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(kernel, "doc_id long, row long, fp long")


def gray_rank(fp: Column) -> Column:
    """The place of fp in the Gray code, shifted so that signed order is its order."""
    for by in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, by))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


class GrayIndex:
    """Fingerprints in Gray order under nodes that hold the bits their groups share."""

    def __init__(self, members: np.ndarray):
        self.members = members
        levels, ones, zeros = [], members, ~members
        while len(ones) > 1 or not levels:
            starts = np.arange(0, len(ones), FAN)
            ones, zeros = np.bitwise_and.reduceat(ones, starts), np.bitwise_and.reduceat(zeros, starts)
            levels.append((ones | zeros, ones))
        #: From the root: of each node the bits that it shares and its parent doesn't, and their values.
        self.levels, above = [], np.zeros(1, dtype=np.uint64)
        for shared, pattern in reversed(levels):
            own = shared & ~np.repeat(above, FAN)[: len(shared)]
            self.levels.append((own, pattern & own))
            above = shared
        self.leaf_shared = above

    @staticmethod
    def below(node: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The children of nodes, as far as there are any, and which node each belongs to."""
        child = (node[:, None] * FAN + np.arange(FAN)).ravel()
        parent, there = np.repeat(np.arange(len(node)), FAN), child < size
        return child[there], parent[there]

    def within(self, queries: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, member), as places, of at most reach differing bits."""
        query, node = np.arange(len(queries)), np.zeros(len(queries), dtype=np.int64)
        differ = np.zeros(len(queries), dtype=np.int64)
        for depth, (own, pattern) in enumerate(self.levels):
            if depth:
                node, parent = self.below(node, len(own))
                query, differ = query[parent], differ[parent]
            differ = differ + np.bitwise_count((queries[query] ^ pattern[node]) & own[node])
            near = differ <= reach
            query, node, differ = query[near], node[near], differ[near]
        member, leaf = self.below(node, len(self.members))
        query, differ, shared = query[leaf], differ[leaf], self.leaf_shared[node[leaf]]
        near = differ + np.bitwise_count((queries[query] ^ self.members[member]) & ~shared) <= reach
        return query[near], member[near]


def stars(members: np.ndarray, reach: int) -> Iterator[tuple[int, int]]:
    """(place, smaller place): for each component of the links among members in Gray order, a star around its first."""
    root = list(range(len(members)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    index = GrayIndex(members)
    for i in range(0, len(members), TOGETHER):
        query, member = index.within(members[i : i + TOGETHER], reach)
        ahead = member > query + i
        for a, b in zip((query[ahead] + i).tolist(), member[ahead].tolist()):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return ((x, r) for x in range(len(members)) if (r := find(x)) != x)


def shards(prints: DataFrame, reach: int) -> DataFrame:
    """fp with each shard that it is looked up in: the pair of blocks, their values, and those of a second dealing."""
    n = reach + 2
    edges = [BITS * i // n for i in range(n + 1)]
    masks = [sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in pair) for pair in combinations(range(n), 2)]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    first = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("value")) for m in masks])).alias("s")).select("fp", "s.*")
    sizes = materialize(first.groupBy("mask", "value").count().where("count > 1"), "simhash-shards")
    full = sizes.where(F.col("count") <= MOST_IN_SHARD).select("mask", "value")
    large = sizes.where(F.col("count") > MOST_IN_SHARD).select("mask", "value")
    dealt = first.join(full, ["mask", "value"]).select("fp", "mask", "value")
    if large.isEmpty():
        return dealt
    # What a large shard leaves open is cut into reach + 1 blocks, of which a linked pair has one in common.
    again = []
    for m in masks:
        open_bits = [b for b in range(BITS) if not m >> b & 1]
        for i in range(reach + 1):
            more = m | sum(1 << b for b in open_bits[len(open_bits) * i // (reach + 1) : len(open_bits) * (i + 1) // (reach + 1)])
            again.append((signed(m), signed(more)))
    more = F.filter(F.array(*[F.struct(F.lit(m).alias("of"), F.lit(x).alias("mask")) for m, x in again]), lambda s: s["of"] == F.col("mask"))
    second = first.join(large, ["mask", "value"]).select("fp", F.explode(more).alias("s")).select("fp", "s.mask", F.col("fp").bitwiseAND(F.col("s.mask")).alias("value"))
    return dealt.unionByName(second)


def links(prints: DataFrame, reach: int) -> DataFrame:
    """Edges u > v among distinct fingerprints (as Gray ranks' fps); their components are those of all links."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 3), dtype=np.int64)

        def edges(rows: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            u, v = [], []
            for shard in np.split(rows[:, 2], cuts) if len(rows) else []:
                if len(shard) > 1:
                    for x, r in stars(shard.astype(np.int64).view(np.uint64), reach):
                        u.append(shard[x])
                        v.append(shard[r])
            return pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

        for b in batches:
            held = np.concatenate([held, np.stack([b.column(i).to_numpy() for i in range(3)], axis=1)])
            same = (held[:, :2] == held[-1, :2]).all(axis=1)
            whole = len(held) - int(same[::-1].argmin()) if not same.all() else 0
            if whole:
                yield edges(held[:whole])
                held = held[whole:]
        if len(held):
            yield edges(held)

    dealt = shards(prints, reach).repartition("mask", "value").sortWithinPartitions("mask", "value", gray_rank(F.col("fp")))
    found = dealt.select("mask", "value", "fp").mapInArrow(kernel, "u long, v long")
    return found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def group_documents(docs: DataFrame, reach: int = 2) -> DataFrame:
    """doc_id, row (a hash of the text), fp, root and component_id of every row."""
    prints = materialize(fingerprints(docs), "simhash-prints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    roots = components(links(classes.select("fp"), reach))
    rooted = classes.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(rooted.join(lowest, "root").select("fp", "root", "component_id"), "simhash-named")
    return prints.join(named, "fp")


def simhash_digest(docs: DataFrame) -> DataFrame:
    rows = group_documents(docs.select("doc_id", "text"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, reach: int = 2) -> DataFrame:
    """docs with one document of each group: that with the smallest doc_id, null last, then the smallest hash of its text.

    Of rows that repeat under one doc_id and text the one that comes first as JSON stays; only such rows are shuffled.
    """
    rows = materialize(group_documents(docs, reach), "simhash-groups")
    stay = rows.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row")).alias("s")).select(F.col("s.doc_id").alias("_id"), F.col("s.row").alias("_row"))
    each = rows.groupBy("doc_id", "row").agg(F.count("*").alias("copies"))
    gone = each.join(stay, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left_anti")
    gone = materialize(gone.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row")), "simhash-gone")
    hashed, same = packed(docs, "doc_id", F.xxhash64("text").alias("hash")), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_row"))
    kept = hashed.join(bounded(gone, MOST_DROPPED), same, "left_anti")
    often = each.where("copies > 1").join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left_anti")
    often = materialize(often.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row")), "simhash-often")
    if often.isEmpty():
        return kept.select(*unpacked(docs.columns))
    repeated = kept.join(bounded(often, MOST_DROPPED), same, "left_semi")
    first = repeated.groupBy("doc_id", "hash").agg(F.min_by("row", F.to_json("row")).alias("row"))
    single = kept.join(bounded(often, MOST_DROPPED), same, "left_anti")
    return single.select("row").unionByName(first.select("row")).select(*unpacked(docs.columns))
