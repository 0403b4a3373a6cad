"""Exact top-k inner products with a KD-tree for each shard.

Vectors are dealt to shards of at most about SHARD rows, and to as many as there are cores while those hold LEAST_SHARD, by
a tree of its own over them: median splits fitted on a sample of at most about SAMPLE vectors; a leaf that holds more is
dealt on by vec_id. Each shard's tree splits at medians of the dimension that spreads most and keeps each node's tight
bounding box. A query visits nodes best first by the largest inner product that a box allows, and stops at the first node
that can't reach its kth score so far. The kth scores propagate: a first pass answers each query from the shard that holds
it, and all other shards start from that answer's kth score.

Queries stay in a table. They are dealt to those other shards whose box, a row a shard, allows a score that reaches their
kth so far, and stand there after the shard's rows, so its tree is built once for all of them and they pass it in blocks of
at most BLOCK rows. A shard answers with at most k rows a query row.

Components are floor(scale * x) with x as double. Defined cases: null vectors and vectors with a null or non-finite
component take no part; shorter vectors count as ending in zeros; a query's own row is every row of its vec_id; rows that
repeat under one vec_id are candidates each, and queries each whose answers are ranked together under its query_id, so a
query row that stands twice has each answer twice among its k, unless by_row asks for k answers to every query row; scores are exact while they fit in a signed long; ties go to the smaller
vec_id; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from brickfield.llm.common import materialize
from brickfield.operators.neighbors import fit, route

#: Rows in a shard at most and, where that leaves cores idle, at least; rows read at once; and rows in a tree's leaf.
SHARD, LEAST_SHARD, BLOCK, LEAF = 1 << 16, 1 << 11, 1 << 13, 256
#: Queries whose bounds are computed at once.
SEARCHED = 256
#: Vectors of the sample that shards are cut by, about, and those of it that a shard has at least.
SAMPLE, FEW = 1 << 14, 8
#: Whole numbers up to here are exact as doubles, whose products are faster.
EXACT = 1 << 53


class KDTree:
    """Integer vectors under median splits; every node has its members' bounding box, and a leaf's members lie together."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.low, self.high, self.below = [], [], []
        ids, vectors = ids[order := np.argsort(ids, kind="stable")], vectors[order]
        rows, at = [], 0

        def grow(members: np.ndarray) -> int:
            """The number of a new node over the members; its children come before it."""
            nonlocal at
            low, high = vectors[members].min(axis=0), vectors[members].max(axis=0)
            spread = high - low
            if len(members) <= LEAF or not spread.any():
                rows.append(members)
                below = slice(at, at + len(members))
                at += len(members)
            else:
                axis, half = int(spread.argmax()), len(members) // 2
                members = members[np.argpartition(vectors[members, axis], half)]
                below = (grow(members[:half]), grow(members[half:]))
            self.low.append(low)
            self.high.append(high)
            self.below.append(below)
            return len(self.below) - 1

        self.root = grow(np.arange(len(ids)))
        rows = np.concatenate(rows)
        self.ids, self.vectors = ids[rows], vectors[rows]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.largest = max(int(self.high.max(initial=0)), -int(self.low.min(initial=0)))
        self.doubles = self.vectors.astype(float)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """By query and node: the largest inner product with any point of the node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def scores(self, leaf: slice, query: np.ndarray) -> np.ndarray:
        """Inner products with a leaf's members; as doubles where every sum is exact."""
        if self.largest * int(np.abs(query).sum()) < EXACT:
            return (self.doubles[leaf] @ query.astype(float)).astype(np.int64)
        return self.vectors[leaf] @ query

    def best(self, own: int, query: np.ndarray, bounds: np.ndarray, k: int, least: int | None) -> list[tuple[int, int]]:
        """(score, -vec_id) of the k best rows that reach `least`, without those of vec_id `own`."""
        found: list[tuple[int, int]] = []
        nodes = [(-int(bounds[self.root]), self.root)]
        while nodes:
            bound, node = heapq.heappop(nodes)
            kth = found[0][0] if len(found) == k else least
            if kth is not None and -bound < kth:
                break
            below = self.below[node]
            if isinstance(below, tuple):
                for x in below:
                    heapq.heappush(nodes, (-int(bounds[x]), x))
                continue
            scores, ids = self.scores(below, query), self.ids[below]
            places = np.flatnonzero(scores >= kth if kth is not None else np.ones(len(ids), dtype=bool))
            places = places[ids[places] != own]
            if len(places) > k:  # in the order of score, then vec_id
                places = places[np.lexsort((ids[places], -scores[places]))[:k]]
            for pair in zip(scores[places].tolist(), (-ids[places]).tolist()):
                if len(found) < k:
                    heapq.heappush(found, pair)
                elif pair > found[0]:
                    heapq.heapreplace(found, pair)
        return found


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and v: the integer components of the vectors that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("e", lambda x: F.floor(F.lit(float(scale)) * x).cast("long"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & finite).select("vec_id", whole.alias("v"))


def stack(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of equal width; shorter lists end in zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray, list, list]]:
    """shard, whether these are queries, ids, vectors, least scores and query rows of rows that stand together, at most BLOCK of them."""
    for b in batches:
        shards, asks = b.column("shard").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((np.diff(shards) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1).tolist(), b.num_rows]
        for first, end in zip(cuts, cuts[1:]):
            for start in range(first, end, BLOCK):
                part = b.slice(start, min(BLOCK, end - start))
                yield int(shards[start]), bool(asks[start]), part.column("vec_id").to_numpy(), stack(part.column("v"), width), part.column("least").to_pylist(), part.column("row").to_pylist()


ANSWERS = "query_id long, row long, home int, v array<long>, score long, vec_id long"


def own_answers(sharded: DataFrame, width: int, k: int, every: int) -> DataFrame:
    """Each query row's best rows of its own shard, `home`, with v only on a row of its own, of score null: the query itself.

    Each shard has a row besides, of query_id null, whose v is its box: the least components, then the largest. `row` tells
    query rows apart. A query row's kth score stands on its own row as vec_id, null where the shard has fewer than k others.
    """

    def answers(home: int, shard: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        ids, vectors = (np.concatenate(x) for x in zip(*shard))
        box = [None, None, home, np.concatenate([vectors.min(axis=0), vectors.max(axis=0)]).tolist(), None, None]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(box, schema.types)], schema=schema)
        places = np.flatnonzero(ids % every == 0)
        tree = KDTree(ids, vectors) if len(places) else None
        for i in range(0, len(places), SEARCHED):
            part = places[i : i + SEARCHED]
            rows: list[tuple] = []
            for row, q, vector, bounds in zip(range((home << 33) + i, (home << 33) + i + len(part)), ids[part].tolist(), vectors[part], tree.bounds(vectors[part])):
                found = tree.best(q, vector, bounds, k, None)
                rows.append((q, row, home, vector.tolist(), None, min(found)[0] if len(found) == k else None))
                rows += [(q, row, home, None, score, -minus) for score, minus in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for shard, _, ids, vectors, *_ in runs(batches, width):
            if shard != at and rows:
                yield from answers(at, rows)
                rows = []
            at = shard
            rows.append((ids, vectors))
        if rows:
            yield from answers(at, rows)

    kinds = {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(n, kinds[t]) for n, t in (c.split(" ") for c in ANSWERS.split(", "))])
    return sharded.mapInArrow(kernel, ANSWERS)


def search(rows: DataFrame, width: int, k: int) -> DataFrame:
    """query_id, row, score and vec_id: each shard's best rows for the queries dealt to it, which stand after its own rows."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard_rows, tree = None, [], None
        for shard, asks, ids, vectors, least, row in runs(batches, width):
            if shard != at:
                at, shard_rows, tree = shard, [], None
            if not asks:
                shard_rows.append((ids, vectors))
                continue
            if tree is None:
                if not shard_rows:
                    continue
                tree, shard_rows = KDTree(*(np.concatenate(x) for x in zip(*shard_rows))), []
            out: dict[str, list[int]] = {"query_id": [], "row": [], "score": [], "vec_id": []}
            for i in range(0, len(ids), SEARCHED):
                part = slice(i, i + SEARCHED)
                for q, r, vector, bounds, kth in zip(ids[part].tolist(), row[part], vectors[part], tree.bounds(vectors[part]), least[part]):
                    for score, minus in tree.best(q, vector, bounds, k, kth):
                        out["query_id"].append(q)
                        out["row"].append(r)
                        out["score"].append(score)
                        out["vec_id"].append(-minus)
            yield pa.record_batch({n: pa.array(x, pa.int64()) for n, x in out.items()})

    return rows.mapInArrow(kernel, "query_id long, row long, score long, vec_id long")


def dealt(rows: DataFrame, n: int, shards: int, width: int) -> DataFrame:
    """rows (vec_id, v) with shard, a whole number from 0, written."""
    share = min(1.0, SAMPLE / max(1, n))
    some = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share * (1 << 20)) if share < 1 else rows
    sample = stack(some.select("v").toArrow().column("v").combine_chunks(), width)  # SAMPLE rows, about
    cuts = fit(sample, max(FEW, len(sample) / shards)) if shards > 1 else {}
    known = rows.sparkSession.sparkContext.broadcast(cuts)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = np.concatenate([route(known.value, stack(b.column("v").slice(i, BLOCK), width)) for i in range(0, b.num_rows, BLOCK)] or [np.zeros(0, dtype=np.int64)])
            yield pa.record_batch([pa.array(leaf), b.column("vec_id"), b.column("v")], names=["leaf", "vec_id", "v"])

    routed = materialize(rows.select("vec_id", "v").mapInArrow(kernel, "leaf long, vec_id long, v array<long>"), "topk-leaves")
    at, table = 0, []
    for r in routed.groupBy("leaf").count().orderBy("leaf").collect():  # 2 * SAMPLE / FEW rows at most
        parts = -(-r["count"] // (2 * SHARD))
        table.append((r["leaf"], at, parts))
        at += parts
    leaves = F.broadcast(rows.sparkSession.createDataFrame(table, "leaf long, first int, parts int"))
    return routed.join(leaves, "leaf").select((F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int").alias("shard"), "vec_id", "v")


def reached(own: DataFrame, boxes: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """The queries of own_answers(), for each other shard that may reach their kth score: shard, query_id, v, its kth score and row."""
    known = own.sparkSession.sparkContext.broadcast(boxes)
    width = boxes[1].shape[1]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, low, high = known.value
        for b in batches:
            for i in range(0, b.num_rows, SEARCHED):
                part = b.slice(i, SEARCHED)
                q = stack(part.column("v"), width)
                bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                kth = part.column("vec_id")
                may = kth.is_null().to_numpy(zero_copy_only=False)[:, None] | (bounds >= kth.fill_null(0).to_numpy()[:, None])
                row, to = np.nonzero(may & (shard[None] != part.column("home").to_numpy()[:, None]))
                taken = part.take(pa.array(row))
                yield pa.record_batch([pa.array(shard[to], pa.int32()), *(taken.column(c) for c in ("query_id", "v", "vec_id", "row"))], names=["shard", "query_id", "v", "kth", "row"])

    return own.mapInArrow(kernel, "shard int, query_id long, v array<long>, kth long, row long")


def top_k(vectors: DataFrame, *, every: int = 100, k: int = 10, scale: int = 1024, by_row: bool = False) -> DataFrame:
    """query_id, rank, vec_id and score for the queries, rows whose vec_id is divisible by `every`.

    With by_row each query row has k answers of its own and a number, query_row, that tells it from others of its vec_id.
    """
    rows = materialize(integers(vectors, scale), "topk-vectors")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    shards, width = max(1, -(-size["n"] // SHARD), min(cores, size["n"] // LEAST_SHARD)), size["width"] or 0
    none = [F.lit(None).cast("long").alias(c) for c in ("least", "row")]
    sharded = materialize(dealt(rows, size["n"], shards, width), "topk-shards").select("shard", F.lit(False).alias("asks"), "vec_id", "v", *none)
    shards = (sharded.agg(F.max("shard")).first()[0] or 0) + 1
    # A shard for each partition, however small the tables are; a cluster's adaptive plan would put many in one task.
    deal = lambda df, *then: df.repartitionByRange(shards, "shard").sortWithinPartitions("shard", *then)
    own = materialize(own_answers(deal(sharded), width, k, every), "topk-own")
    found = own.where("v IS NULL").select("query_id", "row", "score", "vec_id")
    if shards > 1:
        ends = own.where("query_id IS NULL").select("home", "v").toArrow()  # a row a shard
        both = stack(ends.column("v").combine_chunks(), 2 * width)
        boxes = ends.column("home").to_numpy(), both[:, :width], both[:, width:]
        asked = materialize(reached(own.where("query_id IS NOT NULL AND v IS NOT NULL"), boxes), "topk-asked")
        asked = asked.select("shard", F.lit(True).alias("asks"), F.col("query_id").alias("vec_id"), "v", F.col("kth").alias("least"), "row")
        found = found.unionByName(search(deal(sharded.unionByName(asked), "asks"), width, k))
    of = ["query_id", "row"] if by_row else ["query_id"]
    in_order = Window.partitionBy(*of).orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", *([F.col("row").alias("query_row")] if by_row else []))
