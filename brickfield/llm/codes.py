"""Vector code compression: each part of a vector becomes the number of its nearest codebook entry.

Components are whole numbers, floor(scale * x) with x as double. A vector is cut into equal parts, and each position has a
codebook of its own, which starts as that part of the vectors of the smallest ids. A round broadcasts a kd-tree of every
codebook, assigns each part to its nearest entry and moves the entries to the floors of their parts' means. The search is
branch and bound over tight boxes; nodes whose bound equals the best distance so far are visited too, so that of equally
near entries the one of the lowest number is found. Tasks add up their parts' components as integers, one row for each
entry, and the sums of the tasks are added by a shuffle, so rounds are exact whatever the partitioning. What reaches the
driver is the codebooks: entries x width numbers, whatever the input.

Defined cases: null vectors and vectors with a null or non-finite component are dropped; shorter vectors count as ending in
zeros, and the width is that of the longest, made up to a multiple of the number of parts; repeated rows count as often as
they stand; of rows of one vec_id those of smaller integers come first into the codebook, and null ids come last; with fewer
vectors than entries the codebook has as many entries as vectors; distances are exact while they fit in a signed long; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brickfield.llm.common import bounded, materialize
from brickfield.llm.topk import stack

#: Members of a kd-tree's leaf, and vectors that are searched together.
LEAF, TOGETHER = 2, 1 << 13
#: Rows of a broadcast table of labels at most.
MOST_LABELS = 500_000


class KDTree:
    """A codebook's entries under median splits with tight boxes."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.nodes: list[tuple[np.ndarray, np.ndarray, tuple[int, int] | np.ndarray]] = []
        self.root = self.grow(np.arange(len(entries))) if len(entries) else -1

    def grow(self, members: np.ndarray) -> int:
        low, high = self.entries[members].min(axis=0), self.entries[members].max(axis=0)
        below: tuple[int, int] | np.ndarray = np.sort(members)
        if len(members) > LEAF:
            axis = int((high - low).argmax()) if len(low) else 0
            order = members[np.argsort(self.entries[members, axis], kind="stable")] if len(low) else members
            below = self.grow(order[: len(order) // 2]), self.grow(order[len(order) // 2 :])
        self.nodes.append((low, high, below))
        return len(self.nodes) - 1

    def bound(self, node: int, queries: np.ndarray) -> np.ndarray:
        """Squared distance of each query from a node's box."""
        low, high, _ = self.nodes[node]
        off = np.maximum(np.maximum(low - queries, queries - high), 0)
        return (off * off).sum(axis=1)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each query's nearest entry, of equal ones the lowest number, and its squared distance."""
        best = np.full(len(queries), len(self.entries), dtype=np.int64)
        least = np.full(len(queries), np.iinfo(np.int64).max)

        def visit(node: int, rows: np.ndarray) -> None:
            below = self.nodes[node][2]
            if not isinstance(below, tuple):
                for e in below.tolist():
                    off = queries[rows] - self.entries[e]
                    far = (off * off).sum(axis=1)
                    better = (far < least[rows]) | (far == least[rows]) & (e < best[rows])
                    least[rows[better]], best[rows[better]] = far[better], e
                return
            bounds = [self.bound(x, queries[rows]) for x in below]
            first = bounds[1] < bounds[0]  # the nearer child before the other
            for side in (0, 1):
                for turn in (0, 1):
                    of = first == side
                    child = side if turn == 0 else 1 - side
                    reach = of & (bounds[child] <= least[rows])  # an equal bound may hide a lower number
                    if reach.any():
                        visit(below[child], rows[reach])

        if len(queries):
            visit(self.root, np.arange(len(queries)))
        return best, least


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label and v, the integer components, of the vectors that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("e").isNotNull() & finite).select("vec_id", "label", F.transform("e", lambda x: F.floor(F.lit(float(scale)) * x).cast("long")).alias("v"))


def parts_of(batch: pa.RecordBatch, trees: list[KDTree], size: int) -> Iterator[tuple[int, list[np.ndarray], list[np.ndarray], list[np.ndarray]]]:
    """For some rows at a time: where they begin and, by part, their components, entries and squared distances."""
    for i in range(0, batch.num_rows, TOGETHER):
        rows = stack(batch.column("v").slice(i, TOGETHER), size * len(trees))
        parts = [rows[:, p * size : (p + 1) * size] for p in range(len(trees))]
        yield i, parts, *map(list, zip(*(t.nearest(x) for t, x in zip(trees, parts))))


def entry_sums(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, n and s: how many parts each entry has and the sums of their components."""
    trees, size, shape = rows.sparkSession.sparkContext.broadcast([KDTree(b) for b in books]), books.shape[2], books.shape

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(shape[:2], dtype=np.int64), np.zeros(shape, dtype=np.int64)
        for b in batches:
            for _, parts, found, _ in parts_of(b, trees.value, size):
                for p, (x, e) in enumerate(zip(parts, found)):
                    n[p] += np.bincount(e, minlength=shape[1])
                    order = np.argsort(e, kind="stable")
                    starts = np.flatnonzero(np.diff(e[order], prepend=-1))
                    sums[p, e[order][starts]] += np.add.reduceat(x[order], starts, axis=0)
        p, e = np.nonzero(n)
        yield pa.record_batch({"part": pa.array(p), "entry": pa.array(e), "n": pa.array(n[p, e]), "s": pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))})

    partial = rows.select("v").mapInArrow(kernel, "part long, entry long, n long, s array<long>")
    each = partial.select("part", "entry", "n", F.posexplode("s").alias("i", "x"))
    return each.groupBy("part", "entry", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("s"))


def first_books(rows: DataFrame, parts: int, entries: int, width: int) -> np.ndarray:
    """By part, entry and place: the parts of the vectors of the smallest ids."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()  # `entries` rows
    whole = np.array([r["v"] + [0] * (width - len(r["v"])) for r in first], dtype=np.int64).reshape(len(first), parts, width // parts)
    return whole.transpose(1, 0, 2).copy()


def train(rows: DataFrame, *, parts: int, entries: int, rounds: int) -> np.ndarray:
    """The codebooks, by part, entry and place, after `rounds` rounds over all rows (v)."""
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    books = first_books(rows, parts, entries, -(-longest // parts) * parts)
    for _ in range(rounds if books.size else 0):
        for r in entry_sums(rows, books).collect():  # a row for each component of the codebooks
            books[r["part"], r["entry"], r["i"]] = r["s"] // r["n"]
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error, the squared distance of each row from its entries."""
    trees, size = rows.sparkSession.sparkContext.broadcast([KDTree(b) for b in books]), books.shape[2]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, found, far in parts_of(b, trees.value, size):
                part = b.slice(i, TOGETHER)
                code = np.stack(found, axis=1).astype(np.uint8)
                yield pa.record_batch({
                    "vec_id": part.column("vec_id"), "label": part.column("label"), "code": pa.array([r.tobytes().hex() for r in code], pa.string()),
                    "error": pa.array(reduce(np.add, far)),
                })

    label = next(f.dataType.simpleString() for f in rows.schema.fields if f.name == "label")
    return rows.mapInArrow(kernel, f"vec_id long, label {label}, code string, error long")


def decode(codes: DataFrame, books: np.ndarray, scale: int) -> DataFrame:
    """codes with `vector`, the doubles that its entries stand for: the middle of each whole number's interval."""
    parts, _, size = books.shape
    table = F.array(*[F.array(*[F.array(*[F.lit((int(x) + 0.5) / scale) for x in e]) for e in b]) for b in books])
    place = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("vector", F.concat(*[table[p][place(p)] for p in range(parts)]))


def compress(vectors: DataFrame, *, scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code and error of each vector that takes part, and the codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part, so a codebook has 1 to 256 entries")
    rows = materialize(whole_vectors(vectors, scale), "codes-vectors")
    books = train(rows, parts=parts, entries=entries, rounds=rounds)
    return encode(rows, books), books


def code_digest(vectors: DataFrame, **sizes: int) -> DataFrame:
    codes, books = compress(vectors, **sizes)
    rows = materialize(codes, "codes")
    of = rows.groupBy(F.col("label").alias("_of")).agg(F.sum("error").alias("label_error"))
    said = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    whole = rows.join(bounded(of, MOST_LABELS), F.col("label").eqNullSafe(F.col("_of")))
    return whole.select("vec_id", "code", "error", "label_error", F.lit(said).alias("codebooks_sha256"))
