"""Embedding near-duplicates through a forest of random-projection trees with spill.

Vectors of equal components are one class. A tree splits at the median of a random projection; what lies within a margin of
the cut goes to both sides. The margin and a pair at the least cosine are both in proportion to 1 / sqrt(width), so a split
parts about one such pair in twenty, at every size, and closer pairs less often; a pair is lost if all trees part it. A
round fits its trees on a bounded sample of at most about SAMPLE classes and then deals every class to the leaves; leaves
that hold over BIG classes are fitted and dealt anew, each on a sample of its own, until none does. A leaf is left whole
where a split would send over half of it to both sides, that is where nearly everything is near everything else.

Within a leaf all classes are compared, in packs of PACK that meet pairwise, so a leaf of any size is many tasks' work. A
pair that meets in several leaves counts in the first of them that both are in, so links are counted where they are found
and no pair leaves its task: each pack reports the links of its classes and a spanning star of their components.
operators.graphs.components joins the stars of all packs.

A link is dot / (|u| |v|) >= least in double precision; a first pass in single precision only settles what is farther from
`least` than its error. Defined cases: vectors that are null, zero or have a null or non-finite component, and rows without
vec_id, link with nothing and are their own component (null without vec_id); shorter vectors count as ending in zeros;
repeated rows are vectors of their own, linked to each other; an empty table gives an empty result; extra columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from brickfield.llm.common import materialize
from brickfield.operators.graphs import components

#: Trees, and the margin of a cut times the square root of the width.
TREES, SPILL = 8, 0.16
#: Classes of a sample, those of a node at least, and those that a leaf is meant to have.
SAMPLE, FEW, LEAF = 1 << 15, 32, 256
#: Classes of a leaf beyond which it is dealt anew, and classes of a pack.
BIG, PACK = 1 << 13, 1 << 12
#: Share of a node that may go to both sides, and rounds of dealing.
SHARED, ROUNDS = 0.5, 8
#: Rows compared at once, pairs whose leaves are looked up at once, and leaves in a table of bits.
ROWS, PAIRS, COLUMNS = 512, 1 << 14, 1 << 12


def number(*of: int) -> int:
    """A positive number of 63 bits for a leaf or a tree."""
    return int.from_bytes(hashlib.blake2b(repr(of).encode(), digest_size=8).digest(), "little") >> 1


@lru_cache(1 << 14)
def direction(seed: int, node: int, width: int) -> np.ndarray:
    d = np.random.default_rng((seed, node)).standard_normal(width)
    return (d / np.linalg.norm(d)).astype(np.float32)


def fit(seed: int, units: np.ndarray, total: float) -> dict[int, float]:
    """The cuts of a tree by node (the children of i are 2 i and 2 i + 1), from a sample that stands for `total` classes."""
    cuts: dict[int, float] = {}
    margin, waiting, each = SPILL / np.sqrt(units.shape[1]), [(1, np.arange(len(units)))], total / max(1, len(units))
    while waiting:
        node, members = waiting.pop()
        if len(members) < FEW or len(members) * each <= LEAF:
            continue
        at = units[members] @ direction(seed, node, units.shape[1])
        cut = float(np.median(at))
        left, right = at <= cut + margin, at > cut - margin
        if (left & right).mean() > SHARED:
            continue
        cuts[node] = cut
        waiting += [(2 * node, members[left]), (2 * node + 1, members[right])]
    return cuts


def route(seed: int, cuts: dict[int, float], units: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Leaf nodes and the places of their rows."""
    margin, waiting = SPILL / np.sqrt(units.shape[1]), [(1, np.arange(len(units)))]
    while waiting:
        node, members = waiting.pop()
        if not len(members):
            continue
        if node not in cuts:
            yield node, members
            continue
        at = units[members] @ direction(seed, node, units.shape[1])
        waiting += [(2 * node, members[at <= cuts[node] + margin]), (2 * node + 1, members[at > cuts[node] - margin])]


def doubles(column: pa.Array, width: int, kind: str) -> np.ndarray:
    """Rows of components stored as bytes; shorter ones end in zeros."""
    out, size = np.zeros((len(column), width)), np.dtype(kind).itemsize
    counts = pc.binary_length(column).to_numpy() // size
    flat = np.frombuffer(b"".join(column.to_pylist()), dtype=kind)
    out[np.arange(width) < counts[:, None]] = flat
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one in single precision; components are brought into range first."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True, initial=0)
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def stored(vectors: DataFrame) -> tuple[DataFrame, str]:
    """vec_id and v, the components as bytes without zeros at the end (null where the vector takes no part), of every row; and their kind."""
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes | None] = []
            for x in b.column("embedding").to_pylist():
                # Adding zero makes -0.0 equal 0.0.
                a = np.trim_zeros(np.array(x, dtype=kind) + 0, "b") if x is not None and all(c is not None for c in x) else np.zeros(0)
                out.append(a.tobytes() if len(a) and np.isfinite(a).all() else None)
            yield pa.record_batch({"vec_id": b.column("vec_id"), "v": pa.array(out, pa.binary())})

    element = "float" if kind == "<f4" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{element}>").alias("embedding"))
    return rows.mapInArrow(kernel, "vec_id long, v binary"), kind


def first_leaves(classes: DataFrame, sample: np.ndarray, total: int, width: int, kind: str, trees: int) -> DataFrame:
    """c and leaves: the leaves of every class in all trees, fitted on the sample, in order."""
    seeds = [number(0, t) for t in range(trees)]
    models = classes.sparkSession.sparkContext.broadcast([(s, fit(s, sample, total)) for s in seeds])  # at most 2 SAMPLE / FEW cuts a tree

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            units, rows, leaves = unit(doubles(b.column("v"), width, kind)), [], []
            for seed, cuts in models.value:
                for node, members in route(seed, cuts, units):
                    rows.append(members)
                    leaves.append(np.full(len(members), number(seed, node)))
            rows, leaves = np.concatenate(rows), np.concatenate(leaves)
            order = np.lexsort((leaves, rows))
            starts = np.searchsorted(rows[order], np.arange(b.num_rows + 1))
            yield pa.record_batch({"c": b.column("c"), "leaves": pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(leaves[order]))})

    return classes.select("c", "v").mapInArrow(kernel, "c long, leaves array<long>")


def again(rows: DataFrame, width: int, kind: str) -> DataFrame:
    """c and leaf: the new leaves of rows (c, leaf, v, n: the leaf's classes), each leaf fitted on a sample of its own."""
    share = F.least(F.lit(1.0), F.lit(float(SAMPLE // 8)) / F.col("n"))
    some = rows.where(F.pmod(F.xxhash64("c", "leaf"), F.lit(1 << 20)) < share * (1 << 20))

    def fitted(group: pa.Table) -> pa.Table:
        leaf, n = group.column("leaf")[0].as_py(), group.column("n")[0].as_py()
        cuts = fit(leaf, unit(doubles(group.column("v").combine_chunks(), width, kind)), n)
        return pa.table({"leaf": [leaf], "n": [n], "nodes": [list(cuts)], "cuts": [list(cuts.values())]}, schema=pa.schema([("leaf", pa.int64()), ("n", pa.int64()), ("nodes", pa.list_(pa.int64())), ("cuts", pa.list_(pa.float64()))]))

    models = materialize(some.select("leaf", "n", "v").groupBy("leaf").applyInArrow(fitted, "leaf long, n long, nodes array<long>, cuts array<double>"), "forest-models")
    # A leaf's rows are dealt to as many parts as it has PACKs; its model stands before the rows of each part.
    packs = F.ceil(F.col("n") / PACK).cast("int")
    asked = models.select("leaf", F.explode(F.sequence(F.lit(0), packs - 1)).alias("part"), F.lit(None).cast("long").alias("c"), F.lit(None).cast("binary").alias("v"), "nodes", "cuts")
    dealt = rows.select("leaf", F.pmod(F.xxhash64("c"), packs).cast("int").alias("part"), "c", "v", *[F.lit(None).cast(t).alias(x) for x, t in (("nodes", "array<long>"), ("cuts", "array<double>"))])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts: dict[int, float] = {}
        for b in batches:
            c, leaf, model = b.column("c"), b.column("leaf").to_numpy(), b.column("c").is_null().to_numpy(zero_copy_only=False)
            starts = sorted({0, *np.flatnonzero(model).tolist()})
            for i, j in zip(starts, [*starts[1:], b.num_rows]):
                if model[i]:
                    cuts = dict(zip(b.column("nodes")[i].as_py(), b.column("cuts")[i].as_py()))
                    i += 1
                if i < j:
                    ids, seed = c.slice(i, j - i).to_numpy(), int(leaf[i])
                    parts = list(route(seed, cuts, unit(doubles(b.column("v").slice(i, j - i), width, kind))))
                    new = [np.full(len(members), number(seed, node) if cuts else seed) for node, members in parts]
                    yield pa.record_batch({"c": pa.array(ids[np.concatenate([x for _, x in parts])]), "leaf": pa.array(np.concatenate(new))})

    return dealt.unionByName(asked).repartition("leaf", "part").sortWithinPartitions("leaf", "part", F.col("c").asc_nulls_first()).mapInArrow(kernel, "c long, leaf long")


def leaves_of(classes: DataFrame, total: int, width: int, kind: str, trees: int) -> DataFrame:
    """c and leaves, in order; every leaf is within BIG but those that can't be split."""
    share = min(1.0, SAMPLE / max(1, total))
    some = classes.where(F.pmod(F.xxhash64("c"), F.lit(1 << 20)) < share * (1 << 20)).select("v").toArrow()  # SAMPLE rows, about
    first = materialize(first_leaves(classes, unit(doubles(some.column("v").combine_chunks(), width, kind)), total, width, kind, trees), "forest-leaves")
    found, whole, turned = first.select("c", F.explode("leaves").alias("leaf")), None, False
    for _ in range(ROUNDS):
        sizes = found.groupBy("leaf").agg(F.count("*").alias("n"))
        big = sizes.where(F.col("n") > BIG)
        big = materialize(big.join(whole, "leaf", "left_anti") if whole else big, "forest-big")
        if big.isEmpty():
            break
        rows = found.join(big, "leaf").join(classes.select("c", "v"), "c")
        dealt = materialize(again(rows.select("c", "leaf", "v", "n"), width, kind), "forest-again")
        # A leaf that comes back under its own number can't be split.
        stay = materialize(dealt.select("leaf").distinct().join(big, "leaf", "left_semi").select("leaf"), "forest-whole")
        whole = stay if whole is None else whole.unionByName(stay)
        found, turned = found.join(big, "leaf", "left_anti").unionByName(dealt), True
    return found.groupBy("c").agg(F.array_sort(F.collect_list("leaf")).alias("leaves")) if turned else first  # those of one class


class Earlier:
    """Of a leaf's classes the leaves of smaller numbers that several of them are in, a bit each."""

    def __init__(self, leaf: int, leaves: np.ndarray, sizes: np.ndarray):
        row, before = np.repeat(np.arange(len(sizes)), sizes), leaves < leaf
        _, column, count = np.unique(leaves[before], return_inverse=True, return_counts=True)
        several = count > 1
        row, column = row[before][several[column]], (np.cumsum(several) - 1)[column[several[column]]]
        self.bits = []
        for at in range(0, int(several.sum()), COLUMNS):
            here = (column >= at) & (column < at + COLUMNS)
            wide = np.zeros((len(sizes), COLUMNS), dtype=bool)
            wide[row[here], column[here] - at] = True
            self.bits.append(np.packbits(wide, axis=1).view(np.uint64))

    def shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For pairs of places: whether both are in one of them."""
        out = np.zeros(len(i), dtype=bool)
        for k in range(0, len(i), PAIRS):
            part = slice(k, k + PAIRS)
            for bits in self.bits:
                out[part] |= (bits[i[part]] & bits[j[part]]).any(axis=1)
        return out


class Pack:
    """Classes of a leaf: ids, how many vectors each is, vectors, units, and the leaves of all with the number of each."""

    def __init__(self, rows: pa.Table, width: int, kind: str):
        rows = rows.combine_chunks()
        self.ids, self.n = rows.column("c").to_numpy(), rows.column("n").to_numpy()
        self.vectors = doubles(rows.column("v").combine_chunks(), width, kind)
        self.units = unit(self.vectors)
        sets = rows.column("leaves").combine_chunks()
        self.leaves, self.sizes = sets.flatten().to_numpy(), pc.list_value_length(sets).to_numpy()


def linked(u: Pack, v: Pack, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs, as places in u and v; of a pack with itself, each pair once."""
    error = max(1e-4, 2e-7 * u.units.shape[1])
    for a in range(0, len(u.ids), ROWS):
        for b in range(a if u is v else 0, len(v.ids), ROWS):
            near = u.units[a : a + ROWS] @ v.units[b : b + ROWS].T
            i, j = np.nonzero(near >= least - error)
            close = np.abs(near[i, j] - least) <= error
            i, j = i + a, j + b
            if u is v:
                ahead = j > i
                i, j, close = i[ahead], j[ahead], close[ahead]
            doubt = np.flatnonzero(close)
            if len(doubt):
                x, y = u.vectors[i[doubt]], v.vectors[j[doubt]]
                cosine = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
                far = doubt[~(cosine >= least)]
                i, j = np.delete(i, far), np.delete(j, far)
            if len(i):
                yield i, j


def join_ends(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of a and b, whose members point at their smallest one."""
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def in_leaves(rows: DataFrame, width: int, kind: str, least: float) -> DataFrame:
    """c with links, the linked vectors of other classes that are counted here, or with v, an edge to another class."""

    def found(leaf: int, group: pa.Table) -> pa.RecordBatch | None:
        own = pc.equal(group.column("own"), group.column("i"))
        u = Pack(group.filter(own), width, kind)
        v = u
        if group.column("i")[0] != group.column("j")[0]:
            v = Pack(group.filter(pc.invert(own)), width, kind)
        sides = [u] if u is v else [u, v]
        ids, n, leaves, sizes = (np.concatenate([getattr(s, x) for s in sides]) for x in ("ids", "n", "leaves", "sizes"))
        earlier = Earlier(leaf, leaves, sizes)
        links, root, offset = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids)), 0 if u is v else len(u.ids)
        for i, j in linked(u, v, least):
            j = j + offset
            join_ends(root, i, j)
            here = ~earlier.shared(i, j)
            np.add.at(links, i[here], n[j[here]])
            np.add.at(links, j[here], n[i[here]])
        some, moved = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(ids)))
        return pa.record_batch({
            "c": pa.array(np.concatenate([ids[some], ids[moved]])),
            "links": pa.array(np.concatenate([links[some], np.zeros(len(moved), dtype=np.int64)])),
            "v": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[root[moved]])]),
        })

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            keys = np.stack([b.column(x).to_numpy() for x in ("leaf", "i", "j")], axis=1)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for x, y in zip(starts, starts[1:]):
                if y > x and (key := tuple(keys[x].tolist())) != at:
                    if held:
                        yield found(at[0], pa.Table.from_batches(held))
                    at, held = key, []
                held.append(b.slice(x, y - x))
        if held:
            yield found(at[0], pa.Table.from_batches(held))

    return rows.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j").mapInArrow(kernel, "c long, links long, v long")


def link_vectors(vectors: DataFrame, *, least: float = 0.9, trees: int = TREES) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding)."""
    if not 0 < least <= 1:
        raise ValueError("least lies in (0, 1]")
    raw, kind = stored(vectors)
    good = F.col("vec_id").isNotNull() & F.col("v").isNotNull()
    rows = materialize(raw.withColumn("key", F.when(good, F.sha2("v", 256))), "forest-vectors")
    grouped = rows.where("key IS NOT NULL").groupBy("key").agg(F.first("v").alias("v"), F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = materialize(grouped.withColumn("c", F.monotonically_increasing_id()), "forest-classes")
    size = classes.agg(F.count("*").alias("n"), F.max(F.length("v")).alias("bytes")).first()
    width = max(1, (size["bytes"] or 0) // np.dtype(kind).itemsize)
    sets = materialize(leaves_of(classes, size["n"], width, kind, trees), "forest-dealt")
    sizes = sets.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1").select("leaf", F.ceil(F.col("n") / PACK).cast("int").alias("packs"))
    placed = sets.join(classes.select("c", "n", "v"), "c").select("c", "n", "v", "leaves", F.explode("leaves").alias("leaf")).join(sizes, "leaf")
    own = F.pmod(F.xxhash64("c"), F.col("packs")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("packs") - 1))
    pairs = placed.withColumn("own", own).withColumn("other", other)
    pairs = pairs.select("leaf", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "c", "n", "v", "leaves")
    said = materialize(in_leaves(pairs, width, kind, least), "forest-links")
    links = said.where("v IS NULL").groupBy("c").agg(F.sum("links").alias("links"))
    roots = components(said.where("v IS NOT NULL").select(F.col("c").alias("u"), "v")).select(F.col("u").alias("c"), F.col("v").alias("root"))
    rooted = classes.select("c", "key", "n", "least").join(links, "c", "left").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    rooted = materialize(rooted, "forest-rooted")
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(lowest, "root").select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "key").join(named, "key", "left")
    own_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own_id.alias("component_id"), F.coalesce(F.col("vec_id") == own_id, F.lit(True)).alias("kept"))
