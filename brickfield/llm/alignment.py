"""Cross-tokenizer alignment: which ids of two tokenizers cover the same bytes, and how often over the corpus.

A text's tokens under A and B are spans of the same bytes. Byte offsets where tokens of both end cut them into groups; an A
and a B token are linked where their spans overlap. Each stretch between neighbouring offsets, of either side, is one link,
so texts are laid end to end and aligned by merging two sorted arrays of offsets.

A pair of ids is one integer, B's id above 32 bits and A's below. Tasks count their pairs with np.unique, the partial counts
are dealt by ranges of the key and sorted, and each range is summed by run lengths into a shard: its sorted keys and their
counts. Look-ups map the shards into memory and search them for the keys at hand, so a task holds the pages that it touches
and no table of all pairs. Of each B id the highest count is kept, as many numbers as B has ids.

Defined cases: null and empty texts, and texts whose tokens' bytes differ from a space and the text under either tokenizer,
have no tokens and report zeros and ''; texts that can't be put in UTF-8 don't occur in a string column; repeated rows count,
and are reported, as often as they stand; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from brickfield.llm.common import materialize, new_path
from brickfield.llm.tokens import filesystem

#: Bytes of texts that are encoded, and tokens that are aligned, together; distinct pairs that a task holds before it passes them on.
TEXTS, TOKENS, HELD = 1 << 19, 1 << 17, 1 << 20

# How a byte-level tokenizer splits text into words, and the character codes that its vocabulary writes as themselves.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for; bytes without a plain character take those from 256 on, in order."""
    rest = [b for b in range(256) if b not in PLAIN]
    return {chr(b): b for b in PLAIN} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Tokenizer A: a byte-level BPE in a file of the tokenizers library, or `tokens`, the bytes of its ids, if they are the ranks of its merges.

    Where the vocabulary's ids follow the order of its merges, the ids are those that tiktoken gives with the ids as ranks,
    in a quarter of the time; both class every character alike. Any other file goes through the library.
    """

    def __init__(self, path: str, tokens: list[bytes] | None = None):
        self.library = self.fast = None
        if tokens:
            self.bytes = tokens
            self.rank()
        else:
            self.load(path)

    def rank(self) -> None:
        import tiktoken

        self.fast = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks={t: i for i, t in enumerate(self.bytes) if t}, special_tokens={})

    def load(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        spec = json.loads(self.library.to_str())
        chars = byte_of()
        special = {t["id"] for t in spec["added_tokens"]}
        vocabulary = {i: bytes(chars[c] for c in t) for t, i in self.library.get_vocab(False).items() if i not in special}
        self.bytes = [vocabulary.get(i, b"") for i in range(self.library.get_vocab_size())]
        merged = [a + b for a, b in (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])]
        first = 256
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if (
            spec["normalizer"] is None and {**plain, **(spec["pre_tokenizer"] or {})} == {**(spec["pre_tokenizer"] or {}), **plain}
            and spec["model"].get("type") == "BPE" and not any(spec["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            and all(len(self.bytes[i]) == 1 for i in range(first)) and [self.bytes[first + i] for i in range(len(merged))] == [bytes(chars[c] for c in m) for m in merged]
        ):
            self.library = None
            self.rank()

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast:
            return [self.fast.encode_ordinary(t) for t in texts]
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """Tokenizer B: a sentencepiece model with byte fallback, which puts a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        piece = self.model.id_to_piece
        self.bytes = [bytes([int(piece(i)[3:-1], 16)]) if self.model.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.model.get_piece_size())]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Sizes:
    """What alignment needs of the two tokenizers: the bytes of each id, the type that ids are kept in, and A's tokens if they are ranks."""

    def __init__(self, a_path: str, b_path: str):
        level = ByteLevel(a_path)
        self.tokens = level.bytes if level.fast else None
        self.a, self.b = (np.array([len(x) for x in t.bytes], dtype=np.int64) for t in (level, Pieces(b_path)))
        self.kinds = tuple(np.dtype("<u2" if len(x) <= 1 << 16 else "<u4") for x in (self.a, self.b))


def encoded(docs: DataFrame, a_path: str, b_path: str, sizes: Sizes) -> DataFrame:
    """doc_id and the ids under A and B of every row, as little-endian integers; none where the bytes differ."""

    known = docs.sparkSession.sparkContext.broadcast(sizes)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, kinds = ByteLevel(a_path, known.value.tokens), Pieces(b_path), known.value.kinds
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).fill_null(0).to_numpy().astype(np.int64)
            for i, j in zip(*runs_of((np.cumsum(sizes) - sizes) // TEXTS)):
                rows = batch.slice(i, j - i)
                texts = rows.column("text").to_pylist()
                there = [k for k, t in enumerate(texts) if t]
                spaced = [" " + texts[k] for k in there]
                ids = [[b"", b""] for _ in texts]
                for k, s, x, y in zip(there, spaced, a.encode(spaced), b.encode([texts[k] for k in there])):
                    whole = s.encode()
                    if b"".join(map(a.bytes.__getitem__, x)) == whole and b"".join(map(b.bytes.__getitem__, y)) == whole:
                        ids[k] = [np.array(x, dtype=kinds[0]).tobytes(), np.array(y, dtype=kinds[1]).tobytes()]
                yield pa.record_batch({"doc_id": rows.column("doc_id"), "a": pa.array([x for x, _ in ids], pa.binary()), "b": pa.array([y for _, y in ids], pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(kernel, "doc_id long, a binary, b binary")


def runs_of(x: np.ndarray) -> tuple[list[int], list[int]]:
    """Begins and ends of the runs of equal numbers."""
    if not len(x):
        return [], []
    cuts = (np.flatnonzero(np.diff(x)) + 1).tolist()
    return [0, *cuts], [*cuts, len(x)]


class Aligned:
    """Documents laid end to end, aligned: each link's key and document, and where groups end."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray):
        self.a, self.b, self.n_a, self.n_b = a, b, n_a, n_b
        self.a_end, self.b_end = np.cumsum(a_size[a]), np.cumsum(b_size[b])
        both = np.sort(np.concatenate([self.a_end, self.b_end]), kind="stable")  # two sorted runs, merged
        last = np.ones(len(both), dtype=bool)
        last[:-1] = both[1:] != both[:-1]
        ends = both[last]
        twice = np.zeros(len(both), dtype=bool)
        twice[1:] = ~last[:-1]
        self.group_end = both[twice]
        in_a = np.searchsorted(self.a_end, ends)
        in_b = np.searchsorted(self.b_end, ends)
        self.keys = b[in_b].astype(np.int64) << 32 | a[in_a].astype(np.int64)
        doc_end = np.concatenate([[0], self.a_end])[np.cumsum(n_a)]
        self.links_to = np.searchsorted(ends, doc_end, side="right")
        self.groups_to = np.searchsorted(self.group_end, doc_end, side="right")

    def written(self, said: list[str], n: int, m: int) -> list[str]:
        """Each document's groups as a1,a2|b1;a3|b2; said: A's n ids with a comma and with a bar, then B's m with a comma and with a semicolon."""
        a_group, b_group = np.searchsorted(self.group_end, self.a_end), np.searchsorted(self.group_end, self.b_end)
        b_before = np.concatenate([[0], np.searchsorted(self.b_end, self.group_end, side="right")])
        a_upto = np.searchsorted(self.a_end, self.group_end, side="right")
        order = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        order[np.arange(len(self.a)) + b_before[a_group]] = self.a + n * (self.group_end[a_group] == self.a_end)
        order[np.arange(len(self.b)) + a_upto[b_group]] = self.b + 2 * n + m * (self.group_end[b_group] == self.b_end)
        words = list(map(said.__getitem__, order.tolist()))
        upto = np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(words[i:j])[:-1] for i, j in zip([0, *upto], upto)]


def aligned(batches: Iterator[pa.RecordBatch], sizes: Sizes) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
    """Rows of encoded(), about TOKENS tokens together, and their alignment."""
    for batch in batches:
        sides = []
        for name, kind in zip("ab", sizes.kinds):
            column = batch.column(name).cast(pa.large_binary())
            starts = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset :][: len(column) + 1] // kind.itemsize
            sides.append((np.frombuffer(column.buffers()[2], dtype=kind) if column.buffers()[2] else np.zeros(0, dtype=kind), starts))
        (a, at_a), (b, at_b) = sides
        for i, j in zip(*runs_of((at_a[:-1] - at_a[0]) // TOKENS)):
            yield batch.slice(i, j - i), Aligned(a[at_a[i] : at_a[j]].astype(np.int64), b[at_b[i] : at_b[j]].astype(np.int64), np.diff(at_a[i : j + 1]), np.diff(at_b[i : j + 1]), sizes.a, sizes.b)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts; keys may stand in any order."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.ones(len(keys), dtype=bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def partial_counts(rows: DataFrame, sizes: Sizes) -> DataFrame:
    """key and n: how often a task's documents link a pair; a key comes a few times from each task."""

    known = rows.sparkSession.sparkContext.broadcast(sizes)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        batch = lambda: pa.record_batch(dict(zip(("key", "n"), map(pa.array, summed(*(np.concatenate(x) for x in zip(*held)))))))
        for _, x in aligned(batches, known.value):
            held.append(np.unique(x.keys, return_counts=True))
            n += len(held[-1][0])
            if n > 2 * HELD:
                held = [summed(*(np.concatenate(c) for c in zip(*held)))]
                n = len(held[0][0])
                if n > HELD:
                    yield batch()
                    held, n = [], 0
        if held:
            yield batch()

    return rows.mapInArrow(kernel, "key long, n long")


SHARD = "path string, first long, last long, rows long, b long, most long"


def count_shards(partial: DataFrame, folder: str) -> DataFrame:
    """Writes the pairs' counts in shards of sorted keys; a row for each shard and, with b and most, for each B id's highest count in it.

    Files are written under a name of their attempt and then renamed, so a task that runs again leaves whole ones.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, local = filesystem(folder)
        path = f"{local}/pairs-{TaskContext.get().partitionId():06d}"
        own, rows, first, last = f"{path}.{uuid.uuid4().hex}", 0, None, None
        left, out = (np.zeros(0, dtype=np.int64),) * 2, []
        most: tuple[np.ndarray, np.ndarray] = (np.zeros(0, dtype=np.int64),) * 2

        def write(keys: np.ndarray, counts: np.ndarray) -> None:
            nonlocal rows, first, last, most
            if not len(keys):
                return
            if not out:
                fs.create_dir(local, recursive=True)
                out.extend(fs.open_output_stream(f"{own}.{x}") for x in ("keys", "counts"))
                first = int(keys[0])
            for stream, x in zip(out, (keys, counts)):
                stream.write(x.astype("<i8").tobytes())
            rows, last = rows + len(keys), int(keys[-1])
            ids = np.concatenate([most[0], keys >> 32])  # both in order
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            most = ids[starts], np.maximum.reduceat(np.concatenate([most[1], counts]), starts)

        for b in batches:
            keys, counts = (np.concatenate([x, b.column(c).to_numpy()]) for x, c in zip(left, ("key", "n")))
            if not len(keys):
                continue
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, counts = keys[starts], np.add.reduceat(counts, starts)
            write(keys[:-1], counts[:-1])  # the last key may go on
            left = keys[-1:], counts[-1:]
        write(*left)
        if rows:
            for stream, x in zip(out, ("keys", "counts")):
                stream.close()
                fs.move(f"{own}.{x}", f"{path}.{x}")
            none = [None] * len(most[0])
            yield pa.record_batch([pa.array(x, t) for x, t in zip(([f"{folder}/pairs-{TaskContext.get().partitionId():06d}", *none], [first, *none], [last, *none], [rows, *none], [None, *most[0].tolist()], [None, *most[1].tolist()]), (pa.string(), *[pa.int64()] * 5))], names=[c.split(" ")[0] for c in SHARD.split(", ")])

    return partial.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(kernel, SHARD)


class PairCounts:
    """The shards of pairs, searched where they lie: mapped if their folder is local, else in an unnamed local copy of those in use."""

    def __init__(self, shards: list[tuple[str, int, int, int]]):
        self.shards = sorted(shards, key=lambda s: s[1])
        self.first = np.array([s[1] for s in self.shards], dtype=np.int64)
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def mapped(path: str, rows: int) -> np.ndarray:
        fs, local = filesystem(path)
        if isinstance(fs, pa.fs.LocalFileSystem):
            return np.memmap(local, dtype="<i8", mode="r", shape=(rows,))
        with tempfile.TemporaryFile() as copy, fs.open_input_stream(local) as source:  # has no name, and goes with the last map of it
            while block := source.read(1 << 22):
                copy.write(block)
            copy.flush()
            return np.memmap(copy, dtype="<i8", mode="r", shape=(rows,))

    def shard(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.open:
            path, _, _, rows = self.shards[i]
            self.open[i] = self.mapped(f"{path}.keys", rows), self.mapped(f"{path}.counts", rows)
        return self.open[i]

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The counts of keys, sorted, all of which are there."""
        counts = np.empty(len(keys), dtype=np.int64)
        for i, j in zip(*runs_of(shard := np.searchsorted(self.first, keys, side="right") - 1)):
            k, n = self.shard(int(shard[i]))
            counts[i:j] = n[np.searchsorted(k, keys[i:j])]
        return counts


def digest(rows: DataFrame, shards: DataFrame, sizes: Sizes) -> DataFrame:
    """The report of each row of encoded(), with the counts in shards, a table written by count_shards()."""
    where = [tuple(r) for r in shards.where("path IS NOT NULL").select("path", "first", "last", "rows").collect()]  # one row a task
    most = [tuple(r) for r in shards.where("b IS NOT NULL").groupBy("b").agg(F.max("most")).collect()]  # as many as B has ids

    known = rows.sparkSession.sparkContext.broadcast((sizes, where, most))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, where, most = known.value
        n, m = len(sizes.a), len(sizes.b)
        said = [f"{i}{end}" for size, ends in ((n, ",|"), (m, ",;")) for end in ends for i in range(size)]
        pairs, highest = PairCounts(where), np.zeros(m, dtype=np.int64)
        for i, x in most:
            highest[i] = x
        for part, x in aligned(batches, sizes):
            keys, at = np.unique(x.keys, return_inverse=True)
            counts = pairs.of(keys)
            best = counts == highest[keys >> 32]
            sums = lambda each, upto: np.diff(np.concatenate([[0], np.cumsum(each)])[upto], prepend=0)
            texts = x.written(said, n, m)
            yield pa.record_batch({
                "doc_id": part.column("doc_id"), "n_a": pa.array(x.n_a), "n_b": pa.array(x.n_b), "n_groups": pa.array(np.diff(x.groups_to, prepend=0)),
                "n_links": pa.array(np.diff(x.links_to, prepend=0)), "n_best": pa.array(sums(best[at].astype(np.int64), x.links_to)), "count_sum": pa.array(sums(counts[at], x.links_to)),
                "groups_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]),
            })

    return rows.mapInArrow(kernel, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def count_pairs(spark: SparkSession, rows: DataFrame, sizes: Sizes) -> DataFrame:
    """The table of shards with the counts of all pairs in rows of encoded()."""
    partial = materialize(partial_counts(rows, sizes), "align-partial")
    return materialize(count_shards(partial, new_path(spark, "align-pairs")), "align-shards")


def pair_table(shards: DataFrame) -> DataFrame:
    """a, b and n of every pair of ids, read from the shards."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, rows in zip(b.column("path").to_pylist(), b.column("rows").to_pylist()):
                keys, counts = PairCounts.mapped(f"{path}.keys", rows), PairCounts.mapped(f"{path}.counts", rows)
                for i in range(0, rows, HELD):
                    part = np.asarray(keys[i : i + HELD])
                    yield pa.record_batch({"a": pa.array(part & 0xFFFFFFFF), "b": pa.array(part >> 32), "n": pa.array(np.asarray(counts[i : i + HELD]))})

    return shards.where("path IS NOT NULL").select("path", "rows").mapInArrow(kernel, "a long, b long, n long")


def align(spark: SparkSession, docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, DataFrame]:
    """The report of each row of docs (doc_id, text), and the table of shards, from which pair_table() reads the counts."""
    sizes = Sizes(a_path, b_path)
    rows = materialize(encoded(docs, a_path, b_path, sizes), "align-ids")
    shards = count_pairs(spark, rows, sizes)
    return digest(rows, shards, sizes), shards
