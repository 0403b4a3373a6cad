"""Token ids in Arrow stream files of equal-length sequences.

Documents are dealt by ranges of doc_id, and each task writes one shard: its documents' ids, each with the end id after
it, packed without gaps into sequences of `length` ids. A shard is an Arrow stream whose batches hold two fixed-size-list
columns, `ids` and `mask` (false on the padding of the last sequence), beside a second stream with doc_id and n_tokens of
its documents. Batches lie in the file as they do in memory, so a mapped shard gives any sequence without copying. Files
are written under a name of their attempt and then renamed, so a task that runs again leaves one whole file.

Encoding looks up the pieces of a text between ASCII white space, which a tokenizer of the form SPLITS never joins (white
space is dropped and every rule is local), and encodes each piece once for its task; a piece that is a Latin word and ASCII
punctuation is looked up in two. Everything new goes through the tokenizers library. The tokenizer's file tells its form;
with any other the library encodes every text whole.

Defined cases: a null text counts as empty and has the end id alone; null ids come first; rows of equal doc_id are in the
order of their text's hash; repeated rows are written as often as they stand; an empty table writes no shard; extra
columns are not written.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Ids in a sequence, and sequences in a batch.
LENGTH, BATCH = 2048, 128
#: Bytes of pieces that a task remembers at most before it starts anew, and bytes that a piece takes besides its own.
REMEMBERED, ENTRY = 160 << 20, 200
#: Words encoded in one call.
TOGETHER = 64
#: Documents looked up at once.
DOCS = 1000
#: ASCII punctuation that a word may end in without being joined to it. The apostrophe, which may join both, is left out.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39)
#: A word of Latin letters in UTF-8, up to U+024F. U+0130 is left out: its lower case ends in a combining dot that joins the punctuation.
LATIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|[\xc5-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+").fullmatch

# The parts of a tokenizer's file by which its pieces between white space are encoded apart.
SPLITS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "end_of_word_suffix": "</w>", "continuing_subword_prefix": None, "unk_token": None, "dropout": None,
}


def splits(tokenizer) -> bool:
    """True if the tokenizer has the form SPLITS, and its added tokens hold no white space and take none along."""
    spec = json.loads(tokenizer.to_str())
    added = all(not any(c.isspace() for c in t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec["added_tokens"])
    return added and all({**spec["model"], **spec}.get(k) == v for k, v in SPLITS.items())


def filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(path)


class Numbers(dict):
    """Numbers of byte strings; one that is asked for and new takes the next number and waits."""

    def __init__(self, *known: bytes):
        super().__init__((x, i) for i, x in enumerate(known))
        self.waiting: list[bytes] = []
        self.bytes = 0

    def __missing__(self, x: bytes) -> int:
        self[x] = n = len(self)
        self.waiting.append(x)
        return n

    def taken(self) -> list[bytes]:
        new, self.waiting = self.waiting, []
        self.bytes += sum(map(len, new)) + ENTRY * len(new)
        return new


class Table:
    """Ids by number: those of number i are flat[start[i] : start[i + 1]]."""

    def __init__(self, *rows: list[int]):
        self.flat, self.start = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)
        self.add([np.array(r, dtype=np.uint32) for r in rows], [len(r) for r in rows])

    def add(self, ids: list[np.ndarray], counts: list[int] | np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, *ids])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(counts, dtype=np.int64)])


class Encoder:
    """Ids of texts, as the tokenizers library gives them without special tokens around them."""

    def __init__(self, vocabulary: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(vocabulary), end_id
        self.whole = not splits(self.tokenizer)
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.zeros(size, dtype=bool)  # ids that end a word, where the model marks them
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        # A piece is a word and a rest, each by its number, and either may be empty; piece 0 is the end id.
        self.pieces, self.parts = Numbers(b""), (array("i", [0]), array("i", [1]))
        self.words, self.rests = Numbers(b""), Numbers(b"", b"\0 end")
        self.word_ids, self.rest_ids = Table([]), Table([], [self.end_id])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype=np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self) -> None:
        """Splits new pieces, and encodes new words and rests."""
        of_word, of_rest = self.parts
        words, rests = self.words, self.rests
        for p in self.pieces.taken():
            w = p.rstrip(MARKS)
            if w.isalpha():  # of ASCII alone
                of_word.append(words[w.lower()])
                of_rest.append(rests[p[len(w) :]])
            elif LATIN(w):
                of_word.append(words[w])
                of_rest.append(rests[p[len(w) :]])
            else:
                of_word.append(0)
                of_rest.append(rests[p])
        # Many words at a time; ids that end a word tell them apart, and a batch that doesn't add up goes one by one.
        new, found, counts = words.taken(), [], []
        batches = [new[i : i + TOGETHER] for i in range(0, len(new), TOGETHER)]
        for batch, ids in zip(batches, self.encode([b" ".join(b).decode() for b in batches])):
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(batch) and cuts[-1] == len(ids):
                found.append(ids)
                counts += np.diff(cuts, prepend=0).tolist()
            else:
                found += (single := self.encode([w.decode() for w in batch]))
                counts += [len(x) for x in single]
        self.word_ids.add(found, counts)
        single = self.encode([r.decode() for r in rests.taken()])
        self.rest_ids.add(single, [len(x) for x in single])

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end id, and the number of each text's."""
        if self.whole:
            each = [np.append(x, np.uint32(self.end_id)) for x in self.encode([(t or b"").decode() for t in texts])]
            return np.concatenate([np.zeros(0, dtype=np.uint32), *each]).astype(self.kind), np.array([len(x) for x in each], dtype=np.int64)
        if self.pieces.bytes + self.words.bytes + self.rests.bytes > REMEMBERED:
            self.forget()
        pieces: list[bytes] = []
        last = np.zeros(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            pieces += (t or b"").split()
            last[i] = 2 * len(pieces) + 1
            pieces.append(b"")
        at = np.fromiter(map(self.pieces.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        self.learn()
        first, count = np.empty((len(at), 2), dtype=np.int64), np.empty((len(at), 2), dtype=np.int64)
        for k, (part, table, offset) in enumerate(zip(self.parts, (self.word_ids, self.rest_ids), (0, len(self.word_ids.flat)))):
            number = np.frombuffer(part, dtype=np.int32)[at]
            first[:, k], count[:, k] = offset + table.start[number], table.start[number + 1] - table.start[number]
        first, count = first.ravel(), count.ravel()
        upto = np.cumsum(count)
        flat = np.concatenate([self.word_ids.flat, self.rest_ids.flat])
        ids = flat[np.repeat(first - (upto - count), count) + np.arange(upto[-1] if len(upto) else 0)]
        return ids.astype(self.kind), np.diff(upto[last], prepend=0)


class ShardWriter:
    """One shard: full sequences go out in batches, what is left waits."""

    def __init__(self, path: str, kind: np.dtype, length: int, end_id: int):
        self.path, self.kind, self.length = path, kind, length
        self.fs, self.local = filesystem(path)
        self.own = f"{self.local}.{uuid.uuid4().hex}"
        value = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([("ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))], metadata={"end_id": str(end_id)})
        self.out = self.fs.open_output_stream(self.own)
        self.stream = pa.ipc.new_stream(self.out, self.schema)
        self.waiting, self.docs, self.counts, self.sequences = np.zeros(0, dtype=kind), [], [], 0

    def batch(self, ids: np.ndarray, real: int) -> None:
        lists = pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(ids)) < real), self.length)
        self.stream.write_batch(pa.record_batch([lists, mask], schema=self.schema))
        self.sequences += len(lists)

    def write(self, doc_ids: list, ids: np.ndarray, counts: np.ndarray) -> None:
        self.docs += doc_ids
        self.counts += counts.tolist()
        self.waiting = np.concatenate([self.waiting, ids])
        size = BATCH * self.length
        while len(self.waiting) >= size:
            self.batch(self.waiting[:size], size)
            self.waiting = self.waiting[size:]

    def close(self) -> dict:
        real = len(self.waiting)
        if real:
            self.batch(np.concatenate([self.waiting, np.zeros(-real % self.length, dtype=self.kind)]), real)
        self.stream.close()
        self.out.close()
        docs = pa.record_batch({"doc_id": pa.array(self.docs, pa.int64()), "n_tokens": pa.array(self.counts, pa.int64())})
        with self.fs.open_output_stream(f"{self.own}.docs") as out, pa.ipc.new_stream(out, docs.schema) as stream:
            stream.write_batch(docs)
        self.fs.move(f"{self.own}.docs", f"{self.local}.docs")
        self.fs.move(self.own, self.local)
        return {"path": self.path, "docs": len(self.docs), "tokens": sum(self.counts), "sequences": self.sequences}


class Shard:
    """A written shard; sequence(i) and mask(i) are views into the mapped file where it is local."""

    def __init__(self, path: str):
        self.fs, local = filesystem(path)
        mapped = isinstance(self.fs, pa.fs.LocalFileSystem)
        self.source = pa.memory_map(local) if mapped else self.fs.open_input_file(local)
        self.stream = pa.ipc.open_stream(self.source)
        with self.fs.open_input_stream(f"{local}.docs") as source:
            self.docs = pa.ipc.open_stream(source).read_all()
        self.length = self.stream.schema.field("ids").type.list_size
        self.read: list[pa.RecordBatch] = []

    def batches(self) -> Iterator[pa.RecordBatch]:
        """The batches in order, for one pass that keeps none."""
        return iter(self.stream)

    def find(self, column: str, i: int) -> pa.Array:
        while len(self.read) * BATCH <= i:
            self.read.append(self.stream.read_next_batch())
        return self.read[i // BATCH].column(column)[i % BATCH].values

    def sequence(self, i: int) -> np.ndarray:
        return self.find("ids", i).to_numpy(zero_copy_only=True)

    def mask(self, i: int) -> np.ndarray:
        return self.find("mask", i).to_numpy(zero_copy_only=False)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, *, end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """Writes docs (doc_id, text) under folder; the shards in order, with the ids before each."""
    spark = docs.sparkSession

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = writer = None
        shard = TaskContext.get().partitionId()
        for b in batches:
            for i in range(0, b.num_rows, DOCS):
                part = b.slice(i, DOCS)
                if writer is None:
                    encoder = Encoder(vocabulary, end_id)
                    fs, local = filesystem(folder)
                    fs.create_dir(local, recursive=True)
                    writer = ShardWriter(f"{folder}/tokens-{shard:06d}.arrow", encoder.kind, length, end_id)
                writer.write(part.column("doc_id").to_pylist(), *encoder(part.column("text").to_pylist()))
        if writer:
            yield pa.RecordBatch.from_pylist([{"shard": shard} | writer.close()])

    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    done = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(kernel, "shard long, path string, docs long, tokens long, sequences long")
    shards, at = [], 0
    for r in sorted(done.collect()):  # one row for each shard
        shards.append((*r, at))
        at += r["tokens"]
    return spark.createDataFrame(shards, "shard long, path string, docs long, tokens long, sequences long, start long")


def read_documents(shards: DataFrame) -> DataFrame:
    """A row per document, read from the shards: doc_id, start, n_tokens and the CRC-32 of its ids as little-endian unsigned 32-bit integers."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                shard = Shard(row["path"])
                counts = shard.docs.column("n_tokens").to_numpy()
                ends = np.cumsum(counts)
                sums, doc, at, crc = np.zeros(len(counts), dtype=np.int64), 0, 0, 0
                for batch in shard.batches():
                    mask = batch.column("mask").flatten()
                    ids = batch.column("ids").flatten().to_numpy()[: mask.true_count].astype("<u4")
                    taken = 0
                    while taken < len(ids):
                        upto = min(len(ids), taken + int(ends[doc]) - at)
                        crc = zlib.crc32(ids[taken:upto], crc)
                        at, taken = at + upto - taken, upto
                        if at == ends[doc]:
                            sums[doc], doc, crc = crc, doc + 1, 0
                yield pa.record_batch({
                    "doc_id": shard.docs.column("doc_id").combine_chunks(), "start": pa.array(ends - counts + row["start"]),
                    "n_tokens": pa.array(counts), "ids_crc32": pa.array(sums),
                })

    n = max(1, shards.count())
    return shards.repartition(n, "shard").mapInArrow(kernel, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(spark: SparkSession, docs: DataFrame, folder: str, vocabulary: str) -> DataFrame:
    return read_documents(write_tokens(docs, folder, vocabulary))
