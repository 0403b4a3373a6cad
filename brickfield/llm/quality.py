"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Each document is described by statistics of its text alone. Standardized, they are mapped to cosines that approximate a
Gaussian kernel. Each task sums the normal equations of its labelled rows, Spark adds the tasks' sums, and the driver
solves a system of fixed size. The calibration is fitted on labelled rows apart from those of the regression, from sums
over BINS bins of the raw score, pooled until they don't fall.

Labels come from rows of which crc32(doc_id) mod FOLDS is not 0; of them, those of remainder 1 calibrate. Of more than
MOST_LABELS such rows a sample of about that many teaches, taken by a hash of doc_id; so their ids fit a broadcast, and a
filter computes statistics for them alone before it reads all texts to score them.

Defined cases: a null text counts as empty; rows whose label is null teach nothing; a document that repeats under several
labels teaches each; without labels of both kinds every score is the mean label, or 1 without any; null ids are scored
and not held out; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brickfield.llm.common import materialize

FOLDS, BINS = 5, 256
#: Number of cosines, width of the kernel in standard deviations, ridge penalty per row, and seed of the features.
FEATURES, WIDTH, PENALTY, SEED = 256, 4.0, 1e-4, 11
#: Scores from which a document counts as good.
THRESHOLD = 0.3
#: Labels that the model learns from at most.
MOST_LABELS = 1_000_000

#: Bytes by kind.
KINDS = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": bytes(range(48, 58)), "space": b" \t\n\r\v\f", "stop": b".,;:?",
    "mark": b"!#$%&*|<>{}[]\\^_~=+@/", "wide": bytes(range(128, 256)),
}
#: By kind and byte value: 1 where the byte is of the kind.
IS = np.array([np.isin(np.arange(256), list(v)) for v in KINDS.values()]).astype(float)
LOWER, SPACE = (IS[list(KINDS).index(k)] > 0 for k in ("lower", "space"))
#: Bytes that end a marked word.
MARKED = np.isin(np.arange(256), list(b"!#$%&*|"))
STATISTICS = (
    "log_bytes", "upper", "lower", "digit", "space", "stop", "mark", "wide", "log_words", "word_length", "long_words", "distinct",
    "top_word", "repeat_next", "short_words", "capital_words", "marked_words", "bare_words", "log_lines", "line_length", "distinct_lines", "bar_words", "low_window",
)
#: Words of a window of which the lowest share of plain words counts.
WINDOW = 50


def statistics(text: bytes) -> list[float]:
    """STATISTICS of a UTF-8 text."""
    data = np.frombuffer(text, dtype=np.uint8)
    size = max(len(text), 1)
    share = IS @ np.bincount(data, minlength=256) / size
    edges = np.flatnonzero(np.diff(np.concatenate([[False], ~SPACE[data], [False]])))
    starts, ends = edges[::2], edges[1::2]
    lengths, words = ends - starts, text.split()
    n = max(len(words), 1)
    counts = Counter(words)
    first, last = data[starts], data[ends - 1]
    marked = MARKED[last]
    # Equal neighbours and words in capitals are told apart from most others by length and a byte or two.
    again = np.zeros(max(len(words) - 1, 0), dtype=bool)
    for i in np.flatnonzero((lengths[1:] == lengths[:-1]) & (first[1:] == first[:-1]) & (last[1:] == last[:-1])).tolist():
        again[i] = words[i] == words[i + 1]
    loud = np.zeros(len(words), dtype=bool)
    for i in np.flatnonzero((lengths > 2) & ~LOWER[first] & ~LOWER[last]).tolist():
        loud[i] = words[i].isupper()
    runs = 0
    if marked.any() or again.any() or loud.any():
        odd = marked | loud
        odd[1:] |= again
        runs = int(np.add.reduceat(odd, np.arange(0, len(words), WINDOW), dtype=np.int64).max())
    lines = text.split(b"\n")
    bars = sum(x.count(b" | ") > 2 for x in lines) if b" | " in text else 0
    return [
        log1p(len(text)), *share.tolist(), log1p(len(words)), int(lengths.sum()) / n, np.count_nonzero(lengths > 12) / n, len(counts) / n, max(counts.values(), default=0) / n,
        np.count_nonzero(again) / n, np.count_nonzero(lengths < 4) / n, np.count_nonzero(loud) / n, np.count_nonzero(marked) / n, counts.get(b"|", 0) / n, log1p(len(lines)), log1p(size / len(lines)),
        len(set(lines)) / len(lines), bars / len(lines), runs / WINDOW,
    ]


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the text), fold and x, the statistics of every row."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            fold = [None if i is None else zlib.crc32(str(i).encode()) % FOLDS for i in ids]
            x = [statistics(t or b"") for t in b.column("text").to_pylist()]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "row": b.column("row"), "fold": pa.array(fold, pa.int32()), "x": pa.array(x, pa.list_(pa.float64()))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(kernel, "doc_id long, row long, fold int, x array<double>")


class Model:
    """Standardization, random features, ridge weights and calibration; all of fixed size."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.directions = rng.normal(size=(len(mean), FEATURES)) / WIDTH
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.knots, self.levels = np.zeros(1), np.ones(1)

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.directions + self.phases), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.levels)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), len(STATISTICS))


def normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sums of z z' and z y over rows (x, y): each task's sums are added by Spark, entry by entry."""
    n = FEATURES + 1

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n + 1))
        for b in batches:
            z = model.features(matrix(b.column("x")))
            total += z.T @ np.hstack([z, b.column("y").to_numpy()[:, None]])
        for i in range(n):
            yield pa.record_batch({"i": pa.array(np.full(n + 1, i)), "j": pa.array(np.arange(n + 1)), "v": pa.array(total[i])})

    sums = rows.select("x", F.col("y").cast("double").alias("y")).mapInArrow(kernel, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((n, n + 1))
    table = sums.toPandas()  # of fixed size
    out[table["i"], table["j"]] = table["v"]
    return out[:, :n], out[:, n]


def pool(weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Means of adjacent bins, pooled until they don't fall."""
    blocks: list[list[float]] = []
    for w, t in zip(weight, total):
        blocks.append([w, t, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w1, t1, c1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w1, blocks[-1][1] + t1, blocks[-1][2] + c1]
    return np.repeat([t / w for w, t, _ in blocks], [int(c) for *_, c in blocks])


def calibrate(rows: DataFrame, model: Model) -> None:
    """Fits the calibration on rows (x, y) from sums over bins of the raw score."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((BINS, 3))
        for b in batches:
            raw = model.raw(matrix(b.column("x")))
            at = np.clip(((raw + 0.5) * BINS / 2).astype(np.int64), 0, BINS - 1)
            for k, v in enumerate((np.ones(len(raw)), b.column("y").to_numpy(), raw)):
                sums[:, k] += np.bincount(at, v, BINS)
        at = np.flatnonzero(sums[:, 0])
        yield pa.record_batch({"at": pa.array(at), "n": pa.array(sums[at, 0]), "y": pa.array(sums[at, 1]), "raw": pa.array(sums[at, 2])})

    found = rows.select("x", F.col("y").cast("double").alias("y")).mapInArrow(kernel, "at long, n double, y double, raw double")
    bins = found.groupBy("at").agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.sum("raw").alias("raw")).orderBy("at").toPandas()  # at most BINS rows
    if len(bins):
        n = bins["n"].to_numpy()
        levels = pool(n, bins["y"].to_numpy())
        # A small slope keeps the order of raw scores within pooled bins.
        model.knots, slope = bins["raw"].to_numpy() / n, 1e-3
        model.knots = np.concatenate([[min(-0.5, model.knots[0] - 1)], model.knots, [max(1.5, model.knots[-1] + 1)]])
        levels = np.concatenate([levels[:1], levels, levels[-1:]])
        model.levels = np.clip((1 - slope) * levels + slope * (np.clip(model.knots, -0.5, 1.5) + 0.5) / 2, 0, 1)


def teaching(labels: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """doc_id and y of the labels to learn from: those of the folds that teach, about `most` of them if there are more."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    marks = marks.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0)
    n = marks.count()
    return marks if n <= most else marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(most / n * (1 << 40)))


def train(described: DataFrame, marks: DataFrame) -> Model:
    """The model of described rows and marks (doc_id, y) on them."""
    rows = materialize(described.join(marks, "doc_id").select("fold", "x", "y"), "quality-labelled")
    at = range(len(STATISTICS))
    moments = rows.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *[f(F.col("x")[i]).alias(f"{n}{i}") for i in at for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    none = moments["n"] == 0
    model = Model(np.array([0.0 if none else moments[f"m{i}"] for i in at]), np.array([1.0 if none else moments[f"s{i}"] for i in at]))
    if none or moments["y"] in (0.0, 1.0):
        model.levels = np.array([1.0 if none else moments["y"]])
        return model
    zz, zy = normal_equations(rows.where("fold <> 1"), model)
    model.weights = np.linalg.solve(zz + PENALTY * max(zz[-1, -1], 1.0) * np.eye(len(zz)), zy)
    calibrate(rows.where("fold = 1"), model)
    return model


def score_rows(described: DataFrame, model: Model) -> DataFrame:
    """doc_id, row, held_out, score and predicted."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({"doc_id": b.column("doc_id"), "row": b.column("row"), "fold": b.column("fold"), "score": pa.array(model.score(matrix(b.column("x"))))})

    scored = described.mapInArrow(kernel, "doc_id long, row long, fold int, score double")
    held_out = F.coalesce(F.col("fold") == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", "row", held_out, "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The scores of all documents by a model trained on their labels."""
    described = materialize(describe(docs), "quality-statistics")
    return score_rows(described, train(described, teaching(labels)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that score below THRESHOLD. Each task scores and drops its rows, so no text is shuffled."""
    marks = materialize(teaching(labels), "quality-marks")
    taught = docs.select("doc_id", "text").join(F.broadcast(marks.select(F.col("doc_id").alias("_id")).distinct()), F.col("doc_id").cast("long") == F.col("_id"), "left_semi")
    model = train(describe(taught), marks)
    at = docs.columns.index("text")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t or b"") for t in b.column(at).cast(pa.binary()).to_pylist()]).reshape(-1, len(STATISTICS))
            yield b.filter(pa.array(model.score(x) >= THRESHOLD))

    return docs.mapInArrow(kernel, docs.schema)
