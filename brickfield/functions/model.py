"""Training and prediction on blocks. Any model with these two methods plugs in; the linear one is the reference."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, functions as F


class Model(Protocol):
    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]: ...

    def predict(self, x: np.ndarray) -> np.ndarray: ...


class Linear:
    """y from x by one weight a cell and a constant."""

    def __init__(self, cells: int):
        self.weights = np.zeros(cells + 1)

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.ones((len(x), 1))])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.inputs(x) @ self.weights

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
        miss = self.predict(x) - y
        return self.inputs(x).T @ miss, float(miss @ miss)


def checkpoints(path: str) -> list[tuple[int, str]]:
    """The steps saved under a folder, with their files, in order."""
    fs, local = pa.fs.FileSystem.from_uri(path)
    found = fs.get_file_info(pa.fs.FileSelector(local, allow_not_found=True))
    return sorted((int(i.base_name.split("-")[1]), i.path) for i in found if re.fullmatch("step-[0-9]+", i.base_name))


def save(model: Linear, path: str, step: int) -> None:
    fs, local = pa.fs.FileSystem.from_uri(path)
    fs.create_dir(local, recursive=True)
    with fs.open_output_stream(f"{local}/saving") as out:
        out.write(model.weights.astype("<f8").tobytes())
    fs.move(f"{local}/saving", f"{local}/step-{step}")


def resume(model: Linear, path: str) -> int:
    """Gives model the weights saved last, if there are any; the number of steps that led to them."""
    found = checkpoints(path)
    if not found:
        return 0
    fs, _ = pa.fs.FileSystem.from_uri(path)
    with fs.open_input_stream(found[-1][1]) as source:
        model.weights = np.frombuffer(source.read(), dtype="<f8").astype(float)
    return found[-1][0]


def train(blocks: DataFrame, model: Linear, steps: int, rate: float, folder: str | None = None, every: int = 10) -> list[float]:
    """Full-batch steps; tasks sum their gradients, of the model's size, and the driver adds those. The mean loss of each step.

    With a folder (an absolute path or URI), weights are saved in it after every so many steps and the last, and training
    goes on from those saved last, up to `steps` in all.
    """
    losses = []
    width = len(model.weights) - 1
    done = resume(model, folder) if folder else 0

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, n = np.zeros(width + 1), 0.0, 0
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(-1, width)
            g, miss = model.gradient(x, b.column(1).to_numpy())
            total, loss, n = total + g, loss + miss, n + len(x)
        yield pa.record_batch({"i": pa.array(np.arange(width + 3)), "v": pa.array(np.concatenate([total, [loss, n]]))})

    for step in range(done + 1, steps + 1):
        sums = blocks.select("x", "y").mapInArrow(kernel, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
        v = np.array([r["v"] for r in sums])
        n = max(v[-1], 1.0)
        losses.append(v[-2] / n)
        model.weights = model.weights - rate * v[:-2] / n
        if folder and (step % every == 0 or step == steps):
            save(model, folder, step)
    return losses


def predict(blocks: DataFrame, model: Model, width: int, skip_empty: bool = False) -> DataFrame:
    """batch_id and prediction; with skip_empty, blocks of zeros alone get 0 and never reach the model."""
    empty = ~F.exists("x", lambda v: v != 0)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, width)
            yield pa.record_batch({"batch_id": b.column(0), "prediction": pa.array(np.asarray(model.predict(x), dtype=float))})

    rows = blocks.select(F.col("batch_id").cast("long").alias("batch_id"), "x")
    todo = rows.where(~empty) if skip_empty else rows
    out = todo.mapInArrow(kernel, "batch_id long, prediction double")
    return out.unionByName(rows.where(empty).select("batch_id", F.lit(0.0).alias("prediction"))) if skip_empty else out
