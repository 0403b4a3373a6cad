"""Endless requests: a stream of request rows served against static volumes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brickfield.operators.joins import points_in_boxes


def serve(requests: DataFrame, voxels: DataFrame, axes: Sequence[str], bucket: Sequence[int]) -> DataFrame:
    """The voxels of each streamed request's box, by a stream-static equi-join on buckets."""
    return points_in_boxes(voxels, requests, axes, bucket)


def in_turn(requests: DataFrame, n: int, client: str = "client") -> DataFrame:
    """request and place: each client's requests take places 0 .. n - 1 in turn, across micro-batches."""

    def take(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (at,) = state.get if state.exists else (0,)
        for f in frames:
            f = f.sort_values("request")
            yield pd.DataFrame({"client": key[0], "request": f["request"], "place": [(at + i) % n for i in range(len(f))]})
            at += len(f)
        state.update((at,))

    grouped = requests.groupBy(client)
    return grouped.applyInPandasWithState(take, "client long, request long, place long", "at long", "append", GroupStateTimeout.NoTimeout)


def snapshots(stream: DataFrame, every: int, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls write with every so many micro-batches, and runs until the stream has no more at hand."""

    def each(batch: DataFrame, number: int) -> None:
        if number % every == 0:
            write(batch, number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def events_per_window(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of events by type and window; events later than `late` are left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
