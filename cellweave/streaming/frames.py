"""Detection over a stream of cells.

Detection has no memory across frames, so a frame can be worked out once it is whole. A watermark on
the frames' time says when: cells are gathered by frame in the state store, and a frame that the
watermark has passed goes out as one slab row, which detection unfolds in each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import detect


def whole_frames(cells: DataFrame, axes: list[str], delay: str = "1 hour") -> DataFrame:
    """One row (frame, time, cells) for each frame that the watermark has passed; later cells are dropped."""
    timed = cells.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", delay)
    grouped = timed.groupBy(F.window("time", "1 second"), "frame").agg(F.collect_list(F.struct(*axes, "value")).alias("cells"))
    return grouped.select("frame", F.col("window.start").alias("time"), "cells")


def detect_stream(cells: DataFrame, shape: dict[str, int], thresholds: list[float], sink: Callable[[DataFrame, int], None], checkpoint: str, delay: str = "1 hour", **options) -> StreamingQuery:
    """Start detection over a stream; ``sink`` gets the features of each micro-batch and its number.

    Feature ids count from 1 in each batch; frame and idx name a feature across batches.
    """
    def work(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        field = held.select("frame", F.col("time").cast("timestamp_ntz").alias("time"), F.inline("cells"))
        sink(detect(field, shape, thresholds, **options), number)
        held.unpersist()

    return whole_frames(cells, list(shape), delay).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(work).trigger(availableNow=True).start()
