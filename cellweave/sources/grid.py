"""Fields from tables and arrays, and tables of results."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalar import AXES

EVENT_TYPES = 5


def axes_of(df: DataFrame) -> list[str]:
    """The grid axes that a table has, the vertical one first."""
    return [a for a in AXES if a in df.columns]


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """A cell table (frame, time, [vdim], hdim_1, hdim_2, value) from Parquet; filters and columns reach the scan."""
    return spark.read.parquet(path)


def write_cells(df: DataFrame, path: str, frames_each: int = 64, mode: str = "errorifexists") -> None:
    """Write cells, masks or features partitioned by runs of frames, so that a range of frames prunes files."""
    bucket = F.floor(F.col("frame") / frames_each).alias("frame_bucket")
    df.withColumn("frame_bucket", bucket).repartition("frame_bucket").write.mode(mode).partitionBy("frame_bucket").parquet(path)


def event_grid(spark: SparkSession, sf_dir: str, rows: int = 12, columns: int = 12, vertical: bool = False) -> DataFrame:
    """The events table laid on a complete grid: day by user residue by hours; cells without events are 0.

    With ``vertical`` the five event types, by name, are the levels.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "user_id", "event_type", "value")
    keys = [
        F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("frame"),
        (F.col("user_id") % rows).cast("int").alias("hdim_1"),
        F.floor(F.hour("ts") / (24 // columns)).cast("int").alias("hdim_2"),
    ]
    if vertical:
        names = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))
        keys.insert(1, (F.array_position(names, F.col("event_type")) - 1).cast("int").alias("vdim"))
    cells = events.groupBy(*keys).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"), F.count("*").alias("n_events"))
    shape = {"vdim": EVENT_TYPES} if vertical else {}
    return complete(cells, {**shape, "hdim_1": rows, "hdim_2": columns}, 30)


def complete(cells: DataFrame, shape: dict[str, int], frames: int) -> DataFrame:
    """Every cell of the grid, absent ones with 0 in each further column. The grid is made from ranges, not from a cross join."""
    size = int(np.prod(list(shape.values())))
    grid = cells.sparkSession.range(frames * size).select(F.floor(F.col("id") / size).cast("int").alias("frame"), (F.col("id") % size).alias("pid"))
    rest = F.col("pid")
    for axis, n in reversed(shape.items()):
        grid = grid.withColumn(axis, F.pmod(rest, F.lit(n)).cast("int"))
        rest = F.floor(rest / n)
    keys = ["frame", *shape]
    out = grid.select(*keys).join(cells, keys, "left")
    return out.select(*keys, frame_time("frame").alias("time"), *(F.coalesce(c, F.lit(0)).cast(t).alias(c) for c, t in cells.dtypes if c not in keys))


def frame_time(frame: str, start: str = "2024-01-01", seconds: int = 86400) -> Column:
    return (F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col(frame) * seconds)).cast("timestamp_ntz")


def from_array(spark: SparkSession, values: np.ndarray, start: str = "2022-01-01", seconds: int = 86400) -> DataFrame:
    """A field from an array of (time, [z], y, x), one row a frame first, unfolded on the executors."""
    if values.ndim not in (3, 4):
        raise ValueError("a field has three or four dimensions")
    axes = AXES[-(values.ndim - 1) :]
    frames = spark.createDataFrame([(k, frame.ravel().astype(float).tolist()) for k, frame in enumerate(values)], "frame int, slab array<double>")
    out = frames.select("frame", F.posexplode("slab").alias("pid", "value"))
    rest = F.col("pid")
    for axis, n in reversed(list(zip(axes, values.shape[1:], strict=True))):
        out = out.withColumn(axis, F.pmod(rest, F.lit(n)).cast("int"))
        rest = F.floor(rest / n)
    return out.select("frame", frame_time("frame", start, seconds).alias("time"), *axes, "value")


def slabs(cells: DataFrame, shape: dict[str, int], value: str = "value") -> DataFrame:
    """One row a frame: its values in raveled order."""
    from ..functions.scalar import ravel

    pairs = F.array_sort(F.collect_list(F.struct(ravel({a: a for a in shape}, shape).alias("pid"), F.col(value).alias("v"))))
    return cells.groupBy("frame").agg(F.transform(pairs, lambda p: p["v"]).alias("slab"))
