"""Synthetic fields and feature tables, made from ranges and closed forms on the executors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalar import wrap
from .grid import frame_time


@dataclass(frozen=True)
class Blob:
    """A Gaussian bump: amplitude, and along each axis width, place, speed (metres, seconds); first and last frame."""

    amplitude: float
    sigma: tuple[float, ...]
    start: tuple[float, ...]
    speed: tuple[float, ...]
    first: int = 0
    last: int = 10**9
    acceleration: tuple[float, ...] | None = None


# The sample blobs. One 2-D blob and three on 1-minute frames; one 3-D blob and three on 2-minute frames.
ONE_2D = (Blob(10, (10e3, 10e3), (10e3, 10e3), (14, 30), 0, 59),)
THREE_2D = (
    Blob(10, (10e3, 10e3), (10e3, 10e3), (14, 30), 0, 59),
    Blob(20, (10e3, 10e3), (10e3, 20e3), (12, 0), 40, 69, (0, 0.048)),
    Blob(15, (10e3, 10e3), (110e3, 70e3), (20, 0), 50, 69, (0, 0.040)),
)
ONE_3D = (Blob(10, (5e3, 5e3, 5e3), (4e3, 10e3, 10e3), (16, 14, 30), 0, 29),)
THREE_3D = (
    Blob(10, (5e3, 10e3, 10e3), (4e3, 10e3, 10e3), (0, 14, 30), 0, 29),
    Blob(20, (5e3, 10e3, 10e3), (6e3, 10e3, 20e3), (0, 12, 0), 20, 34, (0, 0, 0.048)),
    Blob(15, (5e3, 10e3, 10e3), (8e3, 110e3, 70e3), (0, 20, 0), 25, 34, (0, 0, 0.040)),
)


def sample_2d_one(spark: SparkSession) -> DataFrame:
    return blobs(spark, 100, {"hdim_1": 50, "hdim_2": 100}, ONE_2D)


def sample_2d_three(spark: SparkSession, inverted: bool = False) -> DataFrame:
    """Three blobs; inverted, the axes change places."""
    out = blobs(spark, 100, {"hdim_1": 200, "hdim_2": 100}, THREE_2D)
    return out.withColumnsRenamed({"hdim_1": "hdim_2", "hdim_2": "hdim_1"}) if inverted else out


def sample_3d_one(spark: SparkSession, inverted: bool = False) -> DataFrame:
    out = blobs(spark, 25, {"vdim": 50, "hdim_1": 50, "hdim_2": 100}, ONE_3D, dt=120)
    return out.withColumnsRenamed({"hdim_1": "hdim_2", "hdim_2": "hdim_1"}) if inverted else out


def sample_3d_three(spark: SparkSession, inverted: bool = False) -> DataFrame:
    out = blobs(spark, 25, {"vdim": 20, "hdim_1": 200, "hdim_2": 100}, THREE_3D, dt=120)
    return out.withColumnsRenamed({"hdim_1": "hdim_2", "hdim_2": "hdim_1"}) if inverted else out


def blobs(spark: SparkSession, frames: int, shape: dict[str, int], what: tuple[Blob, ...], dt: float = 60, dxy: float = 1000) -> DataFrame:
    """A field of moving Gaussian blobs; ``shape`` names the axes in any order."""
    size = 1
    for n in shape.values():
        size *= n
    out = spark.range(frames * size).select(F.floor(F.col("id") / size).cast("int").alias("frame"), (F.col("id") % size).alias("pid"))
    rest = F.col("pid")
    for axis, n in reversed(shape.items()):
        out = out.withColumn(axis, F.pmod(rest, F.lit(n)).cast("int"))
        rest = F.floor(rest / n)
    axes, value = [a for a in ("vdim", "hdim_1", "hdim_2") if a in shape], F.lit(0.0)
    for b in what:
        t = (F.col("frame") - b.first) * dt
        exponent = F.lit(0.0)
        for k, axis in enumerate(axes):
            place = b.start[k] + b.speed[k] * t + (0.5 * b.acceleration[k] * t * t if b.acceleration else 0)
            exponent = exponent + F.pow(F.col(axis) * dxy - place, 2) / (2 * b.sigma[k] ** 2)
        bump = b.amplitude * F.exp(-exponent)
        value = value + F.when(F.col("frame").between(b.first, b.last), bump).otherwise(0.0)
    return out.select("frame", frame_time("frame", "2000-01-01 12:00:00", int(dt)).alias("time"), *axes, value.alias("value"))


def paint(field: DataFrame, center: dict[str, float], size: dict[str, float], amplitude: float, period: dict[str, int] | None = None) -> DataFrame:
    """Set a rectangle: from ceil(center - size / 2) up to, not including, ceil(center + size / 2), around periodic edges."""
    inside = F.lit(True)
    for axis, at in center.items():
        low, high = -(-(at - size[axis] / 2) // 1), -(-(at + size[axis] / 2) // 1)
        x = F.col(axis)
        inside = inside & (wrap(x - low, period[axis]) < high - low if period and axis in period else (x >= low) & (x < high))
    return field.withColumn("value", F.when(inside, F.lit(float(amplitude))).otherwise(F.col("value")))


def moving_feature(spark: SparkSession, start: dict[str, float], speed: dict[str, float], frames: int, period: dict[str, tuple[float, float]] | None = None, seconds: int = 300, feature: int = 1) -> DataFrame:
    """A feature of constant speed, one row a frame; on a periodic axis it comes back, elsewhere it ends at the edge given."""
    rows = spark.range(frames).select(F.col("id").cast("int").alias("frame"))
    for axis, at in start.items():
        place = F.lit(float(at)) + F.lit(float(speed.get(axis, 0))) * F.col("frame")
        if period and axis in period:
            low, high = period[axis]
            place = wrap(place, high - low, low)
        rows = rows.withColumn(axis, place.cast("double"))
    return rows.select("frame", F.lit(0).alias("idx"), *start, frame_time("frame", "2022-01-01", seconds).alias("time"), (F.col("frame") + feature).cast("long").alias("feature"))
