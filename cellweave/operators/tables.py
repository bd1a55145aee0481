"""Feature tables: combining, coordinates, moving to another grid, spacings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import EARTH_RADIUS_M, haversine
from ..sources.grid import axes_of
from .detect import number

# Standard names of the columns of a feature table.
STANDARD_NAMES = {"hdim_1": "south_north", "hdim_2": "west_east", "num": "num_grid_cells", "time": "feature_time", "threshold_value": "threshold_max", "feature": "feature_id", "cell": "cell_id"}


def combine(tables: list[DataFrame], renumber: bool = True, old_column: str | None = None) -> DataFrame:
    """One feature table of several: frames are ranks of time anew, features numbered by frame and idx.

    Without renumbering a feature id that occurs twice is an error.
    """
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    times = out.select("time").distinct().withColumn("frame", (F.dense_rank().over(Window.orderBy("time")) - 1).cast("int"))
    out = out.drop("frame").join(times, "time")
    if not renumber:
        if out.groupBy("feature").count().where("count > 1").limit(1).count():
            raise ValueError("feature ids repeat; renumber them")
        return out
    if old_column:
        out = out.withColumnRenamed("feature", old_column)
    old_idx = out.withColumnRenamed("idx", "__idx").drop("feature")
    return number(old_idx, ["__idx", *axes_of(out)]).drop("idx").withColumnRenamed("__idx", "idx")


def standard_names(features: DataFrame, mask: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features under standard names, and the mask keyed by the same id."""
    return features.withColumnsRenamed({k: v for k, v in STANDARD_NAMES.items() if k in features.columns}), mask.withColumnRenamed("feature", "feature_id")


def add_axis_coordinate(features: DataFrame, coordinate: DataFrame, axis: str, name: str) -> DataFrame:
    """``name`` at each feature's fractional index: linear between (idx, value) rows; text takes the nearest.

    Beyond the ends the nearest two rows are carried on.
    """
    c = coordinate.withColumn("__next", F.lead("value").over(Window.orderBy("idx"))).withColumn("__last", F.max("idx").over(Window.partitionBy(F.lit(0))))
    text = dict(coordinate.dtypes)["value"] == "string"
    at = F.col(axis)
    last = coordinate.agg(F.max("idx")).first()[0]
    low = F.floor(at + 0.5) if text else F.least(F.greatest(F.floor(at), F.lit(0)), F.lit(max(last - 1, 0)))
    value = F.col("value") if text else F.col("value") + F.coalesce((F.col("__next") - F.col("value")) * (at - F.col("__idx")), F.lit(0.0))
    keyed = features.withColumn("__idx", low.cast("int"))
    return keyed.join(c.select(F.col("idx").alias("__idx"), "value", "__next"), "__idx", "left").withColumn(name, value).drop("__idx", "value", "__next")


def add_grid_coordinate(features: DataFrame, grid: DataFrame, name: str, shape: dict[str, int]) -> DataFrame:
    """``name`` bilinearly (trilinearly with vdim) between the corners around each feature; grid has the axes and ``value``."""
    axes = [a for a in shape if a in grid.columns]
    rows = features.withColumn("__row", F.col("feature"))
    corners = rows.select("__row", *(F.col(a).alias(f"__{a}") for a in axes))
    weight: Column = F.lit(1.0)
    for a in axes:
        base = F.least(F.greatest(F.floor(F.col(f"__{a}")), F.lit(0)), F.lit(max(shape[a] - 2, 0)))
        corners = corners.withColumn(a, F.explode(F.array(base.cast("int"), *([base.cast("int") + 1] if shape[a] > 1 else []))))
        weight = weight * (1 - F.abs(F.col(a) - F.col(f"__{a}"))) if shape[a] > 1 else weight
    value = corners.join(grid.select(*axes, "value"), axes).groupBy("__row").agg(F.sum(weight * F.col("value")).alias(name))
    return rows.join(value, "__row", "left").drop("__row")


def spacings(y: DataFrame, x: DataFrame, time: DataFrame, method: str = "arithmetic") -> tuple[float, float]:
    """(dxy, dt seconds) from the first two rows (idx, value) of each coordinate; whole days count."""
    first = lambda t: [r["value"] for r in t.where("idx < 2").orderBy("idx").collect()]
    (y0, y1), (x0, x1), (t0, t1) = first(y), first(x), first(time)
    dy, dx = abs(y1 - y0), abs(x1 - x0)
    if method not in ("arithmetic", "geometric"):
        raise ValueError("method is arithmetic or geometric")
    dxy = (dy + dx) / 2 if method == "arithmetic" else math.sqrt(dy * dx)
    return dxy, (t1 - t0).total_seconds()


def transform_points(features: DataFrame, grid: DataFrame, max_space: float, levels: DataFrame | None = None, max_vertical: float | None = None, times: DataFrame | None = None, max_time: float | None = None) -> DataFrame:
    """Features moved to the nearest point (hdim_1, hdim_2, latitude, longitude) of another grid, level and time.

    A feature farther than ``max_space`` metres goes; with ``max_vertical`` one is kept that passes either
    limit. Points meet through latitude bands and longitude cells as wide as the limit.
    """
    band = math.degrees(max_space / EARTH_RADIUS_M) * 1.0001
    rows = features.withColumnsRenamed({a: f"old_{a}" for a in axes_of(features)})
    lat_bin = lambda c: F.floor(F.col(c) / band)
    # a band's longitude cells are as wide as the limit reaches where its neighbours are nearest a pole
    top = F.radians(F.greatest(F.abs((F.col("__b") - 1) * band), F.abs((F.col("__b") + 2) * band)))
    count = F.when(top + math.radians(2 * band) >= math.pi / 2, 1).otherwise(F.greatest(F.lit(1), F.floor(360 * F.cos(top) / (1.6 * band))))
    cell = lambda c: F.floor(F.pmod(F.col(c), F.lit(360.0)) * F.col("__n") / 360)
    points = grid.select("hdim_1", "hdim_2", F.col("latitude").alias("__lat"), F.col("longitude").alias("__lon")).withColumn("__b", F.explode(F.array(*(lat_bin("__lat") + k for k in (-1, 0, 1))))).withColumn("__n", count)
    points = points.withColumn("__c", F.explode(F.array_distinct(F.array(*(F.pmod(cell("__lon") + k, F.col("__n")) for k in (-1, 0, 1)))))).drop("__n")
    pairs = rows.select("feature", "latitude", "longitude", lat_bin("latitude").alias("__b")).withColumn("__n", count).withColumn("__c", F.pmod(cell("longitude"), F.col("__n"))).join(points, ["__b", "__c"])
    d = haversine("latitude", "longitude", "__lat", "__lon", EARTH_RADIUS_M)
    near = pairs.withColumn("d", d).where(F.col("d") <= max_space)
    best = near.groupBy("feature").agg(F.min_by(F.struct("hdim_1", "hdim_2"), F.struct("d", "hdim_1", "hdim_2")).alias("p")).select("feature", F.col("p.hdim_1").cast("double").alias("hdim_1"), F.col("p.hdim_2").cast("double").alias("hdim_2"))
    out = rows.join(best, "feature", "left")
    close = F.col("hdim_1").isNotNull()
    if levels is not None:
        options = F.broadcast(levels.agg(F.sort_array(F.collect_list(F.struct("value", "vdim"))).alias("__levels")).withColumn("__k", F.lit(0)))
        out = out.withColumn("__k", F.lit(0)).join(options, "__k").drop("__k")
        gap = F.transform("__levels", lambda s: F.struct(F.abs(s["value"] - F.col("altitude")).alias("gap"), s["vdim"].alias("vdim")))
        out = out.withColumn("__best", F.array_min(gap)).withColumn("vdim", F.col("__best.vdim").cast("double"))
        if max_vertical is not None:
            close = close | (F.col("__best.gap") <= max_vertical)
    out = out.where(close).drop("__levels", "__best")
    if times is not None:
        from .stats import pair_frames

        options = pair_frames(out, times, max_time or 0.0)
        gap = F.abs(F.unix_micros(F.col("time").cast("timestamp")) - F.unix_micros(F.col("field_time").cast("timestamp")))
        nearest = options.groupBy("feature").agg(F.min_by(F.struct("field_frame", "field_time"), F.struct(gap, F.col("field_time"))).alias("t"))
        out = out.join(nearest, "feature").withColumn("frame", F.col("t.field_frame")).withColumn("time", F.col("t.field_time")).drop("t")
    return out
