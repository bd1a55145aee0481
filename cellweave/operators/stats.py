"""Statistics of fields over features, and areas."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import EARTH_RADIUS_M, haversine
from ..sources.grid import axes_of

NAMED: dict[str, Callable[[str], Column]] = {
    "count": lambda v: F.count(v),
    "sum": lambda v: F.sum(v),
    "mean": lambda v: F.avg(v),
    "min": lambda v: F.min(v),
    "max": lambda v: F.max(v),
    "std": lambda v: F.stddev_pop(v),
    "var": lambda v: F.var_pop(v),
    "median": lambda v: F.percentile(v, 0.5),
}


def statistics(features: DataFrame, mask: DataFrame, field: DataFrame, statistic: dict[str, str | Column | tuple[Callable, dict] | Callable], default: float | None = None, collapse: list[str] | None = None, time_padding: float | None = None) -> DataFrame:
    """Features with one column a statistic of the field cells under each.

    A statistic is a name (``mean``, ..., ``percentile:95``), an aggregate column over the field's columns
    (so several fields joined as columns are possible), or a Python callable over the array of values,
    alone or with keyword arguments. Absent features get ``default``. ``collapse`` drops these axes: a
    feature's distinct footprint counts on the others. A field without ``frame`` holds for all frames; with
    ``time_padding`` (seconds) frames match by the nearest time within it.
    """
    keys = [a for a in ["frame", *axes_of(mask)] if a not in (collapse or [])]
    footprint = mask.where("feature > 0").select("feature", *keys).distinct()
    if "frame" not in field.columns:
        on = [k for k in keys if k != "frame" and k in field.columns]
    else:
        on = [k for k in keys if k in field.columns]
        if time_padding is not None:
            field = _on_frames_of(features, field, time_padding)
    joined = footprint.join(field.drop("time", "feature"), on)
    columns, custom = [], {}
    for name, what in statistic.items():
        if isinstance(what, str):
            kind, _, q = what.partition(":")
            columns.append((F.percentile("value", float(q) / 100) if kind == "percentile" else NAMED[kind]("value")).alias(name))
        elif isinstance(what, Column):
            columns.append(what.alias(name))
        else:
            custom[name] = what if isinstance(what, tuple) else (what, {})
    out = features
    if columns:
        out = out.join(joined.groupBy("feature").agg(*columns), "feature", "left")
    if custom:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            values = pdf["value"].to_numpy()
            return pd.DataFrame({"feature": [pdf["feature"].iloc[0]], **{n: [float(f(values, **k))] for n, (f, k) in custom.items()}})

        schema = "feature long, " + ", ".join(f"`{n}` double" for n in custom)
        out = out.join(joined.select("feature", "value").groupBy("feature").applyInPandas(run, schema), "feature", "left")
    if default is not None:
        out = out.fillna(default, subset=list(statistic))
    return out


def _on_frames_of(features: DataFrame, field: DataFrame, padding: float) -> DataFrame:
    """The field renumbered to the features' frames: for each the nearest time, the earlier of two, within the padding."""
    seconds = lambda x: F.unix_micros(F.col(x).cast("timestamp")) / F.lit(1e6)
    mine = features.select("frame", seconds("time").alias("t")).distinct()
    wide = max(padding, 1e-6)
    theirs = field.select(F.col("frame").alias("source"), seconds("time").alias("s")).distinct()
    theirs = theirs.withColumn("bucket", F.explode(F.array(*(F.floor(F.col("s") / wide) + k for k in (-1, 0, 1)))))
    pairs = mine.withColumn("bucket", F.floor(F.col("t") / wide)).join(theirs, "bucket").where(F.abs(F.col("t") - F.col("s")) <= padding)
    nearest = pairs.groupBy("frame").agg(F.min_by("source", F.struct(F.abs(F.col("t") - F.col("s")), F.col("s"))).alias("source"))
    return field.withColumnRenamed("frame", "source").join(nearest, "source").drop("source")


def pair_frames(features: DataFrame, field_times: DataFrame, padding: float = 0.0) -> DataFrame:
    """Features beside every frame of a field whose time is within ``padding`` seconds, both ends included."""
    seconds = lambda x: F.unix_micros(F.col(x).cast("timestamp")) / F.lit(1e6)
    wide = max(padding, 1.0)
    theirs = field_times.select(F.col("frame").alias("field_frame"), F.col("time").alias("field_time")).distinct()
    theirs = theirs.withColumn("bucket", F.explode(F.array(*(F.floor(seconds("field_time") / wide) + k for k in (-1, 0, 1)))))
    joined = features.withColumn("bucket", F.floor(seconds("time") / wide)).join(theirs, "bucket")
    return joined.where(F.abs(seconds("time") - seconds("field_time")) <= padding).drop("bucket")


def widths(coordinate: DataFrame, index: str, value: str) -> DataFrame:
    """(index, width) of a 1-D coordinate, its bounds halfway between neighbours."""
    order = Window.orderBy(index)
    before, after = F.lag(value).over(order), F.lead(value).over(order)
    v = F.col(value)
    return coordinate.select(index, F.abs(F.when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2)).alias("width"))


def cell_areas_xy(rows: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Widths of rows and columns of a rectangular grid; a cell's area is their product."""
    return widths(rows, "hdim_1", "y"), widths(columns, "hdim_2", "x")


def bounds(coordinate: DataFrame, index: str, value: str) -> DataFrame:
    """(index, low, high) of a 1-D coordinate, bounds halfway between neighbours and as far out at the ends."""
    order = Window.orderBy(index)
    before, after, v = F.lag(value).over(order), F.lead(value).over(order), F.col(value)
    low = F.when(before.isNull(), v - (after - v) / 2).otherwise((before + v) / 2)
    high = F.when(after.isNull(), v + (v - before) / 2).otherwise((after + v) / 2)
    return coordinate.select(index, F.least(low, high).alias("low"), F.greatest(low, high).alias("high"))


def cell_areas_axes(latitudes: DataFrame, longitudes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Factors of the cell areas of a regular grid (m2): bands (hdim_1, band) and shares (hdim_2, share); an area is their product.

    A band is the sphere's area between two latitudes by radian of longitude.
    """
    bands = bounds(latitudes, "hdim_1", "latitude").select("hdim_1", (F.lit(EARTH_RADIUS_M**2) * (F.sin(F.radians(F.least(F.col("high"), F.lit(90.0)))) - F.sin(F.radians(F.greatest(F.col("low"), F.lit(-90.0)))))).alias("band"))
    return bands, bounds(longitudes, "hdim_2", "longitude").select("hdim_2", F.radians(F.col("high") - F.col("low")).alias("share"))


def area_of_columns(mask: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """(feature, area) from two tables of factors, one by hdim_1 and one by hdim_2; no table of all cells is made."""
    flat = mask.where("feature > 0").select("frame", "feature", "hdim_1", "hdim_2").distinct()
    (a,), (b,) = ([c for c in t.columns if c not in ("hdim_1", "hdim_2")] for t in (rows, columns))
    by_row = flat.join(rows.withColumnRenamed(a, "__a"), "hdim_1").join(columns.withColumnRenamed(b, "__b"), "hdim_2")
    return by_row.groupBy("feature").agg(F.sum(F.col("__a") * F.col("__b")).alias("area"))


def cell_areas_latlon(grid: DataFrame) -> DataFrame:
    """(hdim_1, hdim_2, area in m2) of a 2-D latitude / longitude grid: centred haversine spacings, one-sided at the edges."""
    def spacing(part: str, order: str) -> Column:
        w = Window.partitionBy(part).orderBy(order)
        step = lambda shift: haversine("latitude", "longitude", shift("latitude").over(w), shift("longitude").over(w)) * 1000
        back, ahead = step(F.lag), step(F.lead)
        return F.when(back.isNull(), ahead).when(ahead.isNull(), back).otherwise((back + ahead) / 2)

    return grid.select("hdim_1", "hdim_2", (spacing("hdim_2", "hdim_1") * spacing("hdim_1", "hdim_2")).alias("area"))


def calculate_area(features: DataFrame, mask: DataFrame, areas: DataFrame) -> DataFrame:
    """Features with ``area``: the summed areas of the columns that each covers; a 3-D mask counts a column once."""
    flat = mask.where("feature > 0").select("frame", "feature", "hdim_1", "hdim_2").distinct()
    on = [a for a in ("hdim_1", "hdim_2") if a in areas.columns]
    summed = flat.join(areas, on).groupBy("feature").agg(F.sum("area").alias("area"))
    return features.join(summed, "feature", "left")
