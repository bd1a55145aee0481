"""Scalar expressions: distances, periodic coordinates, circular means, time, histogram bins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

# Earth radii in use (km for distances between points, m for nearest grid points).
EARTH_RADIUS_KM = 6378.0
EARTH_RADIUS_M = 6371000.0

AXES = ("vdim", "hdim_1", "hdim_2")


def c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def haversine(lat1, lon1, lat2, lon2, radius: float = EARTH_RADIUS_KM) -> Column:
    """Great-circle distance of two points in degrees, in the unit of ``radius``."""
    p1, p2 = F.radians(c(lat1)), F.radians(c(lat2))
    dp, dl = p2 - p1, F.radians(c(lon2)) - F.radians(c(lon1))
    a = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def periodic_axes(pbc: str) -> tuple[str, ...]:
    """Names of the periodic axes of none, hdim_1, hdim_2 or both."""
    try:
        return {"none": (), "hdim_1": ("hdim_1",), "hdim_2": ("hdim_2",), "both": ("hdim_1", "hdim_2")}[pbc]
    except KeyError:
        raise ValueError(f"pbc must be none, hdim_1, hdim_2 or both, not {pbc!r}") from None


def limits(pbc: str, period: dict[str, float] | None) -> dict[str, float]:
    """The period of each periodic axis; a missing one is an error."""
    axes = periodic_axes(pbc)
    missing = [a for a in axes if a not in (period or {})]
    if missing:
        raise ValueError(f"the period of {', '.join(missing)} is needed")
    return {a: period[a] for a in axes}


def separation(a, b, period: float | None = None) -> Column:
    """Distance along one axis, the shorter way round on a periodic one (within one period)."""
    d = F.abs(c(a) - c(b))
    return d if period is None else F.least(d, F.abs(F.lit(float(period)) - d))


def distance(a: dict[str, Column], b: dict[str, Column], period: dict[str, float] | None = None) -> Column:
    """Euclidean distance over the axes of ``a``."""
    parts = [F.pow(separation(a[k], b[k], (period or {}).get(k)), 2) for k in a]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.sqrt(total)


def wrap(x, size: float, low: float = 0.0) -> Column:
    """A coordinate brought into [low, low + size)."""
    return F.pmod(c(x) - low, F.lit(size)) + low


def unwrap(x, size: float) -> Column:
    """The lower half of a periodic axis moved up one period, so that a region over the edge is whole."""
    return F.when(c(x) < size / 2, c(x) + size).otherwise(c(x))


def periodic_boxes(low: Column, high: Column, size: int, periodic: bool) -> Column:
    """Array of {start, stop} inside [0, size) that cover [low, high): cut off, or on a periodic axis wrapped."""
    low, high = c(low), c(high)
    box = lambda a, b: F.struct(F.lit(a).cast("int").alias("start"), F.lit(b).cast("int").alias("stop"))
    if not periodic:
        return F.array(box(F.greatest(low, F.lit(0)), F.least(high, F.lit(size))))
    return (
        F.when(high - low >= size, F.array(box(0, size)))
        .when(low < 0, F.array(box(0, high), box(low + size, size)))
        .when(high > size, F.array(box(low, size), box(0, high - size)))
        .otherwise(F.array(box(low, high)))
    )


def same_time_kind(dates, target: str) -> Column:
    """Times in the type a column of Spark type ``target`` has: ``string``, ``date`` or a timestamp."""
    return to_time(dates, {"string": "text", "date": "date"}.get(target, "timestamp"))


def circular_mean(x, weight, low: float, high: float) -> Column:
    """Aggregate: weighted mean on a circle from low to high; where directions cancel, the middle."""
    turn = 2 * math.pi
    angle = (c(x) - low) / (high - low) * turn
    s, k = F.sum(c(weight) * F.sin(angle)), F.sum(c(weight) * F.cos(angle))
    mean = F.when((F.abs(s) < 1e-12) & (F.abs(k) < 1e-12), F.lit(math.pi)).otherwise(F.atan2(s, k))
    out = F.round(F.pmod(mean, F.lit(turn)) / turn * (high - low) + low, 12)
    return F.when(out >= high, F.lit(float(low))).otherwise(out)


def seconds_between(later, earlier) -> Column:
    """Whole span in seconds, days included."""
    micros = lambda x: F.unix_micros(c(x).cast("timestamp"))
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def date_text(t) -> Column:
    return F.date_format(c(t), "yyyy-MM-dd HH:mm:ss")


def to_time(x, kind: str = "timestamp") -> Column:
    """Text, date or timestamp as ``timestamp``, ``date`` or ``text``."""
    t = c(x).cast("timestamp_ntz")
    try:
        return {"timestamp": t, "date": t.cast("date"), "text": date_text(t)}[kind]
    except KeyError:
        raise ValueError(f"unknown kind of time {kind!r}") from None


def ravel(index: dict[str, str | Column], shape: dict[str, int]) -> Column:
    """One long for a grid position, rows first."""
    out = F.lit(0).cast("long")
    for axis, n in shape.items():
        out = out * n + c(index[axis]).cast("long")
    return out


def unravel(pid, shape: dict[str, int]) -> dict[str, Column]:
    out, rest = {}, c(pid)
    for axis, n in reversed(shape.items()):
        out[axis] = F.pmod(rest, F.lit(n)).cast("int")
        rest = F.floor(rest / n)
    return dict(reversed(out.items()))


def histogram(df: DataFrame, value, edges: list[float], weight=1.0, density: bool = False) -> DataFrame:
    """bin, left, right, center, count (and density). Bins are half open, the last one closed.

    Values outside, null and NaN are dropped; empty bins are rows too. Only bins are shuffled.
    """
    if len(edges) < 2 or sorted(edges) != list(edges):
        raise ValueError("edges must rise and be two at least")
    v, last = c(value), len(edges) - 2
    arr = F.array(*(F.lit(float(e)) for e in edges))
    inside = v.isNotNull() & ~F.isnan(v) & (v >= edges[0]) & (v <= edges[-1])
    at = F.least(F.size(F.filter(arr, lambda e: e <= v)) - 1, F.lit(last))
    counted = df.where(inside).groupBy(at.alias("bin")).agg(F.sum(c(weight)).alias("count"))
    rows = [(k, float(edges[k]), float(edges[k + 1]), (edges[k] + edges[k + 1]) / 2) for k in range(last + 1)]
    bins = df.sparkSession.createDataFrame(rows, "bin int, left double, right double, center double")
    out = bins.join(counted, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0.0)).cast("double"))
    if not density:
        return out
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))
    return out.withColumn("density", F.when(total > 0, F.col("count") / (total * (F.col("right") - F.col("left")))))


def find_axis(columns: list[str], names: tuple[str, ...]) -> str | None:
    """The one column with any of the names; none gives None, several are an error."""
    found = [x for x in columns if x.lower() in names]
    if len(found) > 1:
        raise ValueError(f"ambiguous coordinates: {', '.join(found)}")
    return found[0] if found else None


# Common names of coordinates.
VERTICAL_NAMES = ("z", "model_level_number", "altitude", "geopotential_height")
LATITUDE_NAMES = ("lat", "latitude")
LONGITUDE_NAMES = ("lon", "longitude")
Y_NAMES = ("y", "projection_y_coordinate")
X_NAMES = ("x", "projection_x_coordinate")


def vertical_coordinate(df: DataFrame) -> str | None:
    return find_axis(df.columns, VERTICAL_NAMES)


def horizontal_coordinates(df: DataFrame) -> tuple[str, str, str]:
    """Names of the y and x coordinates and their kind, xy before latlon."""
    for kind, ys, xs in (("xy", Y_NAMES, X_NAMES), ("latlon", LATITUDE_NAMES, LONGITUDE_NAMES)):
        y, x = find_axis(df.columns, ys), find_axis(df.columns, xs)
        if y and x:
            return y, x, kind
    raise ValueError("no pair of horizontal coordinates")
