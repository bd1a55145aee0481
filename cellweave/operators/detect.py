"""Feature detection: thresholds, labels, parents, positions, numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import kernels
from ..functions.scalar import circular_mean, distance, periodic_axes, ravel
from ..sources.grid import axes_of
from .graph import components, settle
from .stats import statistics

POSITIONS = ("center", "extreme", "weighted_diff", "weighted_abs")


def beyond(value: Column, threshold: Column, target: str, inclusive: bool = True) -> Column:
    """Whether a value reaches a threshold; detection counts equality, segmentation does not."""
    if target == "maximum":
        return value >= threshold if inclusive else value > threshold
    if target == "minimum":
        return value <= threshold if inclusive else value < threshold
    raise ValueError(f"target must be maximum or minimum, not {target!r}")


def per_frame(field: DataFrame, shape: dict[str, int], function, value: str = "value") -> DataFrame:
    """Run an array function on each frame's grid (absent cells 0); same columns out. One frame is one group."""
    axes = list(shape)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros(tuple(shape.values()))
        at = tuple(pdf[a].to_numpy() for a in axes)
        grid[at] = pdf[value]
        return pdf.assign(**{value: function(grid)[at]})

    return field.groupBy("frame").applyInPandas(run, field.schema)


def smooth(field: DataFrame, shape: dict[str, int], sigma: float) -> DataFrame:
    """Gaussian smoothing of every frame, borders reflected; before any threshold."""
    return field if sigma <= 0 else per_frame(field, shape, lambda x: kernels.gaussian(x, sigma))


def smooth_tiled(field: DataFrame, shape: dict[str, int], sigma: float) -> DataFrame:
    """The same smoothing without Python: one weighted spread and sum an axis, for frames beyond one task's memory."""
    w = kernels.gaussian_weights(sigma)
    reach = len(w) // 2
    taps = F.array(*(F.struct(F.lit(k - reach).alias("step"), F.lit(float(x)).alias("weight")) for k, x in enumerate(w)))
    out, keys = field, ["frame", *shape]
    for axis, n in shape.items():
        to = F.col(axis) + F.col("tap.step")
        spread = out.select(*keys, "value", F.explode(taps).alias("tap")).withColumn("to", to)
        # a cell serves target t through every reflected image of itself within reach
        images = spread.select(*(k for k in keys if k != axis), (F.col("value") * F.col("tap.weight")).alias("part"), F.col("tap.step").alias("step"), F.explode(F.array(F.col(axis), -F.col(axis) - 1, 2 * n - 1 - F.col(axis))).alias("image"))
        targets = images.select(*(k for k in keys if k != axis), (F.col("image") - F.col("step")).alias(axis), "part").where(F.col(axis).between(0, n - 1))
        out = targets.groupBy(*keys).agg(F.sum("part").alias("value"))
    rest = [c for c in field.columns if c != "value"]
    return field.select(*rest).join(out, keys).select(*field.columns)


def spectral_filter(field: DataFrame, shape: dict[str, int], dxy: float, short: float, long: float) -> DataFrame:
    """Keep wavelengths from ``short`` to ``long`` (metres) of every 2-D frame."""
    if len(shape) != 2:
        raise ValueError("spectral filtering is for 2-D fields")
    if dxy <= 0:
        raise ValueError("dxy must be positive")
    if not short > dxy:
        raise ValueError("the shortest wavelength must exceed the grid spacing")
    if long > 2 * dxy * max(shape.values()):
        raise ValueError("the longest wavelength exceeds the domain")
    return per_frame(field, shape, lambda x: kernels.spectral(x, dxy, short, long))


def erode(pixels: DataFrame, shape: dict[str, int], size: int) -> DataFrame:
    """Cells all of whose size x size(x size) neighbours inside the domain are cells too."""
    if size <= 0:
        return pixels
    axes, before = list(shape), size // 2
    steps = F.sequence(F.lit(-before), F.lit(size - 1 - before))
    spread = pixels.select("frame", "rank", *axes)
    for a in axes:
        spread = spread.withColumn("__step", F.explode(steps)).withColumn(a, F.col(a) - F.col("__step")).drop("__step")
    inside, need = F.lit(True), F.lit(1)
    for a, n in shape.items():
        inside = inside & F.col(a).between(0, n - 1)
        need = need * (F.least(F.col(a) + (size - 1 - before), F.lit(n - 1)) - F.greatest(F.col(a) - before, F.lit(0)) + 1)
    full = spread.where(inside).groupBy("frame", "rank", *axes).count().where(F.col("count") == need).drop("count")
    return pixels.join(full, ["frame", "rank", *axes], "left_semi")


def label(pixels: DataFrame, shape: dict[str, int], pbc: str = "none", tile: int | None = None) -> DataFrame:
    """Add ``label``, the lowest raveled id of each region of connected cells, by frame and rank.

    Diagonal neighbours connect. One group is a frame and rank, or with ``tile`` a square of a frame:
    then labels of tiles are joined along their borders, so no task holds a whole frame.
    """
    axes, dims = list(shape), tuple(shape.values())
    wrap = tuple(axes.index(a) for a in periodic_axes(pbc))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(label=kernels.label_cells(pdf[axes].to_numpy(np.int64), dims, () if tile else wrap))

    schema = ", ".join(f"{n} {t}" for n, t in [*pixels.dtypes, ("label", "long")])
    if not tile:
        return pixels.groupBy("frame", "rank").applyInPandas(run, schema)
    tiles = [F.floor(F.col(a) / tile).alias(f"tile_{a}") for a in axes]
    local = settle(pixels.groupBy("frame", "rank", *tiles).applyInPandas(run, schema))
    border = F.lit(False)
    for a in axes:
        border = border | (F.col(a) % tile == 0) | (F.col(a) % tile == tile - 1)
    rim = local.where(border).select("frame", "rank", *axes, "label")
    steps = [F.struct(*(F.lit(o).alias(a) for a, o in zip(axes, offset, strict=True))) for offset in kernels.half_offsets(len(axes))]
    inside = F.lit(True)
    for a, n in shape.items():
        inside = inside & F.col(f"to_{a}").between(0, n - 1)
    moved = rim.withColumn("step", F.explode(F.array(*steps))).select("frame", "rank", F.col("label").alias("a"), *((F.col(a) + F.col(f"step.{a}")).alias(f"to_{a}") for a in axes)).where(inside)
    sets = [(a,) for a in periodic_axes(pbc)] + ([periodic_axes(pbc)] if pbc == "both" else [])
    for axes_over in sets:
        edge, to = F.lit(True), {a: F.col(a) for a in axes}
        for a in axes_over:
            edge = edge & ((F.col(a) == 0) | (F.col(a) == shape[a] - 1))
            to[a] = F.when(F.col(a) == 0, F.lit(shape[a] - 1)).otherwise(F.lit(0))
        moved = moved.union(local.where(edge).select("frame", "rank", F.col("label").alias("a"), *(to[a].cast("int").alias(f"to_{a}") for a in axes)))
    met = moved.join(rim.union(local.where(~border).select(*rim.columns)).select("frame", "rank", *(F.col(a).alias(f"to_{a}") for a in axes), F.col("label").alias("b")), ["frame", "rank", *(f"to_{a}" for a in axes)]).where("a != b")
    node = lambda x: F.struct("frame", "rank", F.col(x).alias("label"))
    merged = components(met.select(node("a").alias("a"), node("b").alias("b"))).select("node.*", F.col("component.label").alias("root"))
    return local.join(merged, ["frame", "rank", "label"], "left").withColumn("label", F.coalesce("root", "label")).drop("root")


def regions(field: DataFrame, shape: dict[str, int], thresholds: list[float], target: str = "maximum", n_min: int | list[int] | dict[float, int] = 0, erosion: int = 0, pbc: str = "none", strict: bool = False, tile: int | None = None) -> DataFrame:
    """Cells of the surviving regions: frame, rank (0 the least extreme threshold), threshold_value, label, cell, value.

    A region with n_min cells or fewer goes. A region goes if it shares a cell with one of a more
    extreme threshold. With ``strict`` a region also needs one below it that itself was accepted.
    """
    order = sorted(range(len(thresholds)), key=lambda k: thresholds[k], reverse=target == "minimum")
    least = n_min if isinstance(n_min, dict) else {t: n for t, n in zip(thresholds, n_min, strict=True)} if isinstance(n_min, list) else dict.fromkeys(thresholds, n_min)
    steps = F.array(*(F.struct(F.lit(r).alias("rank"), F.lit(float(thresholds[k])).alias("threshold_value"), F.lit(int(least[thresholds[k]])).alias("n_min")) for r, k in enumerate(order)))
    keep = F.filter(steps, lambda s: beyond(F.col("value"), s["threshold_value"], target))
    pixels = field.select("frame", *shape, "value", F.inline(keep))
    pixels = label(erode(pixels, shape, erosion), shape, pbc, tile)
    same = Window.partitionBy("frame", "rank", "label")
    valid = settle(pixels.withColumn("num", F.count("*").over(same)).where("num > n_min").drop("n_min"))
    if strict:
        valid = _supported(valid, shape, len(order))
    top = F.max("rank").over(Window.partitionBy("frame", *shape))
    covered = F.max((F.col("top") > F.col("rank")).cast("int")).over(same)
    return valid.withColumn("top", top).withColumn("covered", covered).where("covered = 0").drop("top", "covered")


def _supported(valid: DataFrame, shape: dict[str, int], ranks: int) -> DataFrame:
    """Regions whose every lower rank holds an accepted region beneath them; one pass for each of the few thresholds."""
    accepted = valid.where("rank = 0")
    out = accepted
    for rank in range(1, ranks):
        level = valid.where(F.col("rank") == rank)
        hit = level.join(accepted.select("frame", *shape), ["frame", *shape], "left_semi").select("frame", "label").distinct()
        accepted = level.join(hit, ["frame", "label"], "left_semi")
        out = out.unionByName(accepted)
    return settle(out)


def positions(cells: DataFrame, shape: dict[str, int], how: str = "center", target: str = "maximum", pbc: str = "none") -> DataFrame:
    """One row a region: frame, rank, label, threshold_value, num and its position on each axis."""
    if how not in POSITIONS:
        raise ValueError(f"position must be one of {', '.join(POSITIONS)}")
    keys = ["frame", "rank", "label", "threshold_value"]
    value, thr = F.col("value"), F.col("threshold_value")
    weight = {"center": F.lit(1.0), "extreme": F.lit(1.0), "weighted_diff": F.abs(value - thr), "weighted_abs": F.abs(value)}[how]
    cells = cells.withColumn("w", weight)
    periodic = periodic_axes(pbc)
    aggs = [F.count("*").cast("long").alias("num")]
    for axis, n in shape.items():
        x = F.col(axis)
        if how == "extreme":
            order = F.struct(value if target == "maximum" else -value, -ravel({a: a for a in shape}, shape))
            aggs.append(F.max_by(x, order).cast("double").alias(axis))
        elif axis in periodic:
            total = F.sum("w")
            aggs.append(F.when(total > 0, circular_mean(x, "w", 0, n)).otherwise(circular_mean(x, F.lit(1.0), 0, n)).alias(axis))
        else:
            aggs.append(F.coalesce(F.try_divide(F.sum(x * F.col("w")), F.sum("w")), F.avg(x)).alias(axis))
    return cells.groupBy(*keys).agg(*aggs)


def number(rows: DataFrame, order: list[str], start: int = 1, column: str = "feature") -> DataFrame:
    """Consecutive ids by frame and ``order``: numbers within frames plus the counts of earlier frames.

    Only one row a frame meets in a single task.
    """
    per = rows.groupBy("frame").agg(F.count("*").alias("n"))
    before = per.withColumn("before", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("frame").rowsBetween(Window.unboundedPreceding, -1))).select("frame", F.coalesce("before", F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("frame").orderBy(*order))
    out = rows.withColumn("idx", within.cast("int")).join(before, "frame")
    return out.withColumn(column, (F.col("idx") + F.col("before") + (start - 1)).cast("long")).drop("before")


def filter_min_distance(features: DataFrame, min_distance: float, dxy: float = 1.0, dz: float = 1.0, target: str = "maximum", period: dict[str, float] | None = None) -> DataFrame:
    """Drop a feature with a better one of its frame within ``min_distance``.

    Better: the more extreme threshold, then the larger num, then the lower feature id. Neighbours meet
    through buckets as wide as the distance, so only features close by are compared.
    """
    axes = axes_of(features)
    scale = {a: dz if a == "vdim" else dxy for a in axes}
    reach = {a: min_distance / scale[a] for a in axes}
    bins = {a: max(int(p // reach[a]), 1) for a, p in (period or {}).items()}
    bucket = {a: F.least(F.floor(F.col(a) / ((period[a] / bins[a]) if a in bins else reach[a])), F.lit(bins[a] - 1)) if a in bins else F.floor(F.col(a) / reach[a]) for a in axes}
    me = features.select("frame", "feature", "num", "threshold_value", *axes, *(b.alias(f"b_{a}") for a, b in bucket.items()))
    other = me
    for a in axes:
        around = F.explode(F.array_distinct(F.array(*(F.pmod(F.col(f"b_{a}") + k, F.lit(bins[a])) if a in bins else F.col(f"b_{a}") + k for k in (-1, 0, 1)))))
        other = other.withColumn(f"b_{a}", around)
    near = me.alias("m").join(other.alias("o"), [F.col("m.frame") == F.col("o.frame"), *(F.col(f"m.b_{a}") == F.col(f"o.b_{a}") for a in axes)])
    d = distance({a: F.col(f"m.{a}") * scale[a] for a in axes}, {a: F.col(f"o.{a}") * scale[a] for a in axes}, {a: p * scale[a] for a, p in (period or {}).items()})
    sign = 1 if target == "maximum" else -1
    rank = lambda t: F.struct(F.col(f"{t}.threshold_value") * sign, F.col(f"{t}.num"), -F.col(f"{t}.feature"))
    worse = near.where((F.col("m.feature") != F.col("o.feature")) & (d <= min_distance) & (rank("o") > rank("m"))).select(F.col("m.frame").alias("frame"), F.col("m.feature").alias("feature")).distinct()
    return features.join(worse, ["frame", "feature"], "left_anti")


def detect(field: DataFrame, shape: dict[str, int], thresholds: float | list[float], target: str = "maximum", position: str = "center", sigma: float = 0.5, n_min: int | list[int] | dict[float, int] = 0, erosion: int = 0, pbc: str = "none", strict: bool = False, start: int = 1, wavelength: tuple[float, float] | None = None, dxy: float = 1.0, min_distance: float | None = None, tile: int | None = None, statistic: dict | None = None, statistics_unsmoothed: bool = False) -> DataFrame:
    """Features of a field: frame, idx, hdim_1, hdim_2, [vdim], num, threshold_value, feature, time. Nothing found: no rows.

    ``statistic`` adds columns over the cells of each feature, as ``stats.statistics`` takes them, of the
    smoothed field or with ``statistics_unsmoothed`` of the field itself. With ``tile`` no task holds a
    frame, but for a ``wavelength`` band, which needs whole ones.
    """
    return detect_with_labels(field, shape, thresholds, target, position, sigma, n_min, erosion, pbc, strict, start, min_distance, dxy, tile, wavelength, statistic, statistics_unsmoothed)[0]


def _found(field, shape, thresholds, target, position, sigma, n_min, erosion, pbc, strict, start, wavelength, dxy, tile):
    several = list(thresholds) if isinstance(thresholds, (list, tuple)) else [thresholds]
    smoothed = smooth_tiled(field, shape, sigma) if tile and sigma > 0 else smooth(field, shape, sigma)
    if wavelength:
        smoothed = spectral_filter(smoothed, shape, dxy, *wavelength)
    cells = regions(smoothed, shape, several, target, n_min, erosion, pbc, strict, tile)
    found = number(positions(cells, shape, position, target, pbc), ["rank", "label"], start)
    if "time" in field.columns:
        found = found.join(field.groupBy("frame").agg(F.min("time").alias("time")), "frame")
    return smoothed, cells, found


def detect_with_labels(field: DataFrame, shape: dict[str, int], thresholds, target: str = "maximum", position: str = "center", sigma: float = 0.5, n_min=0, erosion: int = 0, pbc: str = "none", strict: bool = False, start: int = 1, min_distance: float | None = None, dxy: float = 1.0, tile: int | None = None, wavelength: tuple[float, float] | None = None, statistic: dict | None = None, statistics_unsmoothed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Features, and the sparse label field (frame, cell, feature) of those that stayed."""
    smoothed, cells, found = _found(field, shape, thresholds, target, position, sigma, n_min, erosion, pbc, strict, start, wavelength, dxy, tile)
    if min_distance is not None:
        found = filter_min_distance(found, min_distance, dxy, dxy, target, {a: shape[a] - 1 for a in periodic_axes(pbc)})
    mask = cells.join(found.select("frame", "rank", "label", "feature"), ["frame", "rank", "label"]).select("frame", *shape, "feature")
    found = found.drop("label", "rank")
    if statistic is not None:
        found = statistics(found, mask, field if statistics_unsmoothed else smoothed, statistic)
    return found, mask
