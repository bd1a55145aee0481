"""Segmentation: each feature grows from its seed over the cells beyond a threshold."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import kernels
from ..functions.scalar import periodic_axes
from .detect import beyond
from .stats import statistics


def seeds(features: DataFrame, shape: dict[str, int], how: str = "column", size: int | dict[str, int] = 5, level: tuple[int, int] | None = None, pbc: str = "none") -> DataFrame:
    """Seed cells (frame, cell, feature), a cell once.

    ``column``: the cell at the rounded position on all (or the ``level`` range of) levels; of features in
    one cell the highest id seeds it. ``box``: the cells from ceil(position - size / 2) up to
    ceil(position + size / 2); a cell in several boxes goes to the nearest feature, a tie to the higher id.
    """
    periodic, out = periodic_axes(pbc), features.select("frame", "feature", *(F.col(a).cast("double").alias(f"at_{a}") if a in features.columns else F.lit(None).cast("double").alias(f"at_{a}") for a in shape))
    near = F.lit(0.0)
    for axis, n in shape.items():
        at = F.col(f"at_{axis}")
        if how == "column" and axis == "vdim":
            low, high = level or (0, n)
            cells = F.sequence(F.lit(low), F.lit(high - 1))
        elif how == "column":
            cells = F.array(F.floor(at + 0.5).cast("int"))
        elif how == "box":
            s = size[axis] if isinstance(size, dict) else size
            cells = F.sequence(F.ceil(at - s / 2).cast("int"), F.ceil(at + s / 2).cast("int") - 1)
        else:
            raise ValueError("seeds are column or box")
        out = out.withColumn(f"raw_{axis}", F.explode(cells))
        raw = F.col(f"raw_{axis}")
        if how == "box":
            near = near + F.pow(raw - at, 2)
        out = out.withColumn(axis, F.pmod(raw, F.lit(n)) if axis in periodic or how == "column" and axis != "vdim" else raw).where(F.col(axis).between(0, n - 1))
    best = F.max_by("feature", F.struct(-near if how == "box" else F.lit(0.0), F.col("feature")))
    return out.withColumn("__near", near).groupBy("frame", *shape).agg(best.alias("feature"))


def segment(features: DataFrame, field: DataFrame, shape: dict[str, int], threshold: float, target: str = "maximum", how: str = "column", size: int | dict[str, int] = 5, level: tuple[int, int] | None = None, max_distance: float | None = None, dxy: float = 1.0, pbc: str = "none", statistic: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """The sparse mask (frame, cell, feature), and the features with ``ncells`` (0 without a cell).

    Only cells beyond the threshold (not at it) and seeds are shipped to the per-frame flood. Neighbours
    share a face and meet over periodic edges. ``max_distance`` takes away cells farther than
    ceil(max_distance / dxy) from the nearest seed cell inside the mask. ``statistic`` adds columns over the
    field under each feature, as ``stats.statistics`` takes them.
    """
    if max_distance is not None and pbc != "none":
        raise NotImplementedError("max_distance is for fields without periodic edges")
    axes, dims = list(shape), tuple(shape.values())
    wrap = tuple(axes.index(a) for a in periodic_axes(pbc))
    inside = field.where(beyond(F.col("value"), F.lit(float(threshold)), target, inclusive=False)).select("frame", *axes, "value")
    marked = seeds(features, shape, how, size, level, pbc)
    sign = 1.0 if target == "maximum" else -1.0
    reach = None if max_distance is None else int(np.ceil(max_distance / dxy))

    def run(cells: pd.DataFrame, seeded: pd.DataFrame) -> pd.DataFrame:
        if cells.empty or seeded.empty:
            return pd.DataFrame({"frame": [], **{a: [] for a in axes}, "feature": []})
        value, ok, mark = np.zeros(dims), np.zeros(dims, bool), np.zeros(dims, np.int64)
        at = tuple(cells[a].to_numpy() for a in axes)
        value[at], ok[at] = sign * cells["value"].to_numpy(), True
        mark[tuple(seeded[a].to_numpy() for a in axes)] = seeded["feature"].to_numpy()
        mark = np.where(ok, mark, 0)
        got = kernels.flood(value, ok, mark, wrap)
        if reach is not None and mark.any():
            got = np.where(kernels.near_markers(mark > 0, reach), got, 0)
        hit = np.nonzero(got)
        return pd.DataFrame({"frame": cells["frame"].iloc[0], **{a: h for a, h in zip(axes, hit, strict=True)}, "feature": got[hit]})

    schema = "frame int, " + ", ".join(f"{a} int" for a in axes) + ", feature long"
    mask = inside.groupBy("frame").cogroup(marked.groupBy("frame")).applyInPandas(run, schema)
    sized = with_ncells(features, mask)
    return mask, sized if statistic is None else statistics(sized, mask, field, statistic)


def with_ncells(features: DataFrame, mask: DataFrame) -> DataFrame:
    counts = mask.groupBy("frame", "feature").agg(F.count("*").alias("ncells"))
    return features.join(counts, ["frame", "feature"], "left").withColumn("ncells", F.coalesce("ncells", F.lit(0)).cast("long"))


def with_status(mask: DataFrame, field: DataFrame, shape: dict[str, int], threshold: float, target: str = "maximum", unassigned: int = -1, below: int = 0) -> DataFrame:
    """The dense mask: the feature, else ``unassigned`` beyond the threshold and ``below`` short of it. Both must not exceed 0."""
    if unassigned > 0 or below > 0:
        raise ValueError("the marks for cells without a feature must be 0 or less")
    over = beyond(F.col("value"), F.lit(float(threshold)), target, inclusive=False)
    joined = field.select("frame", *shape, "value").join(mask, ["frame", *shape], "left")
    return joined.withColumn("feature", F.coalesce("feature", F.when(over, F.lit(unassigned)).otherwise(F.lit(below))).cast("long")).drop("value")


segment_2d = segment


def segment_3d(features, field, shape, threshold, **options):
    if "vdim" not in shape:
        raise ValueError("a 3-D field needs vdim")
    return segment(features, field, shape, threshold, **options)
