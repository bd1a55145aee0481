"""Operators on sparse masks and fields: semi and anti joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.grid import axes_of


def _keys(df: DataFrame) -> list[str]:
    return ["frame", *axes_of(df)]


def features_only(mask: DataFrame, ids: DataFrame | list[int]) -> DataFrame:
    """Mask cells of the listed features (a list, or a table with ``feature``)."""
    if isinstance(ids, DataFrame):
        return mask.join(ids.select("feature").distinct(), "feature", "left_semi")
    return mask.where(F.col("feature").isin(list(ids)))


def cell_only(mask: DataFrame, track: DataFrame, cell: int) -> DataFrame:
    """Mask cells of the features of one tracked cell."""
    return features_only(mask, track.where(F.col("cell") == cell))


def surface(mask: DataFrame) -> DataFrame:
    """The highest feature id of each column."""
    return mask.groupBy("frame", "hdim_1", "hdim_2").agg(F.max("feature").alias("feature"))


def all_surface(mask: DataFrame) -> DataFrame:
    """1 for each column with any feature."""
    return mask.where("feature > 0").select("frame", "hdim_1", "hdim_2").distinct().withColumn("feature", F.lit(1).cast("long"))


def field_in(field: DataFrame, mask: DataFrame) -> DataFrame:
    """Field cells inside the mask."""
    keys = _keys(mask)
    return field.join(mask.where("feature > 0").select(*keys).distinct(), keys, "left_semi")


def field_outside(field: DataFrame, mask: DataFrame) -> DataFrame:
    """Field cells outside the mask: the untracked part."""
    keys = _keys(mask)
    return field.join(mask.where("feature > 0").select(*keys).distinct(), keys, "left_anti")


def field_of_features(field: DataFrame, mask: DataFrame, ids: DataFrame | list[int]) -> DataFrame:
    return field_in(field, features_only(mask, ids))


def column_mask(mask: DataFrame, levels: int) -> DataFrame:
    """A 2-D mask on every level."""
    return mask.withColumn("vdim", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))


def bounding_box(mask: DataFrame, shape: dict[str, int], buffer: int = 1) -> DataFrame:
    """First and last cell of each feature on each axis, widened by ``buffer`` within the grid."""
    aggs = []
    for a, n in shape.items():
        aggs += [F.greatest(F.min(a) - buffer, F.lit(0)).alias(f"{a}_min"), F.least(F.max(a) + buffer, F.lit(n - 1)).alias(f"{a}_max")]
    return mask.groupBy("frame", "feature").agg(*aggs)
