"""The whole chain in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.detect import detect
from ..operators.graph import settle
from ..operators.segment import segment
from ..operators.tracks import link, merge_split


def run_pipeline(field: DataFrame, shape: dict[str, int], dxy: float, dt: float, thresholds: list[float], segment_threshold: float, v_max: float, target: str = "maximum", detect_options: dict | None = None, segment_options: dict | None = None, link_options: dict | None = None, merge: bool = True) -> dict[str, DataFrame]:
    """Detect, segment, link and (optionally) merge and split: features, mask, track and the track tables."""
    features = settle(detect(field, shape, thresholds, target, **(detect_options or {})))
    mask, sized = segment(features, field, shape, segment_threshold, target, dxy=dxy, **(segment_options or {}))
    track = settle(link(sized, dt, dxy, v_max=v_max, **(link_options or {})))
    out = {"features": features, "mask": mask, "track": track}
    return out | ({f"merge_{k}": v for k, v in merge_split(track, dxy).items()} if merge else {})
