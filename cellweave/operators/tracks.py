"""Linking features into cells, and cells into tracks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import kernels
from ..functions.scalar import distance, seconds_between
from ..sources.grid import axes_of
from .graph import components, settle, spanning_forest


def search_radius(dt: float, dxy: float, v_max: float | None = None, d_max: float | None = None) -> float:
    """Search radius in pixels from a speed or a distance; exactly one is needed."""
    if (v_max is None) == (d_max is None):
        raise ValueError("give either v_max or d_max")
    return dt * v_max / dxy if v_max is not None else d_max / dxy


def near_pairs(left: DataFrame, right: DataFrame, on: list[str], axes: list[str], radius: float, period: dict[str, float] | None = None) -> DataFrame:
    """Pairs (l.*, r.*, d) within the radius, met through buckets as wide as it; ``on`` must be equal.

    Columns of the sides come back prefixed l_ and r_.
    """
    bins = {a: max(int(p // radius), 1) for a, p in (period or {}).items()}
    def place(a: str, t: str):
        x = F.col(f"{t}_{a}")
        return F.pmod(F.floor(F.pmod(x, F.lit(float(period[a]))) / (period[a] / bins[a])), F.lit(bins[a])) if a in bins else F.floor(x / radius)

    a_side = left.select(*(F.col(x).alias(f"l_{x}") for x in left.columns))
    b_side = right.select(*(F.col(x).alias(f"r_{x}") for x in right.columns))
    for a in axes:
        a_side = a_side.withColumn(f"b_{a}", place(a, "l"))
        around = F.array_distinct(F.array(*(F.pmod(place(a, "r") + k, F.lit(bins[a])) if a in bins else place(a, "r") + k for k in (-1, 0, 1))))
        b_side = b_side.withColumn(f"b_{a}", F.explode(around))
    for k in on:
        b_side = b_side.withColumn(f"on_{k}", F.col(f"r_{k}"))
        a_side = a_side.withColumn(f"on_{k}", F.col(f"l_{k}"))
    keys = [f"b_{a}" for a in axes] + [f"on_{k}" for k in on]
    d = distance({a: F.col(f"l_{a}") for a in axes}, {a: F.col(f"r_{a}") for a in axes}, period)
    return a_side.join(b_side, keys).withColumn("d", d).where(F.col("d") <= radius).drop(*keys)


def link(features: DataFrame, dt: float, dxy: float, v_max: float | None = None, d_max: float | None = None, method: str = "random", memory: int = 0, stubs: int = 1, time_cell_min: float | None = None, dz: float | None = None, vertical: str | None = None, period: dict[str, float] | None = None, adaptive_step: float | None = None, adaptive_stop: float | None = None, subnetwork_size: int = 30, start: int = 1, unassigned: int = -1, extrapolate: int = 0) -> DataFrame:
    """Features with ``cell`` and ``time_cell`` (seconds).

    ``random``: between frames the links within the search radius that minimise the sum of squared
    distances. Without memory this is distributed: bucketed candidate pairs, components of contested ones,
    an exact assignment in each, and cells as components of the links. ``predict`` searches around the
    place that the last step's velocity points to; it, and memory, walk the frames in order in one group.
    More than ``subnetwork_size`` features on a side of a contest raise, or are tried again within
    ``adaptive_step`` times the radius down to ``adaptive_stop``.
    """
    if extrapolate:
        raise NotImplementedError("extrapolation is not available")
    if method not in ("random", "predict"):
        raise ValueError("method is random or predict")
    if (adaptive_step is None) != (adaptive_stop is None):
        raise ValueError("adaptive search needs both its step and its stop")
    radius = search_radius(dt, dxy, v_max, d_max)
    axes = axes_of(features)
    if "vdim" in axes and (dz is None) == (vertical is None):
        raise ValueError("a 3-D feature table needs either dz or a vertical coordinate")
    points = features.select("feature", "frame", *(((F.col("vdim") * dz if dz is not None else F.col(vertical)) / dxy if a == "vdim" else F.col(a)).cast("double").alias(a) for a in axes))
    if method == "random" and memory == 0:
        chained = _link_distributed(points, axes, radius, period, adaptive_step, adaptive_stop, subnetwork_size)
    else:
        chained = _link_in_order(points, axes, radius, period, method == "predict", memory, adaptive_step, adaptive_stop, subnetwork_size)
    linked = number_cells(features.join(chained, "feature"), start)
    if time_cell_min is not None:
        stubs = max(stubs, int(time_cell_min // dt) + 1)
    size = F.count("*").over(Window.partitionBy("cell"))
    linked = linked.withColumn("cell", F.when(size < stubs, F.lit(unassigned)).otherwise(F.col("cell")).cast("int"))
    return add_cell_time(linked, unassigned)


def _link_distributed(points, axes, radius, period, step, stop, most) -> DataFrame:
    ahead = points.withColumn("frame", F.col("frame") - 1)
    pairs = settle(near_pairs(points, ahead, ["frame"], axes, radius, period).select(F.col("l_feature").alias("a"), F.col("r_feature").alias("b"), "d"))
    # a feature stands in two contests, with the frame before and the one after: even and odd ids keep them apart
    sides = pairs.select((2 * F.col("a")).alias("x"), (2 * F.col("b") + 1).alias("y"))
    contest = components(sides, "x", "y")
    grouped = pairs.join(contest, 2 * F.col("a") == F.col("node")).select("component", "a", "b", "d")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        links = kernels.match_within(pdf["a"].to_numpy(), pdf["b"].to_numpy(), pdf["d"].to_numpy(), radius, most, step, stop)
        return pd.DataFrame(links, columns=["a", "b"])

    links = settle(grouped.groupBy("component").applyInPandas(run, "a long, b long"))
    chains = components(links)
    return points.select("feature").join(chains, F.col("feature") == F.col("node"), "left").select("feature", F.coalesce("component", "feature").alias("chain"))


def _link_in_order(points, axes, radius, period, predict, memory, step=None, stop=None, most=30) -> DataFrame:
    size = [None if not period or a not in period else float(period[a]) for a in axes]

    def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        d = np.abs(p[:, None] - q[None])
        for k, n in enumerate(size):
            if n:
                d[..., k] = np.minimum(d[..., k], n - d[..., k])
        return (d**2).sum(axis=2)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame", "feature"])
        chains, living, made = {}, [], 0  # living: [chain, place, velocity, last frame]
        before = None
        for frame in range(int(pdf["frame"].min()), int(pdf["frame"].max()) + 1):
            now = pdf[pdf["frame"] == frame]
            here, ids = now[axes].to_numpy(float), now["feature"].tolist()
            living = [x for x in living if frame - x[3] <= memory + 1]
            taken: dict[int, int] = {}
            if len(here) and living:
                there = np.array([x[1] for x in living])
                if predict:
                    speeds = [x[2] for x in living]
                    known = [(x[1], x[2]) for x in living if x[2] is not None]
                    guess = []
                    for x, v in zip(living, speeds, strict=True):
                        if v is None and known:  # a new one moves as the nearest moving one does
                            k = int(np.argmin(apart(np.array([x[1]]), np.array([p for p, _ in known]))[0]))
                            v = known[k][1]
                        guess.append(x[1] + (v if v is not None else 0) * (frame - x[3]))
                    there = np.array(guess)
                d = np.sqrt(apart(there, here))
                i_near, j_near = np.nonzero(d <= radius)
                for i, j in kernels.match_within(i_near, j_near, d[i_near, j_near], radius, most, step, stop):
                    taken[j] = i
            fresh = []
            for j, (place, feature) in enumerate(zip(here, ids, strict=True)):
                if j in taken:
                    x = living[taken[j]]
                    move = place - x[1]
                    for k, n in enumerate(size):
                        if n:
                            move[k] -= n * np.round(move[k] / n)
                    fresh.append([x[0], place, move / (frame - x[3]), frame])
                else:
                    fresh.append([made, place, None, frame])
                    made += 1
                chains[feature] = fresh[-1][0]
            used = set(taken.values())
            living = [x for i, x in enumerate(living) if i not in used] + fresh
        return pd.DataFrame({"feature": list(chains), "chain": list(chains.values())})

    return points.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, "feature long, chain long")


def number_cells(chained: DataFrame, start: int = 1) -> DataFrame:
    """``chain`` renamed to consecutive ``cell`` ids by first appearance (frame, then feature)."""
    from .detect import number

    first = chained.groupBy("chain").agg(F.min(F.struct("frame", "feature")).alias("f")).select("chain", "f.frame", F.col("f.feature").alias("first"))
    ids = number(first, ["first"], start, "cell").select("chain", F.col("cell").cast("int").alias("cell"))
    return chained.join(ids, "chain").drop("chain")


def add_cell_time(track: DataFrame, unassigned: int = -1) -> DataFrame:
    """``time_cell``: seconds since the cell's first row; null where unassigned."""
    first = F.min("time").over(Window.partitionBy("cell"))
    return track.withColumn("time_cell", F.when(F.col("cell") != unassigned, seconds_between("time", first)))


def mark_stubs(track: DataFrame, stubs: int, unassigned: int = -1) -> DataFrame:
    """Rows of cells with fewer than ``stubs`` rows become unassigned; the rows stay."""
    size = F.count("*").over(Window.partitionBy("cell"))
    return track.withColumn("cell", F.when(size < stubs, F.lit(unassigned)).otherwise(F.col("cell")))


def remap(table: DataFrame, mapping: DataFrame, column: str = "cell") -> DataFrame:
    """``column`` looked up in a table (old, new)."""
    return table.join(mapping.select(F.col("old").alias(column), "new"), column, "left").withColumn(column, F.col("new")).drop("new")


def fill_gaps(track: DataFrame) -> DataFrame:
    """Cells with their missing frames put in, positions on the straight line between the known ones."""
    axes = axes_of(track)
    w = Window.partitionBy("cell").orderBy("frame")
    ahead = track.select("cell", "frame", "time", *axes, F.lead("frame").over(w).alias("next"), F.lead("time").over(w).alias("next_time"), *(F.lead(a).over(w).alias(f"next_{a}") for a in axes))
    rows = ahead.withColumn("at", F.explode(F.sequence(F.col("frame"), F.coalesce(F.col("next") - 1, F.col("frame")))))
    share = F.coalesce((F.col("at") - F.col("frame")) / (F.col("next") - F.col("frame")), F.lit(0.0))
    span = F.coalesce(seconds_between("next_time", "time"), F.lit(0.0)) * share
    return rows.select("cell", F.col("at").cast("int").alias("frame"), (F.col("time") + F.make_dt_interval(secs=span.cast("decimal(18,6)"))).alias("time"), *((F.col(a) + F.coalesce(F.col(f"next_{a}") - F.col(a), F.lit(0.0)) * share).alias(a) for a in axes), (F.col("at") != F.col("frame")).alias("filled"))


def merge_split(track: DataFrame, dxy: float, distance_max: float | None = None, frame_len: int = 5, dz: float | None = None, vertical: str | None = None, period: dict[str, float] | None = None, unassigned: int = -1, frame_rule: str = "reference") -> dict[str, DataFrame]:
    """Families of cells: tables ``feature``, ``cell`` and ``track``.

    A cell's end and another's start within ``distance_max`` (default 25 dxy) join them; ``frame_rule``
    says which frames must be within ``frame_len``: the ending cell's first and the starting cell's last
    ("reference"), or its last and the other's first ("end_to_start"). Tracks are the components; the
    flags mark the cells at the row and column ends of the minimum spanning forest.
    """
    if frame_rule not in ("reference", "end_to_start"):
        raise ValueError("frame_rule is reference or end_to_start")
    axes = axes_of(track)
    reach = 25 * dxy if distance_max is None else distance_max
    scale = lambda a: (F.col("vdim") * dz if dz is not None else F.col(vertical)) if a == "vdim" else F.col(a) * dxy
    own = track.where(F.col("cell") != unassigned)
    row = F.struct("frame", *(scale(a).cast("double").alias(a) for a in axes))
    ends = settle(own.groupBy("cell").agg(F.min_by(row, "frame").alias("first"), F.max_by(row, "frame").alias("last"), F.count("*").alias("cell_child_feature_count")))
    side = lambda which: ends.select("cell", F.col("first.frame").alias("first"), F.col("last.frame").alias("last"), *(F.col(f"{which}.{a}").alias(a) for a in axes))
    pairs = near_pairs(side("last"), side("first"), [], axes, reach, {a: p * dxy for a, p in (period or {}).items()})
    gap = F.abs(F.col("l_first") - F.col("r_last")) if frame_rule == "reference" else F.abs(F.col("l_last") - F.col("r_first"))
    edges = pairs.where((F.col("l_cell") != F.col("r_cell")) & (gap <= frame_len)).select(F.col("l_cell").cast("long").alias("a"), F.col("r_cell").cast("long").alias("b"), (F.col("d") + 0.01).alias("w"))
    # the forest has the components of all edges
    grown = spanning_forest(edges)
    family = settle(components(grown))
    named = ends.join(family, F.col("cell") == F.col("node"), "left").select("cell", "cell_child_feature_count", F.coalesce("component", F.col("cell").cast("long")).alias("root"))
    roots = named.groupBy("root").agg(F.count("*").alias("track_child_cell_count"))
    # tracks are numbered by their lowest cell; one row a thousand roots meets in one task
    from .detect import number

    ids = number(roots.withColumn("frame", F.floor(F.col("root") / 1000)), ["root"], 1, "track").select("root", F.col("track").cast("int").alias("track"), "track_child_cell_count")
    flag = lambda col, name: grown.select(F.col(col).cast("int").alias("cell")).distinct().withColumn(name, F.lit(True))
    cells = named.join(ids.select("root", "track"), "root").drop("root").withColumnRenamed("track", "cell_parent_track_id")
    cells = cells.join(flag("a", "cell_starts_with_split"), "cell", "left").join(flag("b", "cell_ends_with_merge"), "cell", "left").fillna(False, ["cell_starts_with_split", "cell_ends_with_merge"])
    features = track.select("feature", F.col("cell").alias("feature_parent_cell_id")).join(cells.select(F.col("cell").alias("feature_parent_cell_id"), F.col("cell_parent_track_id").alias("feature_parent_track_id")), "feature_parent_cell_id", "left")
    features = features.withColumn("feature_parent_track_id", F.coalesce("feature_parent_track_id", F.lit(unassigned)))
    return {"feature": features, "cell": cells, "track": ids.select("track", "track_child_cell_count")}
