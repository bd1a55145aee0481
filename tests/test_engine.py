"""Hand-worked cases of detection, segmentation, linking, tracks, statistics and tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions import kernels, scalar
from cellweave.operators import analysis, masks, stats, tables, tracks
from cellweave.operators.detect import detect, detect_with_labels, filter_min_distance
from cellweave.operators.graph import components
from cellweave.operators.segment import seeds, segment, with_status
from cellweave.sources import synthetic
from cellweave.sources.grid import from_array, read_cells, slabs, write_cells

SQUARE = {"hdim_1": 50, "hdim_2": 50}


def field(spark, *boxes, shape=(50, 50), base=0.0):
    values = np.full((1, *shape), base)
    for rows, columns, value in boxes:
        values[0, rows[0] : rows[1], columns[0] : columns[1]] = value
    return from_array(spark, values)


def test_one_square_is_found_at_its_centre(spark):
    painted = synthetic.paint(field(spark), {"hdim_1": 20, "hdim_2": 20}, {"hdim_1": 5, "hdim_2": 5}, 2)
    row = detect(painted, SQUARE, 1.5, n_min=10, sigma=0.0).first()
    assert (row.hdim_1, row.hdim_2, row.num, row.feature, row.frame) == (20, 20, 25, 1, 0)
    assert detect(painted, SQUARE, 1.5, n_min=25, sigma=0.0).count() == 0  # n_min cells or fewer go
    assert detect(painted, SQUARE, 2.0, sigma=0.0).count() == 1 and detect(painted, SQUARE, 2.1, sigma=0.0).count() == 0  # equality counts


def test_nested_squares_strict_and_not(spark):
    values = np.zeros((1, 101, 101))
    for side, threshold_shift in ((40, 0), (20, 4), (10, 8), (5, 12)):
        lo = 30 + threshold_shift
        values[0, lo : lo + side, lo : lo + side] = 50 - side
    shape = {"hdim_1": 101, "hdim_2": 101}
    cells = from_array(spark, values)
    loose = detect(cells, shape, [8, 29, 39, 44], sigma=0.0).collect()
    assert [(r.hdim_1, r.threshold_value) for r in loose] == [(44.0, 44.0)]
    strict = detect(cells, shape, [8, 29, 39, 44], n_min={8: 0, 29: 500, 39: 0, 44: 0}, strict=True, sigma=0.0).collect()
    assert [(r.hdim_1, r.threshold_value) for r in strict] == [(49.5, 8.0)]


def test_periodic_regions(spark):
    snake = np.zeros((1, 50, 50))
    snake[0, 10:20, 0] = snake[0, 20:30, 49] = snake[0, 19, 0] = snake[0, 19:21, 49] = 2
    cells = from_array(spark, snake)
    assert detect(cells, SQUARE, 1.0, pbc="hdim_2", sigma=0.0).count() == 1 and detect(cells, SQUARE, 1.0, sigma=0.0).count() == 2
    assert detect(cells, SQUARE, 1.0, pbc="hdim_2", tile=7, sigma=0.0).count() == 1
    with pytest.raises(ValueError):
        scalar.periodic_axes("sideways")


@pytest.mark.parametrize("pbc", ["none", "hdim_1", "both"])
def test_tiled_labels_equal_whole_frames(spark, pbc):
    values = (np.random.default_rng(3).random((2, 30, 40)) > 0.6).astype(float)
    shape = {"hdim_1": 30, "hdim_2": 40}
    cells = from_array(spark, values)
    key = lambda df: sorted((r.frame, r.num, round(r.hdim_1, 6), round(r.hdim_2, 6)) for r in df.collect())
    assert key(detect(cells, shape, 0.5, pbc=pbc, sigma=0.0)) == key(detect(cells, shape, 0.5, pbc=pbc, tile=8, sigma=0.0))


def test_transposed_field_gives_transposed_features(spark):
    values = np.random.default_rng(4).random((1, 20, 25))
    a = detect(from_array(spark, values), {"hdim_1": 20, "hdim_2": 25}, [0.6, 0.9], position="weighted_diff", sigma=0.0).collect()
    b = detect(from_array(spark, values.transpose(0, 2, 1)), {"hdim_1": 25, "hdim_2": 20}, [0.6, 0.9], position="weighted_diff", sigma=0.0).collect()
    assert sorted((round(r.hdim_1, 9), round(r.hdim_2, 9)) for r in a) == sorted((round(r.hdim_2, 9), round(r.hdim_1, 9)) for r in b)


def test_circular_mean_and_distance(spark):
    df = spark.createDataFrame([(0, 1.0), (9, 1.0)], "x int, w double")
    assert df.agg(scalar.circular_mean("x", "w", 0, 10).alias("m")).first().m == 9.5
    d = spark.range(1).select(scalar.separation(F.lit(1), F.lit(9), 10).alias("d"), scalar.haversine(0, 0, 0, 90).alias("h")).first()
    assert d.d == 2 and d.h == pytest.approx(6378 * math.pi / 2)


def test_min_distance_prefers_threshold_then_size_then_lower_id(spark):
    rows = [(0, 1, 10.0, 10.0, 5, 2.0), (0, 2, 11.0, 10.0, 9, 1.0), (0, 3, 30.0, 30.0, 5, 1.0), (0, 4, 31.0, 30.0, 6, 1.0), (1, 5, 10.0, 10.0, 5, 1.0), (1, 6, 10.0, 11.0, 5, 1.0), (1, 7, 0.0, 49.0, 1, 1.0), (1, 8, 0.0, 0.0, 2, 1.0)]
    t = spark.createDataFrame(rows, "frame int, feature long, hdim_1 double, hdim_2 double, num long, threshold_value double")
    keep = lambda **k: sorted(r.feature for r in filter_min_distance(t, 2.0, **k).collect())
    assert keep() == [1, 4, 5, 7, 8] and keep(period={"hdim_2": 50}) == [1, 4, 5, 8]
    assert keep(target="minimum") == [2, 4, 5, 7, 8]


def test_gaussian_and_spectral():
    x = np.random.default_rng(0).random((12, 9))
    assert kernels.gaussian(np.ones((7, 5)), 1.3) == pytest.approx(np.ones((7, 5)))
    a, b = kernels.cosine_matrix(12), kernels.cosine_matrix(9)
    assert a.T @ (a @ x @ b.T) @ b == pytest.approx(x)
    amplitude = kernels.band_pass((64, 64), 1000, 4000, 16000)
    wavelength = 2 * 64 * 1000 / np.maximum(np.arange(64), 1)
    middle = amplitude[0, (wavelength > 7000) & (wavelength < 9000)]
    assert amplitude[0, 0] < 1e-6 and middle.min() > 0.9
    assert amplitude[0, 32] == pytest.approx(math.sqrt(0.5), abs=1e-6) and amplitude[0, 8] == pytest.approx(math.sqrt(0.5), abs=1e-6)


def test_segments_have_the_squares_sizes(spark):
    cells = field(spark, ((18, 23), (18, 23), 2.0), ((35, 45), (35, 45), 10.0))
    features = detect(cells, SQUARE, 1.5, sigma=0.0)
    mask, sized = segment(features, cells, SQUARE, 1.5)
    assert sorted(r.ncells for r in sized.collect()) == [25, 100] and mask.count() == 125
    dense = with_status(masks.features_only(mask, [1]), cells, SQUARE, 1.5)
    assert {r.feature: r["count"] for r in dense.groupBy("feature").count().collect()} == {1: 25, -1: 100, 0: 2375}
    with pytest.raises(ValueError):
        with_status(mask, cells, SQUARE, 1.5, unassigned=2)


def test_max_distance_leaves_a_plus(spark):
    cells = field(spark, base=10.0)
    one = spark.createDataFrame([(0, 1, 5.0, 5.0)], "frame int, feature long, hdim_1 double, hdim_2 double")
    mask, sized = segment(one, cells, SQUARE, 1.0, max_distance=1.0)
    assert sized.first().ncells == 5
    assert {(r.hdim_1, r.hdim_2) for r in mask.collect()} == {(5, 5), (4, 5), (6, 5), (5, 4), (5, 6)}


def test_flood_splits_at_the_saddle_and_wraps(spark):
    line = np.array([[[5.0, 4, 1, 3, 6, 2, 2, 2, 4, 5]]])
    seeds_ = spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 2, 0.0, 4.0)], "frame int, feature long, hdim_1 double, hdim_2 double")
    shape = {"hdim_1": 1, "hdim_2": 10}
    got = {p: sorted(r.hdim_2 for r in segment(seeds_, from_array(spark, line), shape, 0.5, pbc=p)[0].where("feature = 1").collect()) for p in ("none", "hdim_2")}
    assert got["none"][:2] == [0, 1] and 9 in got["hdim_2"] and 8 in got["hdim_2"] and 9 not in got["none"]


def test_seeds(spark):
    two = spark.createDataFrame([(0, 1, 10.0, 10.0), (0, 2, 12.0, 10.0), (0, 3, 10.4, 9.6)], "frame int, feature long, hdim_1 double, hdim_2 double")
    assert {(r.hdim_1, r.hdim_2): r.feature for r in seeds(two, SQUARE).collect()} == {(10, 10): 3, (12, 10): 2}
    box = {(r.hdim_1, r.hdim_2): r.feature for r in seeds(two.where("feature < 3"), SQUARE, "box", 3).collect()}
    assert box[11, 10] == 2 and box[9, 9] == 1 and box[13, 11] == 2


L1 = ([85, 15, 95, 5, 5, 95, 15, 85], [0, 0, 1, 1, 2, 2, 3, 3])


@pytest.mark.parametrize(("method", "period", "want"), [("random", None, [1, 2, 1, 2, 2, 1, 2, 1]), ("random", {"hdim_1": 100}, [1, 2, 1, 2, 2, 1, 2, 1]), ("predict", None, [1, 2, 1, 2, 3, 4, 3, 4]), ("predict", {"hdim_1": 100}, [1, 2, 1, 2, 1, 2, 1, 2])])
def test_links_of_the_crossing_pair(spark, method, period, want):
    points = [(k + 1, f, float(h), 50.0 if k % 2 == 0 else 45.0) for k, (h, f) in enumerate(zip(*L1, strict=True))]
    rows = spark.createDataFrame(points, "feature long, frame int, hdim_1 double, hdim_2 double").withColumn("time", F.expr("timestamp_ntz '2000-01-01' + make_dt_interval(0, 0, 5 * frame)"))
    got = tracks.link(rows, 1, 1, d_max=10, method=method, period=period).orderBy("feature").collect()
    assert [r.cell for r in got] == want


def test_distributed_links_equal_links_in_order(spark):
    rng = np.random.default_rng(8)
    rows = [(k, int(f), float(a), float(b)) for k, (f, a, b) in enumerate(zip(rng.integers(0, 6, 120), rng.random(120) * 30, rng.random(120) * 30, strict=True))]
    t = spark.createDataFrame(rows, "feature long, frame int, hdim_1 double, hdim_2 double").withColumn("time", F.expr("timestamp_ntz '2022-01-01' + make_dt_interval(frame)"))
    whole = tracks.number_cells(t.join(tracks._link_in_order(t.select("feature", "frame", "hdim_1", "hdim_2"), ["hdim_1", "hdim_2"], 4.0, None, False, 0), "feature"))
    a = {r.feature: r.cell for r in tracks.link(t, 1, 1, d_max=4.0).collect()}
    assert a == {r.feature: r.cell for r in whole.collect()}


def test_link_arguments_and_stubs(spark):
    jump = spark.createDataFrame([(1, 0, 0.0, 0.0), (2, 1, 50.0, 50.0)], "feature long, frame int, hdim_1 double, hdim_2 double").withColumn("time", F.expr("timestamp_ntz '2022-01-01' + make_dt_interval(frame)"))
    got = tracks.link(jump, 1, 1, d_max=40, time_cell_min=2).collect()
    assert [(r.cell, r.time_cell) for r in got] == [(-1, None)] * 2
    for bad in ({}, {"d_max": 1, "extrapolate": 1}, {"d_max": 1, "adaptive_step": 0.9}, {"d_max": 1, "v_max": 1}):
        with pytest.raises((ValueError, NotImplementedError)):
            tracks.link(jump, 1, 1, **bad)


def test_memory_bridges_a_gap(spark):
    t = spark.createDataFrame([(1, 0, 0.0, 0.0), (2, 1, 0.0, 1.0), (3, 3, 0.0, 2.0)], "feature long, frame int, hdim_1 double, hdim_2 double").withColumn("time", F.expr("timestamp_ntz '2022-01-01' + make_dt_interval(frame)"))
    cells = lambda m: [r.cell for r in tracks.link(t, 1, 1, d_max=2, memory=m).orderBy("feature").collect()]
    assert cells(1) == [1, 1, 1] and cells(0) == [1, 1, 2]


def cells_of(spark, rows):
    t = spark.createDataFrame(rows, "feature long, cell int, frame int, hdim_1 double, hdim_2 double")
    return t.withColumn("time", F.expr("timestamp_ntz '2022-01-01' + make_dt_interval(frame)"))


def test_merge_split_over_a_periodic_edge_and_with_gaps(spark):
    edge = cells_of(spark, [(1, 1, 0, 1.0, 50.0), (2, 1, 1, 1.0, 50.0), (3, 2, 0, 95.0, 50.0), (4, 2, 1, 99.0, 50.0), (5, -1, 0, 1.0, 1.0)])
    count = lambda **k: tracks.merge_split(edge, 1, distance_max=5, **k)["track"].count()
    assert [count(), count(period={"hdim_1": 100}), count(period={"hdim_2": 100}), count(period={"hdim_1": 100, "hdim_2": 100})] == [2, 1, 2, 1]
    features = {r.feature: r.feature_parent_track_id for r in tracks.merge_split(edge, 1, distance_max=5)["feature"].collect()}
    assert features[5] == -1 and features[1] == features[2] == 1
    gap = cells_of(spark, [(1, 1, 0, 1.0, 1.0), (2, 1, 1, 1.0, 1.0), (3, 2, 3, 1.0, 1.0), (4, 2, 4, 1.0, 1.0)])
    ends = lambda n: tracks.merge_split(gap, 1, 5, n, frame_rule="end_to_start")["track"].count()
    assert (ends(1), ends(2)) == (2, 1)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert set(got.values()) == {0, 100} and got[60] == 0 and got[101] == 100


def test_velocity_and_neighbours(spark):
    t = spark.createDataFrame([(1, 1, 0, 0.0, 0.0), (2, 1, 1, 0.0, 600.0), (3, 2, 0, 0.0, 1000.0), (4, 2, 1, 0.0, 1900.0), (5, -1, 1, 9.0, 9.0)], "feature long, cell int, frame int, y double, x double").withColumn("time", F.expr("timestamp_ntz '2022-01-01' + make_dt_interval(0, 0, frame)"))
    v = {r.feature: r.v for r in analysis.velocity(t).collect()}
    assert v == {1: 10.0, 2: None, 3: 15.0, 4: None, 5: None}
    near = {r.feature: r.min_distance for r in analysis.nearest_neighbour(t.where("feature < 5"), ("y", "x")).collect()}
    assert near == {1: 1000.0, 3: 1000.0, 2: 1300.0, 4: 1300.0}
    assert near == {r.feature: r.min_distance for r in analysis.nearest_neighbour(t.where("feature < 5"), ("y", "x"), within=2000.0).collect()}


def test_histogram_follows_half_open_bins(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, 2.0, 2.5, -1.0, float("nan"), None)], "v double")
    h = scalar.histogram(df, "v", [0.0, 1.0, 2.0, 2.5], density=True).orderBy("bin").collect()
    assert [r["count"] for r in h] == [1, 1, 2] and h[2].density == pytest.approx(1.0)


def test_statistics_callables_defaults_and_collapse(spark):
    mask = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 1, 1), (0, 1, 1, 2)], "frame int, hdim_1 int, hdim_2 int, feature long")
    cells = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, 3.0), (0, 1, 1, 5.0)], "frame int, hdim_1 int, hdim_2 int, value double")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "feature long")
    got = {r.feature: (r.mean, r.spread, r.p50) for r in stats.statistics(ids, mask, cells, {"mean": "mean", "spread": (np.percentile, {"q": 100}), "p50": "percentile:50"}, default=-1.0).collect()}
    assert got == {1: (2.0, 3.0, 2.0), 2: (5.0, 5.0, 5.0), 3: (-1.0, -1.0, -1.0)}
    column = cells.groupBy("frame", "hdim_2").agg(F.sum("value").alias("value"))
    flat = {r.feature: r.total for r in stats.statistics(ids, mask, column, {"total": "sum"}, collapse=["hdim_1"]).collect()}
    assert flat == {1: 9.0, 2: 8.0, 3: None}


def test_combining_renumbers_and_rejects_repeats(spark):
    a = spark.createDataFrame([(0, 1, 1)], "frame int, idx int, feature long").withColumn("time", F.expr("timestamp_ntz '2022-01-01'"))
    b = spark.createDataFrame([(0, 1, 1)], "frame int, idx int, feature long").withColumn("time", F.expr("timestamp_ntz '2022-01-02'"))
    got = tables.combine([b, a], old_column="old").orderBy("feature").collect()
    assert [(r.frame, r.feature, r.old) for r in got] == [(0, 1, 1), (1, 2, 1)]
    with pytest.raises(ValueError):
        tables.combine([a, b], renumber=False)


def test_spacings(spark):
    axis = lambda step: spark.createDataFrame([(k, float(k * step)) for k in range(3)], "idx int, value double")
    time = spark.createDataFrame([(0, 0), (1, 25)], "idx int, h int").select("idx", F.expr("timestamp_ntz '2022-01-01' + make_dt_interval(0, h)").alias("value"))
    assert tables.spacings(axis(-50), axis(100), time) == (75.0, 25 * 3600.0)
    assert tables.spacings(axis(-50), axis(100), time, "geometric")[0] == pytest.approx(math.sqrt(5000))


def test_blobs_end_to_end(spark, tmp_path):
    shape = {"hdim_1": 50, "hdim_2": 100}
    cells = synthetic.blobs(spark, 6, shape, synthetic.ONE_2D)
    write_cells(cells, str(tmp_path / "cells"), 2)
    cells = read_cells(spark, str(tmp_path / "cells"))
    features, mask = detect_with_labels(cells, shape, [3.0, 5.0], position="weighted_diff", sigma=0.0)
    linked = tracks.link(features, 60, 1000, v_max=100)
    assert [r.cell for r in linked.collect()] == [1] * 6
    assert slabs(cells, shape).where(F.size("slab") == 5000).count() == 6
    assert mask.select("frame").distinct().count() == 6


def test_streamed_detection_equals_batch(spark, tmp_path):
    from cellweave.streaming.frames import detect_stream

    values = np.random.default_rng(5).random((4, 10, 10))
    shape = {"hdim_1": 10, "hdim_2": 10}
    cells = from_array(spark, values)
    cells.where("frame < 2").write.parquet(str(tmp_path / "in"))
    cells.where("frame >= 2").write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(cells.schema).option("maxFilesPerTrigger", 1000).parquet(str(tmp_path / "in"))
    detect_stream(stream, shape, [0.8], lambda df, n: seen.extend((r.frame, r.num, r.hdim_1) for r in df.collect()), str(tmp_path / "state"), sigma=0.0).awaitTermination()
    want = sorted((r.frame, r.num, r.hdim_1) for r in detect(cells, shape, [0.8], sigma=0.0).collect() if r.frame < 3)
    assert sorted(seen) == want  # the last frame waits for the watermark
