"""The flood, links and points of another grid against plain computations."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions import kernels, scalar
from cellweave.operators import analysis, graph, tables, tracks
from cellweave.operators.detect import detect, smooth, smooth_tiled
from cellweave.operators.segment import segment
from cellweave.sources.grid import from_array


def plain_flood(value, inside, marks, wrap):
    """Repeatedly the highest labelled cell not yet looked at labels its free neighbours."""
    label, done = np.where(inside, marks, 0), set()
    while todo := [p for p in zip(*np.nonzero(label), strict=True) if p not in done]:
        at = max(todo, key=lambda p: value[p])
        done.add(at)
        for axis, step in itertools.product(range(value.ndim), (-1, 1)):
            to = list(at)
            to[axis] += step
            if axis in wrap:
                to[axis] %= value.shape[axis]
            if 0 <= to[axis] < value.shape[axis] and inside[tuple(to)] and not label[tuple(to)]:
                label[tuple(to)] = label[at]
    return label


@pytest.mark.parametrize("shape,pbc,target,far", [((14, 17), "none", "maximum", None), ((14, 17), "both", "maximum", None), ((14, 17), "hdim_1", "minimum", None), ((5, 9, 8), "none", "maximum", None), ((16, 15), "none", "maximum", 2500.0)])
def test_segments_equal_a_plain_flood(spark, shape, pbc, target, far):
    rng = np.random.default_rng(sum(shape))
    axes = {2: ("hdim_1", "hdim_2"), 3: ("vdim", "hdim_1", "hdim_2")}[len(shape)]
    values = rng.permutation(3 * math.prod(shape)).reshape(3, *shape).astype(float)  # no ties
    threshold = float(np.median(values)) + (-200 if target == "maximum" else 200)
    rows, want = [], set()
    for frame in range(3):
        sign = 1 if target == "maximum" else -1
        inside, marks = sign * values[frame] > sign * threshold, np.zeros(shape, int)
        for k in range(6):
            at = tuple(int(rng.integers(n)) for n in shape[-2:])
            rows.append((frame, 10 * frame + k + 1, float(at[0]), float(at[1])))
            marks[(..., *at)] = np.maximum(marks[(..., *at)], 10 * frame + k + 1)
        marks = np.where(inside, marks, 0)
        label = plain_flood(sign * values[frame], inside, marks, tuple(axes.index(a) for a in scalar.periodic_axes(pbc)))
        for at in zip(*np.nonzero(label), strict=True):
            if far is None or min(math.dist(at, m) for m in zip(*np.nonzero(marks), strict=True)) <= math.ceil(far / 1000.0):
                want.add((frame, *map(int, at), int(label[at])))
    features = spark.createDataFrame(rows, "frame int, feature long, hdim_1 double, hdim_2 double")
    mask, sized = segment(features, from_array(spark, values), dict(zip(axes, shape, strict=True)), threshold, target, max_distance=far, dxy=1000.0, pbc=pbc, statistic={"top": "max"})
    got = {(r.frame, *(r[a] for a in axes), r.feature) for r in mask.collect()}
    assert got == want and len({w[-1] for w in want}) > 10
    for r in sized.collect():
        own = [values[w[:-1]] for w in want if w[-1] == r.feature]
        assert (r.ncells, r.top) == (len(own), max(own, default=None))


def best_links(a, b, radius, period):
    """Cheapest set of links between two frames by trying all; an unlinked point costs radius squared."""
    def d2(p, q):
        d = np.abs(np.subtract(p, q))
        return float((np.minimum(d, np.subtract(period, d)) ** 2).sum())

    best, links = math.inf, []
    for to in itertools.product([None, *range(len(b))], repeat=len(a)):
        used = [j for j in to if j is not None]
        if len(set(used)) == len(used) and all(d2(a[i], b[j]) <= radius**2 for i, j in enumerate(to) if j is not None):
            cost = sum(d2(a[i], b[j]) for i, j in enumerate(to) if j is not None) + radius**2 * (len(a) + len(b) - 2 * len(used))
            if cost < best:
                best, links = cost, [(i, j) for i, j in enumerate(to) if j is not None]
    return links


@pytest.mark.parametrize("axes,period", [(2, None), (2, {"hdim_1": 20.0, "hdim_2": 20.0}), (3, None)])
def test_links_equal_all_ways_tried(spark, axes, period):
    rng = np.random.default_rng(40 + axes)
    places = [rng.random((int(rng.integers(3, 6)), axes)) * 20 for _ in range(6)]
    names = ["hdim_1", "hdim_2", "vdim"][:axes]
    features, ids = [], []
    for frame, points in enumerate(places):
        ids.append(range(len(features) + 1, len(features) + 1 + len(points)))
        features += [(frame, i, 0.0, *map(float, p)) for i, p in zip(ids[-1], points, strict=True)]
    table = spark.createDataFrame(features, "frame int, feature long, t double, " + ", ".join(f"{n} double" for n in names)).withColumn("time", F.timestamp_seconds(F.col("frame") * 60)).drop("t")
    chain = {i: i for own in ids for i in own}
    for f in range(5):
        for i, j in best_links(places[f], places[f + 1], 8.0, [np.inf] * axes if period is None else [period[n] for n in names]):
            chain[ids[f + 1][j]] = chain[ids[f][i]]
    want = {frozenset(i for i in chain if chain[i] == c) for c in chain.values()}
    assert any(len(c) > 2 for c in want)
    extra = {"dz": 1.0} if axes == 3 else {}
    cells = {r.feature: r.cell for r in tracks.link(table, 60.0, 1.0, d_max=8.0, period=period, **extra).collect()}
    assert {frozenset(i for i in cells if cells[i] == c) for c in cells.values()} == want


def test_contests_over_the_limit_raise_or_shrink():
    a, b = (x.ravel() for x in np.meshgrid(range(40), range(40), indexing="ij"))
    d = np.where(a == b, 0.1, 1.0 + 0.001 * np.abs(a - b))
    with pytest.raises(ValueError, match="40 features contest"):
        kernels.match_within(a, b, d, 2.0, 30)
    with pytest.raises(ValueError, match="stop"):
        kernels.match_within(a, b, d, 2.0, 30, 0.9, 1.9)
    assert sorted(kernels.match_within(a, b, d, 2.0, 30, 0.5, 0.2)) == [(k, k) for k in range(40)]
    assert kernels.match_within(a[:0], b[:0], d[:0], 2.0, 30) == []


@pytest.mark.parametrize("method,memory", [("predict", 0), ("random", 1)])
def test_links_in_order_keep_the_limit(spark, method, memory):
    rows = [(f, 40 * f + k + 1, 0.05 * k, 0.1 * f) for f in range(2) for k in range(40)]
    table = spark.createDataFrame(rows, "frame int, feature long, hdim_1 double, hdim_2 double").withColumn("time", F.timestamp_seconds(F.col("frame") * 60))
    with pytest.raises(Exception, match="contest"):
        tracks.link(table, 60.0, 1.0, d_max=5.0, method=method, memory=memory).collect()


def test_points_of_another_grid_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    grid = [(i, j, float(la), float(lo)) for i, la in enumerate(np.linspace(-90, 90, 61)) for j, lo in enumerate(np.linspace(-180, 177, 120))]
    where = [(float(la), float(lo)) for la, lo in zip(np.r_[rng.uniform(-90, 90, 150), rng.uniform(85, 90, 50), rng.uniform(-90, -86, 50)], rng.uniform(-180, 360, 250), strict=True)]
    where += [(10.0, 179.9), (0.0, -179.99), (89.99, 10.0), (-89.99, 0.0)]
    features = spark.createDataFrame([(k + 1, 0, 0.0, 0.0, *p) for k, p in enumerate(where)], "feature long, frame int, hdim_1 double, hdim_2 double, latitude double, longitude double")
    limit = 150000.0
    g = np.radians(np.array([x[2:] for x in grid]))
    want = {}
    for k, p in enumerate(where):
        la, lo = np.radians(p)
        h = np.sin((g[:, 0] - la) / 2) ** 2 + np.cos(la) * np.cos(g[:, 0]) * np.sin((g[:, 1] - lo) / 2) ** 2
        d = 2 * 6371000.0 * np.arcsin(np.sqrt(np.clip(h, 0, 1)))
        if d.min() <= limit:
            want[k + 1] = d.min()
    got = {r.feature: (int(r.hdim_1), int(r.hdim_2)) for r in tables.transform_points(features, spark.createDataFrame(grid, "hdim_1 int, hdim_2 int, latitude double, longitude double"), limit).collect()}
    assert set(got) == set(want) and len(got) > 100
    for k, (i, j) in got.items():
        la, lo = np.radians(where[k - 1])
        x, y = g[i * 120 + j]
        h = math.sin((x - la) / 2) ** 2 + math.cos(la) * math.cos(x) * math.sin((y - lo) / 2) ** 2
        assert 2 * 6371000.0 * math.asin(math.sqrt(min(h, 1))) == pytest.approx(want[k], abs=1e-3)


@pytest.mark.parametrize("kind", ["xy", "latlon"])
def test_overlap_of_cells_equals_all_pairs_and_moves_none(spark, kind):
    rng = np.random.default_rng(21)
    rows = []
    for cell in range(-1, 700):  # lives of 1 to 9 of 90 frames, 0 to 2 rows in a frame, some without a place
        born = int(rng.integers(0, 90))
        for t in range(born, born + int(rng.integers(1, 10))):
            for _ in range(int(rng.choice([0, 1, 1, 1, 2]))):
                rows.append((t, cell, *(None if rng.random() < 0.02 else float(v) for v in rng.uniform(0, 60, 2))))
    table = spark.createDataFrame(rows, "t int, cell int, u double, v double").withColumn("time", F.timestamp_seconds(F.col("t") * 60).cast("timestamp_ntz"))
    want: dict = {}
    for t, a, y, x in rows:
        for s, b, y2, x2 in rows if a >= 0 and a % 2 == 0 else ():
            if s == t and b % 2 == 1 and b >= 0:
                found = want.setdefault((a, b), [0, []])
                found[0] += 1
                if None not in (y, x, y2, x2):
                    p, q = math.radians(y), math.radians(y2)
                    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(x2 - x) / 2) ** 2
                    found[1].append(1 / (1 + (math.hypot(y - y2, x - x2) / 1000 if kind == "xy" else 2 * 6378.0 * math.asin(math.sqrt(min(h, 1))))))
    least = sorted(sum(v) for _, v in want.values())[len(want) // 3]
    kept = {k: (n, sum(v), sum(v) / len(v)) for k, (n, v) in want.items() if v and sum(v) >= least - 1e-9}
    out = analysis.overlap(table.where("cell % 2 = 0"), table.where("cell % 2 = 1"), ("u", "v"), kind, least - 1e-9)
    got = {(r.cell_1, r.cell_2): (r.n_common, r.inverse_distance_sum, r.inverse_distance_mean) for r in out.collect()}
    assert set(got) == set(kept) and len(kept) > 1000
    assert all(got[k] == pytest.approx(kept[k], rel=1e-9) for k in kept)
    above = out._jdf.queryExecution().executedPlan().toString().split("FlatMapCoGroups")
    assert len(above) > 1 and "Exchange" not in above[0]
    assert analysis.overlap(table.where("cell < -1"), table, ("u", "v"), kind).count() == 0


@pytest.mark.parametrize("last", [40, 1 << 20])
def test_flags_of_a_dense_family_equal_kruskal(spark, monkeypatch, last):
    monkeypatch.setattr(graph, "LAST_EDGES", last)  # 40: one task never holds more edges at the end
    rng = np.random.default_rng(4)
    ends = [(cell, int(f), int(f + n), *(float(v) for v in rng.integers(0, 12, 4) / 2)) for cell, (f, n) in enumerate(zip(rng.integers(0, 9, 200), rng.integers(1, 4, 200), strict=True), 1)]
    rows = [(2 * c + k, c, (f, g)[k], *p[2 * k : 2 * k + 2]) for c, f, g, *p in ends for k in (0, 1)]
    table = spark.createDataFrame(rows, "feature long, cell int, frame int, hdim_1 double, hdim_2 double").withColumn("time", F.timestamp_seconds("frame"))
    edges = [(math.hypot(a[5] - b[3], a[6] - b[4]) + 0.01, a[0], b[0]) for a in ends for b in ends if a is not b and abs(a[1] - b[2]) <= 2]
    root = {c: c for c, *_ in ends}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    edges, starts, merges = sorted(e for e in edges if e[0] <= 1.01), set(), set()
    for _, a, b in edges:
        x, y = sorted((find(a), find(b)))
        if x != y:
            root[y] = x
            starts.add(a)
            merges.add(b)
    order = sorted({find(c) for c in root})
    got = {r.cell: (r.cell_parent_track_id, r.cell_starts_with_split, r.cell_ends_with_merge) for r in tracks.merge_split(table, 1.0, 1.0, 2)["cell"].collect()}
    assert len(edges) > 1000 and got == {c: (order.index(find(c)) + 1, c in starts, c in merges) for c in root}


def test_detection_smooths_by_default_and_adds_statistics(spark):
    values = np.random.default_rng(12).random((2, 12, 15)) * 10
    shape, cells = {"hdim_1": 12, "hdim_2": 15}, from_array(spark, values)
    soft = {(r.frame, r.hdim_1, r.hdim_2): r.value for r in smooth(cells, shape, 0.5).collect()}
    assert all(r.value == pytest.approx(soft[r.frame, r.hdim_1, r.hdim_2]) for r in smooth_tiled(cells, shape, 0.5).collect())
    key = lambda df: sorted((r.frame, r.num, round(r.hdim_1, 6), round(r.hdim_2, 6), round(r.top, 6)) for r in df.collect())
    found = detect(cells, shape, 6.0, statistic={"top": "max"})
    assert key(found) == key(detect(cells, shape, 6.0, sigma=0.5, tile=5, statistic={"top": "max"}))
    assert {round(r.top, 6) for r in found.collect()} <= {round(v, 6) for v in soft.values()}
    raw = detect(cells, shape, 6.0, statistic={"top": "max"}, statistics_unsmoothed=True)
    assert {r.top for r in raw.collect()} <= set(values.ravel().tolist())


def test_periodic_boxes(spark):
    rows = spark.createDataFrame([(-3, 5), (2, 6), (8, 12), (-1, 11)], "a int, b int")
    for periodic, want in ((True, [[(0, 5), (7, 10)], [(2, 6)], [(8, 10), (0, 2)], [(0, 10)]]), (False, [[(0, 5)], [(2, 6)], [(8, 10)], [(0, 10)]])):
        got = [[(x.start, x.stop) for x in r.box] for r in rows.select(scalar.periodic_boxes("a", "b", 10, periodic).alias("box")).collect()]
        assert got == want
