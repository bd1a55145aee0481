"""Numpy kernels over one group: labelling, flooding, assignment, smoothing and cosine transforms."""

from __future__ import annotations

import heapq
import itertools

import numpy as np

from .scalar import EARTH_RADIUS_KM


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lowest member of the component of each of n nodes, by edges a - b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            break
    return label


def half_offsets(dims: int, full: bool = True) -> list[tuple[int, ...]]:
    """One of each pair of opposite steps to a neighbour: all neighbours, or those over a face."""
    every = [o for o in itertools.product((-1, 0, 1), repeat=dims) if any(o) and (full or sum(map(abs, o)) == 1)]
    return [o for o in every if o > (0,) * dims]


def label_cells(index: np.ndarray, shape: tuple[int, ...], periodic: tuple[int, ...] = ()) -> np.ndarray:
    """Component of each listed cell: the lowest raveled id in it.

    index: [cell, dim]. All neighbours connect. Over a periodic edge only cells straight across do,
    and with two periodic axes opposite corners.
    """
    pid = np.ravel_multi_index(index.T, shape) if len(index) else np.zeros(0, np.int64)
    order = np.argsort(pid)
    ranked = pid[order]
    a, b = [], []

    def join(src: np.ndarray, to: np.ndarray) -> None:
        want = np.ravel_multi_index(to.T, shape)
        at = np.searchsorted(ranked, want)
        hit = (at < len(ranked)) & (ranked[np.minimum(at, len(ranked) - 1)] == want)
        a.append(src[hit])
        b.append(order[at[hit]])

    everyone = np.arange(len(index))
    for offset in half_offsets(len(shape)) if len(index) else ():
        to = index + np.array(offset)
        ok = ((to >= 0) & (to < np.array(shape))).all(axis=1)
        join(everyone[ok], to[ok])
    sets = [(p,) for p in periodic] + ([tuple(periodic)] if len(periodic) == 2 else [])
    for axes in sets if len(index) else ():
        edge = np.ones(len(index), bool)
        to = index.copy()
        for axis in axes:
            edge &= (index[:, axis] == 0) | (index[:, axis] == shape[axis] - 1)
            to[:, axis] = np.where(index[:, axis] == 0, shape[axis] - 1, 0)
        join(everyone[edge], to[edge])
    if not len(index):
        return pid
    root = components(len(index), np.concatenate(a), np.concatenate(b))
    low = np.full(len(index), np.iinfo(np.int64).max)
    np.minimum.at(low, root, pid)
    return low[root]


def flood(value: np.ndarray, inside: np.ndarray, markers: np.ndarray, periodic: tuple[int, ...] = ()) -> np.ndarray:
    """Watershed from markers over the inside cells, highest value first, first come first served.

    Neighbours share a face; on a periodic axis the edges meet.
    """
    out = np.where(inside, markers, 0)
    steps = [s for s in itertools.product((-1, 0, 1), repeat=value.ndim) if sum(map(abs, s)) == 1]
    queue, age = [], itertools.count()
    for at in zip(*np.nonzero(out), strict=True):
        heapq.heappush(queue, (-value[at], next(age), at))
    while queue:
        _, _, at = heapq.heappop(queue)
        for step in steps:
            to = [p + s for p, s in zip(at, step, strict=True)]
            for axis, n in enumerate(value.shape):
                if axis in periodic:
                    to[axis] %= n
            if all(0 <= p < n for p, n in zip(to, value.shape, strict=True)):
                to = tuple(to)
                if inside[to] and not out[to]:
                    out[to] = out[at]
                    heapq.heappush(queue, (-value[to], next(age), to))
    return out


def near_markers(marked: np.ndarray, reach: int) -> np.ndarray:
    """Whether a marked cell stands within ``reach``: squared distances are lowered axis by axis, exact up to the reach."""
    far = np.where(marked, 0.0, np.inf)
    for axis, n in enumerate(marked.shape):
        low = far.copy()
        for k in range(1, min(reach, n - 1) + 1):
            head, tail = [slice(None)] * far.ndim, [slice(None)] * far.ndim
            head[axis], tail[axis] = slice(None, -k), slice(k, None)
            head, tail = tuple(head), tuple(tail)
            low[head] = np.minimum(low[head], far[tail] + k * k)
            low[tail] = np.minimum(low[tail], far[head] + k * k)
        far = low
    return far <= reach * reach


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row in the cheapest complete assignment of rows (rows <= columns); potentials and augmenting paths."""
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while match[j0]:
            used[j0] = True
            free = ~used[1:]
            reduced = cost[match[j0] - 1] - u[match[j0]] - v[1:]
            better = free & (reduced < least[1:])
            least[1:][better] = reduced[better]
            way[1:][better] = j0
            j1 = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[1:][free] -= delta
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = np.zeros(n, int)
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def match_points(d2: np.ndarray, radius: float) -> list[tuple[int, int]]:
    """Pairs (row, column) within the radius that minimise the sum of squared distances; one left alone costs radius squared."""
    n, m = d2.shape
    big = 1e12
    cost = np.full((n + m, n + m), 0.0)
    cost[:n, :m] = np.where(d2 <= radius * radius, d2, big)
    cost[:n, m:] = np.where(np.eye(n, dtype=bool), radius * radius, big)
    cost[n:, :m] = np.where(np.eye(m, dtype=bool), radius * radius, big)
    got = assign(cost)
    return [(i, int(got[i])) for i in range(n) if got[i] < m and d2[i, got[i]] <= radius * radius]


def match_within(a: np.ndarray, b: np.ndarray, d: np.ndarray, reach: float, most: int, step: float | None = None, stop: float | None = None) -> list[tuple[int, int]]:
    """Links among candidate pairs (a, b) at distance d: the cheapest assignment in each contest.

    A contest with more than ``most`` features on a side raises, or is tried again within ``step`` times
    the reach, down to ``stop``.
    """
    near = d <= reach
    left, x = np.unique(a[near], return_inverse=True)
    right, y = np.unique(b[near], return_inverse=True)
    if not len(x):
        return []
    d, node = d[near], components(len(left) + len(right), x, y + len(left))
    order = np.argsort(node[x], kind="stable")
    bounds = np.flatnonzero(np.diff(node[x][order], prepend=-1, append=-1))
    links = []
    for own in (order[i:j] for i, j in itertools.pairwise(bounds)):
        rows, r = np.unique(x[own], return_inverse=True)
        cols, k = np.unique(y[own], return_inverse=True)
        largest = max(len(rows), len(cols))
        if largest > most:
            if step is None:
                raise ValueError(f"{largest} features contest their links, more than {most}; shorten the search radius or use adaptive search")
            if reach * step < stop:
                raise ValueError("adaptive search reached its stop with too many contested features")
            links += match_within(left[x[own]], right[y[own]], d[own], reach * step, most, step, stop)
            continue
        d2 = np.full((len(rows), len(cols)), np.inf)
        d2[r, k] = d[own] ** 2
        links += [(left[rows[i]], right[cols[j]]) for i, j in match_points(d2, reach)]
    return links


def gaussian_weights(sigma: float, truncate: float = 4.0) -> np.ndarray:
    reach = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return w / w.sum()


def gaussian(field: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing along every axis, borders reflected (the edge cell repeated)."""
    if sigma <= 0:
        return field
    w = gaussian_weights(sigma)
    reach = len(w) // 2
    out = field.astype(float)
    for axis in range(field.ndim):
        n = out.shape[axis]
        at = np.arange(-reach, n + reach) % (2 * n)
        at = np.where(at >= n, 2 * n - 1 - at, at)
        wide = np.take(out, at, axis=axis)
        out = sum(k * np.take(wide, np.arange(i, i + n), axis=axis) for i, k in enumerate(w))
    return out


def cosine_matrix(n: int) -> np.ndarray:
    """Orthonormal DCT-II as a matrix; its transpose inverts it."""
    k, x = np.arange(n)[:, None], np.arange(n)[None]
    out = np.cos(np.pi * k * (2 * x + 1) / (2 * n)) * np.sqrt(2 / n)
    out[0] /= np.sqrt(2)
    return out


def band_pass(shape: tuple[int, int], dxy: float, short: float, long: float, order: int = 2) -> np.ndarray:
    """Amplitude of a digital Butterworth band-pass from wavelength short to long at each cosine mode.

    In closed form: the bilinear transform maps a frequency f to tan(pi f dxy), and the band-pass to
    a low-pass at (w * w - w1 * w2) / (w * (w2 - w1)).
    """
    m, n = (np.arange(k) / k for k in shape)
    frequency = np.sqrt(m[:, None] ** 2 + n[None] ** 2) / (2 * dxy)
    w = np.tan(np.pi * dxy * frequency)
    w1, w2 = np.tan(np.pi * dxy / long), np.tan(np.pi * dxy / short)
    with np.errstate(divide="ignore", over="ignore"):
        x = (w * w - w1 * w2) / (w * (w2 - w1))
        return 1 / np.sqrt(1 + x ** (2 * order))


def spectral(field: np.ndarray, dxy: float, short: float, long: float) -> np.ndarray:
    """A 2-D field with only the wavelengths of the band left."""
    a, b = (cosine_matrix(n) for n in field.shape)
    return a.T @ ((a @ field @ b.T) * band_pass(field.shape, dxy, short, long)) @ b


def nearness(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], n_a: int, n_b: int, kind: str = "xy") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair of n_a and n_b cells: rows that share a time, those with a distance, and their sum of 1 / (1 + km).

    a, b: cell, time (both numbered from 0), y and x of each row; a NaN coordinate has no distance.
    """
    shared, known, total = (np.zeros((n_a, n_b)) for _ in range(3))
    times = np.intersect1d(a[1], b[1])
    sides = []
    for side in (a, b):
        cell, time, *place = (v[np.argsort(side[1], kind="stable")] for v in side)
        place = np.array([np.radians(v) if kind == "latlon" else v / 1000 for v in place])
        sides.append((cell, place, ~np.isnan(place).any(axis=0), np.searchsorted(time, times), np.searchsorted(time, times, "right")))
    for first in range(0, len(times), 64):
        at = range(first, min(first + 64, len(times)))
        # counts by (cell, time) of all rows and of those with a place: their products count the pairs
        counts = []
        for (cell, _, there, lo, hi), n in zip(sides, (n_a, n_b), strict=True):
            rows = np.concatenate([np.arange(lo[t], hi[t]) for t in at])
            column = np.repeat(np.arange(len(at)), [hi[t] - lo[t] for t in at])
            every, placed = np.zeros((n, len(at))), np.zeros((n, len(at)))
            np.add.at(every, (cell[rows], column), 1)
            np.add.at(placed, (cell[rows], column), there[rows])
            counts.append((every, placed))
        shared += counts[0][0] @ counts[1][0].T
        known += counts[0][1] @ counts[1][1].T
        for k, t in enumerate(at):
            (i, p), (j, q) = ((cell[lo[t] : hi[t]][there[lo[t] : hi[t]]], place[:, lo[t] : hi[t]][:, there[lo[t] : hi[t]]]) for cell, place, there, lo, hi in sides)
            once = all(c[1][:, k].max() <= 1 for c in counts)
            for part in range(0, len(i), 64):  # so few rows that all steps stay in the processor's cache
                own, (y, x) = i[part : part + 64], p[:, part : part + 64, None]
                d, e = q[0] - y, q[1] - x
                if kind == "latlon":
                    d, e = np.sin(d / 2) ** 2, np.sin(e / 2) ** 2
                    d = 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.minimum(d + np.cos(y) * np.cos(q[0]) * e, 1.0)))
                else:
                    np.multiply(d, d, out=d)
                    np.multiply(e, e, out=e)
                    np.add(d, e, out=d)
                    np.sqrt(d, out=d)
                np.add(d, 1, out=d)
                np.reciprocal(d, out=d)
                if once:
                    total[own[:, None], j] += d
                else:
                    np.add.at(total, (own[:, None], j), d)
    return shared, known, total


def spanning_forest(a: np.ndarray, b: np.ndarray, w: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Positions of the edges u - v in the minimum spanning forest, by w, then a, then b."""
    rank = np.lexsort((b, a, w))
    names, ends = np.unique(np.concatenate([u[rank], v[rank]]), return_inverse=True)
    x, y = np.split(ends.ravel(), 2)
    at, chosen, n = np.arange(len(rank)), [], len(names)
    while True:
        apart = x != y
        x, y, at = x[apart], y[apart], at[apart]
        if not len(at):
            break
        # edges stand in order: the first at a node is its lightest
        first = np.full(n, len(at))
        first[x[::-1]] = np.arange(len(at))[::-1]
        other = np.full(n, len(at))
        other[y[::-1]] = np.arange(len(at))[::-1]
        least = np.unique(np.minimum(first, other))
        least = least[least < len(at)]
        chosen.append(at[least])
        label = components(n, x[least], y[least])
        x, y = label[x], label[y]
    return np.sort(rank[np.concatenate(chosen)]) if chosen else np.zeros(0, np.int64)
