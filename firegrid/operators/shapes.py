"""Shapes: dissolve, simplification, buffered hulls, inner points and areas.

Rings are array<struct<lon,lat>>, closed; polygons are arrays of rings.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from firegrid.functions.geo import _A, _F, convex_hull, geodesic_direct, ring_area_km2

RING = "array<struct<lon:double,lat:double>>"
HALF_PIXEL_M = 190
_E2 = _F * (2 - _F)


def _ring(points: np.ndarray) -> list[dict]:
    return [{"lon": float(x), "lat": float(y)} for x, y in points]


def _array(ring) -> np.ndarray:
    return np.array([(p["lon"], p["lat"]) for p in ring], float).reshape(-1, 2)


def valid_rings(rings: Column) -> Column:
    """Rings without repeated neighbours, closed, and with at least four points; others are dropped."""

    def cleaned(ring: Column) -> Column:
        once = F.filter(ring, lambda p, i: (i == 0) | (F.get(ring, i - 1) != p))
        return F.when(F.get(once, F.lit(0)) == F.element_at(once, -1), once).otherwise(F.concat(once, F.slice(once, 1, 1)))

    return F.filter(F.transform(rings, cleaned), lambda r: F.size(r) >= 4)


def dissolve(areas: DataFrame, key: str) -> DataFrame:
    """(key, rings): the outline of all areas of a key, for areas that share exact vertices.

    Edges that two areas of a key share cancel out, which is a distributed count; only the
    outline's edges of a key meet in one task, where they are chained into rings.
    """
    points = areas.select(key, F.explode("rings").alias("ring"))
    edges = points.select(key, F.explode(F.arrays_zip(F.slice("ring", 1, F.size("ring") - 1).alias("a"), F.slice("ring", 2, F.size("ring") - 1).alias("b"))).alias("e")).select(key, "e.a", "e.b")
    low, high = F.least("a", "b"), F.greatest("a", "b")
    outline = edges.groupBy(key, low.alias("low"), high.alias("high")).agg(F.count("*").alias("n"), F.first("a").alias("a"), F.first("b").alias("b")).filter("n % 2 = 1")
    flat = outline.select(key, F.col("a.lon").alias("x0"), F.col("a.lat").alias("y0"), F.col("b.lon").alias("x1"), F.col("b.lat").alias("y1"))

    def chained(pdf: pd.DataFrame) -> pd.DataFrame:
        follow: dict[tuple, list[tuple]] = {}
        for r in pdf.sort_values(["x0", "y0", "x1", "y1"]).itertuples():
            follow.setdefault((r.x0, r.y0), []).append((r.x1, r.y1))
        rings = []
        while follow:
            start = min(follow)
            ring, at = [start], start
            while at in follow:
                nxt = follow[at].pop()
                if not follow[at]:
                    del follow[at]
                ring.append(nxt)
                at = nxt
                if at == start:
                    break
            rings.append(_ring(np.array(ring)))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "rings": [rings]})

    kind = dict(areas.dtypes)[key]
    return flat.groupBy(key).applyInPandas(chained, f"{key} {kind}, rings array<{RING}>")


def douglas_peucker(points: np.ndarray, tolerance: float) -> np.ndarray:
    """The points of an open line that a tolerance needs, without recursion."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    stack = [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d = points[b] - points[a]
        inner = points[a + 1 : b] - points[a]
        length = math.hypot(*d)
        off = np.abs(d[0] * inner[:, 1] - d[1] * inner[:, 0]) / length if length else np.hypot(inner[:, 0], inner[:, 1])
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


def simplify(rings: str, tolerance: float = 0.001) -> Column:
    """A column of rings by Douglas-Peucker; a ring that would lose its area stays as it is."""

    def run(column: pd.Series) -> pd.Series:
        out = []
        for polygon in column:
            done = []
            for ring in polygon:
                pts = _array(ring)
                far = int(((pts - pts[0]) ** 2).sum(axis=1).argmax()) if len(pts) else 0
                small = np.concatenate([douglas_peucker(pts[: far + 1], tolerance), douglas_peucker(pts[far:], tolerance)[1:]]) if 0 < far < len(pts) - 1 else pts
                done.append(_ring(small if len(small) >= 4 else pts))
            out.append(done)
        return pd.Series(out)

    return F.pandas_udf(run, f"array<{RING}>")(rings)


def _buffers(hulls: list[np.ndarray], metres: float, corners: int) -> list[np.ndarray]:
    """The closed rings `metres` outside convex hulls (counter-clockwise): arcs of geodesics around their vertices.

    An arc spans the turn between the outward normals of the edges before and after its vertex, so
    its points have that vertex as the hull's nearest place; the arcs are joined by lines. All arcs of all hulls are reckoned in one go.
    """
    if not hulls:
        return []
    sizes = np.array([len(h) for h in hulls])
    at, first = np.vstack(hulls), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    follow, lead = np.arange(1, len(at) + 1), np.arange(-1, len(at) - 1)
    follow[first + sizes - 1], lead[first] = first, first + sizes - 1
    after = at[follow] - at
    # Metres a degree at each vertex: along the meridian and along the parallel.
    bend = 1 - _E2 * np.sin(np.radians(at[:, 1])) ** 2
    north = _A * (1 - _E2) / bend**1.5
    east = _A * np.cos(np.radians(at[:, 1])) / np.sqrt(bend)
    # Azimuths of the outward normals: to the right of the way round.
    normal = lambda way: np.array([math.atan2(x, y) for x, y in zip((way[:, 0] * east).tolist(), (way[:, 1] * north).tolist(), strict=True)]) + math.pi / 2
    start, end = normal(after[lead]), normal(after)
    turn = (start - end) % (2 * math.pi)
    steps = np.maximum(1, np.ceil(turn / (2 * math.pi) * corners)).astype(int)
    lone = sizes == 1
    alone = first[lone]
    start[alone], turn[alone], steps[alone] = 0.0, 2 * math.pi, corners
    points = steps + 1
    points[alone] = corners
    vertex = np.repeat(np.arange(len(at)), points)
    place = np.arange(len(vertex)) - np.repeat(np.cumsum(points) - points, points)
    x, y = geodesic_direct(at[vertex, 0], at[vertex, 1], start[vertex] - turn[vertex] * place / steps[vertex], metres)
    rings = np.split(np.column_stack([x, y]), np.cumsum(np.add.reduceat(points, first))[:-1])
    return [np.vstack([r, r[:1]]) for r in rings]


def _buffer(hull: np.ndarray, metres: float, corners: int) -> np.ndarray:
    return _buffers([hull], metres, corners)[0]


def buffered_hull(lon: str, lat: str, metres: float = HALF_PIXEL_M, corners: int = 32) -> Column:
    """Ring of points at `metres` from the convex hull of two arrays of coordinates, by geodesics; `corners` points a full turn. Empty arrays give null."""

    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        hulls = [convex_hull(np.column_stack([x, y])) if x is not None and len(x) else None for x, y in zip(xs, ys, strict=True)]
        rings = iter(_buffers([h for h in hulls if h is not None], metres, corners))
        return pd.Series([None if h is None else _ring(next(rings)) for h in hulls])

    return F.pandas_udf(run, RING)(lon, lat)


def buffered_groups(points: DataFrame, key: str, metres: float = HALF_PIXEL_M) -> DataFrame:
    """(key, ring): the buffered hull of every group of `points` (key, longitude, latitude).

    Points are sorted into ranges of (key, place), so a large group lies in many tasks and a task reads many small ones;
    each batch gives one hull a key, and hulls of hulls are the hull.
    """
    kind = dict(points.dtypes)[key]

    def local(batches):
        for batch in batches:
            code = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
            starts = np.flatnonzero(np.diff(code, prepend=-1))
            places = np.column_stack([batch.column(k).to_numpy() for k in (1, 2)])
            hulls = [convex_hull(x) for x in np.split(places, starts[1:])] if len(starts) else []
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(starts)), *(pa.array([h[:, k].tolist() for h in hulls], pa.list_(pa.float64())) for k in (0, 1))], [key, "lon", "lat"])

    rows = points.select(key, "longitude", "latitude").dropna(subset=["longitude", "latitude"])
    dealt = rows.repartitionByRange(key, "longitude", "latitude").sortWithinPartitions(key)
    hulls = dealt.mapInArrow(local, f"{key} {kind}, lon array<double>, lat array<double>")
    whole = hulls.groupBy(key).agg(F.flatten(F.collect_list(F.struct("lon", "lat"))["lon"]).alias("lon"), F.flatten(F.collect_list(F.struct("lon", "lat"))["lat"]).alias("lat"))
    return whole.select(key, buffered_hull("lon", "lat", metres).alias("ring"))


def _crossings(p: np.ndarray, q: np.ndarray) -> list[list[tuple[float, float, float]]]:
    """For every segment p..q the (share, x, y) of places where others cross or touch it, by a sweep over x."""
    low, high = np.minimum(p, q), np.maximum(p, q)
    order = np.argsort(low[:, 0], kind="stable")
    found = [[] for _ in p]
    for at, i in enumerate(order):
        until = np.searchsorted(low[order, 0], high[i, 0], "right")
        js = order[at + 1 : until]
        js = js[(low[js, 1] <= high[i, 1]) & (high[js, 1] >= low[i, 1])]
        if not len(js):
            continue
        d, e, f = q[i] - p[i], q[js] - p[js], p[js] - p[i]
        cross = d[0] * e[:, 1] - d[1] * e[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (f[:, 0] * e[:, 1] - f[:, 1] * e[:, 0]) / cross, (f[:, 0] * d[1] - f[:, 1] * d[0]) / cross
        for k in np.flatnonzero((cross != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)):
            ends = [(0.0, p[i]), (1.0, q[i])], [(0.0, p[js[k]]), (1.0, q[js[k]])]
            near = [e for s, e in (*ends[0], *ends[1]) if (s in (t[k], u[k])) and np.allclose(e, p[i] + t[k] * d, rtol=0, atol=1e-12)]
            x, y = near[0] if near else np.round(p[i] + t[k] * d, 10)
            found[i].append((float(t[k]), float(x), float(y)))
            found[js[k]].append((float(u[k]), float(x), float(y)))
        for k in np.flatnonzero((cross == 0) & (d[0] * f[:, 1] - d[1] * f[:, 0] == 0)):  # on one line: ends that lie on the other
            for a, b in ((i, js[k]), (js[k], i)):
                way = q[a] - p[a]
                for v in (p[b], q[b]):
                    t = float((v - p[a]) @ way / (way @ way))
                    if 0 <= t <= 1:
                        found[a].append((t, float(v[0]), float(v[1])))
    return found


def repaired(rings: list[np.ndarray]) -> list[np.ndarray]:
    """Closed rings that enclose what the given ones enclose an odd number of times, without crossings.

    Segments are split where they cross; what an even number of segments covers falls away. Each
    segment left has the inside on one side, which a count of crossings to its left tells, and they
    are chained into rings: outer ones turn left, holes right.
    """
    from firegrid.operators.coverage import _chained

    ends = [(r[:-1], r[1:]) for r in rings if len(r) >= 4]
    if not ends:
        return []
    p, q = np.vstack([a for a, _ in ends]), np.vstack([b for _, b in ends])
    # Each segment once, in one direction, so that equal ones are cut alike; pairs of them fall away.
    both, times = np.unique([sorted((v, w)) for v, w in zip(p.tolist(), q.tolist(), strict=True) if v != w] or np.empty((0, 2, 2)), axis=0, return_counts=True)
    p, q = both[times % 2 == 1][:, 0], both[times % 2 == 1][:, 1]
    count: dict[tuple, int] = {}
    for a, b, cuts in zip(p.tolist(), q.tolist(), _crossings(p, q) if len(p) else [], strict=True):
        line = [tuple(a), *((x, y) for _, x, y in sorted(cuts)), tuple(b)]
        for v, w in zip(line, line[1:], strict=False):
            if v != w:
                count[min(v, w), max(v, w)] = count.get((min(v, w), max(v, w)), 0) + 1
    odd = [(*v, *w) for (v, w), n in sorted(count.items()) if n % 2]
    if not odd:
        return []
    s = np.array(odd)
    middle, way = (s[:, :2] + s[:, 2:]) / 2, s[:, 2:] - s[:, :2]
    left = np.zeros(len(s), bool)
    for k in range(len(s)):  # crossings of the ray to the west (or south, for level segments) of the segment's middle
        axis = 1 if way[k, 1] != 0 else 0
        spans = (s[:, axis] > middle[k, axis]) != (s[:, 2 + axis] > middle[k, axis])
        spans[k] = False
        other = 1 - axis
        at = s[spans, other] + (middle[k, axis] - s[spans, axis]) / (s[spans, 2 + axis] - s[spans, axis]) * (s[spans, 2 + other] - s[spans, other])
        inside = np.count_nonzero(at < middle[k, other]) % 2 == 1  # just before the segment on that ray
        left[k] = inside == (way[k, 1] > 0 if axis == 1 else way[k, 0] < 0)
    a, b = np.where(left[:, None], s[:, :2], s[:, 2:]), np.where(left[:, None], s[:, 2:], s[:, :2])
    return [r for r in _chained(a[:, 0].tolist(), a[:, 1].tolist(), b[:, 0].tolist(), b[:, 1].tolist()) if len(r) >= 4]


def rings_array(polygons: list[list[np.ndarray]]) -> pa.Array:
    """Polygons as an Arrow array of arrays of rings."""
    rings = [r for p in polygons for r in p]
    places = np.vstack(rings) if rings else np.empty((0, 2))
    ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    points = pa.StructArray.from_arrays([pa.array(places[:, 0]), pa.array(places[:, 1])], ["lon", "lat"])
    return pa.ListArray.from_arrays(ends([len(p) for p in polygons]), pa.ListArray.from_arrays(ends([len(r) for r in rings]), points))


def distinct_polygons(column: pa.Array) -> tuple[list[list[np.ndarray]], np.ndarray]:
    """The different polygons (arrays of rings) of an Arrow column, and each row's place among them, -1 for a null."""
    outer, rings = column.offsets.to_numpy(), column.values
    inner, points = rings.offsets.to_numpy(), rings.values
    places = np.column_stack([points.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)]) if len(points) else np.empty((0, 2))
    known: dict[tuple, int] = {}
    found, at = [], np.full(len(column), -1)
    nulls = column.is_null().to_numpy(zero_copy_only=False)
    for k, (a, b) in enumerate(zip(outer.tolist(), outer[1:].tolist(), strict=False)):
        if nulls[k]:
            continue
        cuts = inner[a : b + 1]
        body = places[cuts[0] : cuts[-1]] if b > a else places[:0]
        name = (np.diff(cuts).tobytes(), body.tobytes())
        if name not in known:
            known[name] = len(found)
            found.append(np.split(body, (cuts - cuts[0])[1:-1]) if b > a else [])
        at[k] = known[name]
    return found, at


def repaired_rings(rings: str) -> Column:
    """A column of polygons (arrays of closed rings) made valid by the even-odd rule; a null stays null, and what has no area is empty.

    Each different polygon of a batch is repaired once.
    """

    def run(column: pa.Array) -> pa.Array:
        polygons, at = distinct_polygons(column)
        return rings_array([repaired(p) for p in polygons]).take(pa.array(at, mask=at < 0))

    return F.arrow_udf(run, f"array<{RING}>")(rings)


def area_km2(rings: str) -> Column:
    """Area of a polygon's first ring less its holes."""

    def run(column: pd.Series) -> pd.Series:
        size = lambda ring: ring_area_km2(*_array(ring).T)
        return pd.Series([size(p[0]) - sum(size(h) for h in p[1:]) if len(p) else None for p in column], dtype=float)

    return F.pandas_udf(run, DoubleType())(rings)


def inner_point(rings: str) -> Column:
    """A point inside: the middle of the widest stretch on the horizontal through the middle latitude."""

    def run(column: pd.Series) -> pd.DataFrame:
        out = []
        for polygon in column:
            parts = [_array(r) for r in polygon]
            ys = np.unique(np.concatenate([p[:, 1] for p in parts]))
            middle = (ys[0] + ys[-1]) / 2
            k = min(max(int(np.searchsorted(ys, middle)), 1), len(ys) - 1)
            y = (ys[k - 1] + ys[k]) / 2
            cross = []
            for p in parts:
                a, b = p[:-1], p[1:]
                spans = (a[:, 1] > y) != (b[:, 1] > y)
                cross += ((b[spans, 0] - a[spans, 0]) * (y - a[spans, 1]) / (b[spans, 1] - a[spans, 1]) + a[spans, 0]).tolist()
            cross.sort()
            pairs = [(cross[i], cross[i + 1]) for i in range(0, len(cross) - 1, 2)]
            left, right = max(pairs, key=lambda s: s[1] - s[0])
            out.append(((left + right) / 2, y))
        return pd.DataFrame(out, columns=["lon", "lat"])

    return F.pandas_udf(run, "lon double, lat double")(rings)
