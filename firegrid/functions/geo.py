"""Distances, cells, tiles and polygons.

Column expressions where the semantics allow, numpy kernels for the geodesic.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRES_PER_DEGREE = 111_320.0
#: Shortest degree of latitude on the ellipsoid, for preselections without false negatives.
SHORTEST_DEGREE = 110_500.0
MERCATOR_MAX_LAT = 85.0511287798066
GRID_DEG = 0.004


def grid_cell(degrees: Column, step: float = GRID_DEG) -> Column:
    return F.floor(degrees / F.lit(step)).cast("long")


def equirectangular_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance with the scale of the first point's latitude."""
    dy = (lat2 - lat1) * METRES_PER_DEGREE
    dx = (lon2 - lon1) * METRES_PER_DEGREE * F.cos(F.radians(lat1))
    return F.sqrt(dx * dx + dy * dy)


def tile_of(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Slippy-map tile; latitudes are clamped to the Mercator limit and indices to the zoom."""
    n = 1 << zoom
    clamped = F.greatest(F.lit(-MERCATOR_MAX_LAT), F.least(F.lit(MERCATOR_MAX_LAT), lat))
    x = ((lon + 180.0) / 360.0 * n).cast("int")
    y = ((1.0 - F.asinh(F.tan(F.radians(clamped))) / math.pi) / 2.0 * n).cast("int")
    limit = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1))
    return limit(x), limit(y)


def column_bands(x0: int, x1: int, count: int) -> list[tuple[int, int]]:
    """Contiguous column ranges that cover x0..x1 once each."""
    if count < 1 or x1 < x0:
        raise ValueError("at least one band and one column are needed")
    width = math.ceil((x1 - x0 + 1) / min(count, x1 - x0 + 1))
    return [(a, min(a + width - 1, x1)) for a in range(x0, x1 + 1, width)]


def band_starts(x0: Column, x1: Column, count: int) -> tuple[Column, Column]:
    """(first columns of the bands, an array; width) of column_bands() over columns: band k ends at least(first + width - 1, x1)."""
    size = x1 - x0 + 1
    width = F.ceil(size / F.least(F.lit(count), size)).cast("long")
    return F.when(size > 0, F.sequence(x0.cast("long"), x1.cast("long"), width)), width


def e7(degrees: float) -> int:
    return round(degrees * 10_000_000)


def covers(ring: Column, lon: Column, lat: Column) -> Column:
    """Whether a ring (array<struct<lon,lat>>, closed) covers a point, its boundary included."""
    edges = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b"))

    def on_edge(e: Column) -> Column:
        a, b = e["a"], e["b"]
        cross = (b["lon"] - a["lon"]) * (lat - a["lat"]) - (b["lat"] - a["lat"]) * (lon - a["lon"])
        return (cross == 0) & lon.between(F.least(a["lon"], b["lon"]), F.greatest(a["lon"], b["lon"])) & lat.between(F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"]))

    def crossed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        at = a["lon"] + (lat - a["lat"]) * (b["lon"] - a["lon"]) / (b["lat"] - a["lat"])
        return F.when(spans & (lon < at), 1).otherwise(0)

    inside = F.aggregate(edges, F.lit(0), lambda s, e: s + crossed(e)) % 2 == 1
    return F.exists(edges, on_edge) | inside


def polygon_covers(rings: Column, lon: Column, lat: Column) -> Column:
    """A polygon as array of rings, the first outside and the others holes; a hole's edge is covered."""
    strictly = lambda ring: covers(ring, lon, lat) & ~F.exists(
        F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b")),
        lambda e: ((e["b"]["lon"] - e["a"]["lon"]) * (lat - e["a"]["lat"]) == (e["b"]["lat"] - e["a"]["lat"]) * (lon - e["a"]["lon"]))
        & lon.between(F.least(e["a"]["lon"], e["b"]["lon"]), F.greatest(e["a"]["lon"], e["b"]["lon"]))
        & lat.between(F.least(e["a"]["lat"], e["b"]["lat"]), F.greatest(e["a"]["lat"], e["b"]["lat"])),
    )
    return covers(F.get(rings, F.lit(0)), lon, lat) & ~F.exists(F.slice(rings, 2, F.size(rings)), strictly)


def unit_vector(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """A point's place on the unit sphere, by its geodetic coordinates."""
    across = F.cos(F.radians(lat))
    return across * F.cos(F.radians(lon)), across * F.sin(F.radians(lon)), F.sin(F.radians(lat))


def unit_vectors(lon, lat) -> np.ndarray:
    """n x 3 places on the unit sphere."""
    lon, lat = np.radians(np.asarray(lon, float)), np.radians(np.asarray(lat, float))
    return np.column_stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])


#: Smallest radius of curvature of the ellipsoid: a way of d metres turns by no more than d over it.
LEAST_CURVATURE_M = 6_335_439.0


def chord(metres: Column) -> Column:
    """Straight distance on the unit sphere that no two points within `metres` of each other exceed."""
    return 2 * F.sin(F.least(metres / (2 * LEAST_CURVATURE_M), F.lit(math.pi / 2))) * (1 + 1e-9) + 1e-12


def chord_of(metres: float) -> float:
    return 2 * math.sin(min(metres / (2 * LEAST_CURVATURE_M), math.pi / 2)) * (1 + 1e-9) + 1e-12


# WGS84
_A, _F = 6378137.0, 1 / 298.257223563
_B = _A * (1 - _F)


def geodesic_m(lon1, lat1, lon2, lat2) -> np.ndarray:
    """Geodesic distances in metres by Vincenty's inverse iteration, vectorised; exact to 0.1 mm below 1000 km."""
    lon1, lat1, lon2, lat2 = (np.radians(np.asarray(x, float)) for x in (lon1, lat1, lon2, lat2))
    u1, u2 = np.arctan((1 - _F) * np.tan(lat1)), np.arctan((1 - _F) * np.tan(lat2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    big = lon2 - lon1
    lam = big.copy() if isinstance(big, np.ndarray) else big
    for _ in range(30):
        sl, cl = np.sin(lam), np.cos(lam)
        ss = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
        cs = s1 * s2 + c1 * c2 * cl
        sigma = np.arctan2(ss, cs)
        sa = np.where(ss > 0, c1 * c2 * sl / np.where(ss > 0, ss, 1), 0)
        ca2 = 1 - sa * sa
        c2m = np.where(ca2 > 0, cs - 2 * s1 * s2 / np.where(ca2 > 0, ca2, 1), 0)
        c = _F / 16 * ca2 * (4 + _F * (4 - 3 * ca2))
        new = big + (1 - c) * _F * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m**2 - 1)))
        done = np.all(np.abs(new - lam) < 1e-13)
        lam = new
        if done:
            break
    u = ca2 * (_A**2 - _B**2) / _B**2
    a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
    b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
    d = b * ss * (c2m + b / 4 * (cs * (2 * c2m**2 - 1) - b / 6 * c2m * (4 * ss**2 - 3) * (4 * c2m**2 - 3)))
    return _B * a * (sigma - d)


def geodesic_pair_m(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    """geodesic_m() of one pair, without the arrays."""
    if lon1 == lon2 and lat1 == lat2:
        return 0.0
    phi1, phi2, big = math.radians(lat1), math.radians(lat2), math.radians(lon2) - math.radians(lon1)
    u1, u2 = math.atan((1 - _F) * math.tan(phi1)), math.atan((1 - _F) * math.tan(phi2))
    s1, c1, s2, c2 = math.sin(u1), math.cos(u1), math.sin(u2), math.cos(u2)
    lam = big
    for _ in range(30):
        sl, cl = math.sin(lam), math.cos(lam)
        ss = math.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
        cs = s1 * s2 + c1 * c2 * cl
        sigma = math.atan2(ss, cs)
        sa = c1 * c2 * sl / ss if ss > 0 else 0.0
        ca2 = 1 - sa * sa
        c2m = cs - 2 * s1 * s2 / ca2 if ca2 > 0 else 0.0
        c = _F / 16 * ca2 * (4 + _F * (4 - 3 * ca2))
        new = big + (1 - c) * _F * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m * c2m - 1)))
        done = abs(new - lam) < 1e-13
        lam = new
        if done:
            break
    u = ca2 * (_A**2 - _B**2) / _B**2
    a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
    b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
    d = b * ss * (c2m + b / 4 * (cs * (2 * c2m * c2m - 1) - b / 6 * c2m * (4 * ss * ss - 3) * (4 * c2m * c2m - 3)))
    return _B * a * (sigma - d)


def geodesic_direct(lon, lat, azimuth, metres) -> tuple[np.ndarray, np.ndarray]:
    """Where geodesics of some metres at azimuths (radians from north) end: longitudes and latitudes, by Vincenty's direct iteration."""
    lon, phi, turn, way = np.broadcast_arrays(*(np.asarray(x, float) for x in (lon, np.radians(lat), azimuth, metres)))
    tan_u = (1 - _F) * np.tan(phi)
    cos_u = 1 / np.sqrt(1 + tan_u**2)
    sin_u, sin_t, cos_t = tan_u * cos_u, np.sin(turn), np.cos(turn)
    first = np.arctan2(tan_u, cos_t)
    sin_a = cos_u * sin_t
    ca2 = 1 - sin_a**2
    u = ca2 * (_A**2 - _B**2) / _B**2
    big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
    small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
    sigma = way / (_B * big)
    for _ in range(20):
        middle = np.cos(2 * first + sigma)
        wave = small * np.sin(sigma) * (middle + small / 4 * (np.cos(sigma) * (2 * middle**2 - 1) - small / 6 * middle * (4 * np.sin(sigma) ** 2 - 3) * (4 * middle**2 - 3)))
        sigma = way / (_B * big) + wave
    ss, cs, middle = np.sin(sigma), np.cos(sigma), np.cos(2 * first + sigma)
    end = np.arctan2(sin_u * cs + cos_u * ss * cos_t, (1 - _F) * np.hypot(sin_a, sin_u * ss - cos_u * cs * cos_t))
    turned = np.arctan2(ss * sin_t, cos_u * cs - sin_u * ss * cos_t)
    c = _F / 16 * ca2 * (4 + _F * (4 - 3 * ca2))
    shift = turned - (1 - c) * _F * sin_a * (sigma + c * ss * (middle + c * cs * (2 * middle**2 - 1)))
    return lon + np.degrees(shift), np.degrees(end)


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Vertices of the convex hull of n x 2 points, counter-clockwise, by a monotone chain."""
    pts = sorted({*map(tuple, np.asarray(points, float).reshape(-1, 2).tolist())})
    if len(pts) < 3:
        return np.array(pts, float).reshape(-1, 2)

    def chain(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def diameter(hull: np.ndarray) -> float:
    """Largest planar distance of two hull vertices."""
    if len(hull) < 2:
        return 0.0
    best = 0.0
    for p in hull:
        best = max(best, float(((hull - p) ** 2).sum(axis=1).max()))
    return math.sqrt(best)


def ring_area_km2(lon, lat) -> float:
    """Area of a closed ring on the authalic sphere."""
    lam, phi = np.radians(np.asarray(lon, float)), np.radians(np.asarray(lat, float))
    e2 = _F * (2 - _F)
    e = math.sqrt(e2)
    q = lambda s: (1 - e2) * (s / (1 - e2 * s * s) + np.arctanh(e * s) / e)
    sines = q(np.sin(phi)) / q(1.0)
    radius2 = _A**2 * q(1.0) / 2
    return abs(float(np.sum((lam[1:] - lam[:-1]) * (sines[1:] + sines[:-1]) / 2)) * radius2) / 1e6
