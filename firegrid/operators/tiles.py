"""Polygons cut to map tiles, as rows on each tile's integer grid."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firegrid.functions.geo import MERCATOR_MAX_LAT, tile_of
from firegrid.operators.shapes import distinct_polygons

#: Units of a tile's edge.
EXTENT = 4096


def tile_features(features: DataFrame, zoom: int) -> DataFrame:
    """The rows of `features` (lon_min, lat_min, lon_max, lat_max) with x and y, one for every tile that the box touches."""
    x0, y1 = tile_of(F.col("lon_min"), F.col("lat_min"), zoom)
    x1, y0 = tile_of(F.col("lon_max"), F.col("lat_max"), zoom)
    spread = features.select("*", F.explode(F.sequence(x0, x1)).alias("x"))
    return spread.select("*", F.explode(F.sequence(y0, y1)).alias("y"))


def world(lon, lat, zoom: int) -> np.ndarray:
    """n x 2 places in units of the zoom's tiles, from the north-west."""
    lon, lat = np.asarray(lon, float), np.clip(np.asarray(lat, float), -MERCATOR_MAX_LAT, MERCATOR_MAX_LAT)
    n = float(1 << zoom)
    return np.column_stack([(lon + 180.0) / 360.0 * n, (1.0 - np.arcsinh(np.tan(np.radians(lat))) / np.pi) / 2.0 * n])


def clip_ring(ring: np.ndarray, low: float, high: float) -> np.ndarray:
    """The part of a ring (n x 2, open) within the square low..high of both axes, cut side by side.

    Where the ring leaves the square and comes back, the parts are joined along the side, which adds no area.
    """
    for axis, bound, sign in ((0, low, 1.0), (0, high, -1.0), (1, low, 1.0), (1, high, -1.0)):
        if not len(ring):
            return ring
        inside = sign * (ring[:, axis] - bound) >= 0
        if inside.all():
            continue
        after = np.roll(ring, -1, axis=0)
        crosses = inside != np.roll(inside, -1)
        with np.errstate(divide="ignore", invalid="ignore"):
            share = (bound - ring[:, axis]) / (after[:, axis] - ring[:, axis])
            cut = ring + share[:, None] * (after - ring)
        cut[:, axis] = bound
        # Every vertex is followed by the place where its edge crosses the side.
        both = np.stack([ring, cut], axis=1).reshape(-1, 2)
        ring = both[np.stack([inside, crosses], axis=1).reshape(-1)]
    return ring


def doubled_area(ring: np.ndarray) -> float:
    """Twice the signed area of an open ring."""
    x, y = ring[:, 0], ring[:, 1]
    return float(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y)) if len(ring) else 0.0


def clip_to_tiles(features: DataFrame, zoom: int, margin: int = 0, extent: int = EXTENT) -> DataFrame:
    """(code, x, y, rings, area) of every feature and tile that it covers a part of.

    features: code, rings array<array<struct<lon,lat>>> (closed, the first outside, the others
    holes) and the box lon_min, lat_min, lon_max, lat_max. Rings are cut to the tile and `margin`
    units around it, snapped to whole units from the tile's north-west corner, and closed; repeated
    points and rings that collapse are left out, and parts without area give no row. area is in
    square units, holes taken off. A feature's rows are made where its box says, so a feature over many tiles
    is cut by many tasks; nothing is gathered. Rows are dealt first, as a small file is one task's, and
    what repeats in a batch (polygon and tile) is cut once.
    """
    kind = pa.list_(pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())])))

    def snapped(ring: np.ndarray, x: int, y: int) -> np.ndarray:
        places = world(ring[:, 0], ring[:, 1], zoom) * extent - np.array([x, y]) * float(extent)
        cut = np.floor(clip_ring(places[:-1], float(-margin), float(extent + margin)) + 0.5).astype(np.int64)
        kept = cut[np.any(cut != np.roll(cut, 1, axis=0), axis=1)] if len(cut) else cut
        return kept if len(kept) >= 3 and doubled_area(kept) else kept[:0]

    def clipped(rings: list[np.ndarray], x: int, y: int) -> tuple[list, float] | None:
        cut = [snapped(r, x, y) for r in rings if len(r)]
        if not cut or not len(cut[0]):
            return None
        parts = [cut[0], *(r for r in cut[1:] if len(r))]
        area = abs(doubled_area(parts[0])) - sum(abs(doubled_area(r)) for r in parts[1:])
        return [[{"x": int(a), "y": int(b)} for a, b in [*r, r[0]]] for r in parts], area / 2

    def kernel(batches):
        for batch in batches:
            polygons, at = distinct_polygons(batch.column(1))
            known: dict[tuple, int] = {}
            found, rows, place = [], [], []
            for k, key in enumerate(zip(at.tolist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if key not in known:
                    part = clipped(polygons[key[0]], *key[1:])
                    known[key] = -1 if part is None else len(found)
                    found += [] if part is None else [part]
                if known[key] >= 0:
                    rows.append(k)
                    place.append(known[key])
            own, where = pa.array(rows, pa.int64()), pa.array(place, pa.int64())
            made = [pa.array([f[k] for f in found], t).take(where) for k, t in enumerate((kind, pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(own) for k in (0, 2, 3)), *made], ["code", "x", "y", "rings", "area"])

    touched = tile_features(features.filter("code is not null and rings is not null"), zoom).select(F.col("code").cast("string").alias("code"), "rings", F.col("x").cast("int"), F.col("y").cast("int"))
    touched = touched.repartition("x", "y", "code")
    return touched.mapInArrow(kernel, "code string, x int, y int, rings array<array<struct<x:int,y:int>>>, area double")
