"""Distance, nearest-neighbour and point-in-polygon joins over grid cells."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from firegrid.functions.geo import chord, chord_of, geodesic_m, polygon_covers, unit_vector
from firegrid.operators.graph import shared_checkpoint

def geodesic_distance_m(lon1: str, lat1: str, lon2: str, lat2: str) -> Column:
    """WGS84 geodesic of four columns, in Arrow batches; rows with a null stay null."""

    def distance(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(geodesic_m(a, b, c, d))

    return F.pandas_udf(distance, DoubleType())(lon1, lat1, lon2, lat2)


def _neighbours(x: Column, y: Column) -> Column:
    return F.explode(F.array(*(F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx in (-1, 0, 1) for dy in (-1, 0, 1))))


#: Radii up to this one share the finest cells; every doubling beyond it has cells of its own.
FINEST_M = 500.0


def within_distance(left: DataFrame, right: DataFrame, radius: Column) -> DataFrame:
    """Pairs of rows no further apart than `radius` metres (a column of `right`), with `distance_m`, anywhere on the globe.

    left has longitude and latitude, right has lon2 and lat2. Points are placed on the unit
    sphere, in cubes twice as wide as the chord of the radius, so a right row's ball touches at
    most eight cubes and neither the poles nor the 180th meridian are special. Radii are
    rounded up to levels, at most 16 powers of two, and a left row is looked up once a level
    in use. The straight distance excludes most pairs and the geodesic decides. Rows with a null
    coordinate or radius have no pairs. Neither side is broadcast unless Spark finds it small.
    """
    vectors = lambda df, lon, lat: reduce(lambda d, c: d.withColumn(c[0], c[1]), zip(("_x", "_y", "_z"), unit_vector(F.col(lon), F.col(lat)), strict=True), df)
    level = F.least(F.lit(16), F.greatest(F.lit(0), F.ceil(F.log2(radius / FINEST_M)))).cast("int")
    side = vectors(right.withColumn("_reach", chord(radius)).withColumn("_level", level), "lon2", "lat2").filter("_reach is not null and _x is not null and _z is not null")
    levels = sorted(r["_level"] for r in side.select("_level").distinct().collect())  # no more than 17
    width = lambda n: 2 * chord_of(FINEST_M * 2.0**n)
    size = F.lit(2.0) if not levels else reduce(lambda e, n: e.when(F.col("_level") == n, F.lit(width(n))), levels, F)
    touched = lambda c: F.sequence(F.floor((F.col(c) - F.col("_reach")) / size), F.floor((F.col(c) + F.col("_reach")) / size))
    spread = reduce(lambda d, c: d.withColumn(f"_cell{c}", F.explode(touched(c))), ("_x", "_y", "_z"), side)
    spread = spread.select(*right.columns, "_level", "_reach", *(F.col(c).alias(f"{c}2") for c in ("_x", "_y", "_z")), "_cell_x", "_cell_y", "_cell_z")
    own = vectors(left, "longitude", "latitude").withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    placed = reduce(lambda d, c: d.withColumn(f"_cell{c}", F.floor(F.col(c) / size)), ("_x", "_y", "_z"), own)
    near = placed.join(spread, ["_level", "_cell_x", "_cell_y", "_cell_z"])
    straight = sum(((F.col(c) - F.col(f"{c}2")) ** 2 for c in ("_x", "_y", "_z")), F.lit(0.0))
    near = near.filter(straight <= F.col("_reach") * F.col("_reach"))
    found = near.withColumn("distance_m", geodesic_distance_m("longitude", "latitude", "lon2", "lat2")).filter(F.col("distance_m") <= radius)
    return found.select(*left.columns, *right.columns, "distance_m")


def classify_known(detections: DataFrame, sources: DataFrame) -> DataFrame:
    """detections with known_source_key: the nearest active source whose radius holds them, then its key."""
    # Sources of one place and radius hold the same detections, and the first key stands for them.
    active = sources.filter("is_active").groupBy(F.col("longitude").alias("lon2"), F.col("latitude").alias("lat2"), "match_radius_m").agg(F.min("source_key").alias("source_key"))
    hits = within_distance(detections.select("id", "longitude", "latitude"), active, F.col("match_radius_m"))
    best = hits.groupBy("id").agg(F.min(F.struct("distance_m", "source_key")).alias("b")).select("id", F.col("b.source_key").alias("known_source_key"))
    return detections.join(best, "id", "left")


def nearest(left: DataFrame, right: DataFrame, key: str, step: float | None = None) -> DataFrame:
    """left with the planar-nearest row of right (struct `near`): growing rings of cells, ties by `key`.

    left needs `id`, longitude and latitude; right lon2, lat2 and a unique `key`. Both sides are
    reduced to distinct places first, so crowded places cost one comparison each. A ring of r
    cells settles the places whose nearest candidate lies within r steps; the rest go on, from a
    checkpoint, with a ring twice as wide, and the last ring covers the whole right side. The
    first step leaves about two right places a cell on average.
    """
    empty = left.withColumn("near", F.lit(None).cast(StructType([StructField("d2", DoubleType()), *right.schema.fields])))
    sites = shared_checkpoint(right.groupBy("lon2", "lat2").agg(F.min(key).alias("_key")).dropna())
    todo = shared_checkpoint(left.select("longitude", "latitude").dropna().distinct())
    box = sites.agg(F.min("lon2"), F.max("lon2"), F.min("lat2"), F.max("lat2"), F.count("*")).first()
    own = todo.agg(F.min("longitude"), F.max("longitude"), F.min("latitude"), F.max("latitude")).first()
    if box[0] is None or own[0] is None:
        return empty
    widest = max(abs(a - b) for i, j in ((0, 1), (2, 3)) for a in (box[i], box[j]) for b in (own[i], own[j]))
    area = max(box[1] - box[0], 1e-3) * max(box[3] - box[2], 1e-3)
    size = step or math.sqrt(2 * area / box[4])
    dx, dy = F.col("longitude") - F.col("lon2"), F.col("latitude") - F.col("lat2")
    settled = []
    while True:
        cell = lambda c: F.floor(F.col(c) / size)  # noqa: E731, B023
        spread = sites.withColumn("_c", _neighbours(cell("lon2"), cell("lat2"))).withColumn("_x", F.col("_c.x")).withColumn("_y", F.col("_c.y")).drop("_c")
        pairs = todo.withColumn("_x", cell("longitude")).withColumn("_y", cell("latitude")).join(spread, ["_x", "_y"], "left")
        best = pairs.groupBy("longitude", "latitude").agg(F.min(F.when(F.col("_key").isNotNull(), F.struct((dx * dx + dy * dy).alias("d2"), "_key"))).alias("b"))
        best = shared_checkpoint(best)
        last = size > widest
        near = F.lit(True) if last else F.coalesce(F.col("b.d2") <= size * size, F.lit(False))
        settled.append(best.filter(near).select("longitude", "latitude", "b.*"))
        todo = best.filter(~near).select("longitude", "latitude")
        if last or todo.isEmpty():
            break
        size *= 2
    found = reduce(DataFrame.unionByName, settled).join(right.withColumn("_key", F.col(key)), "_key")
    found = found.select("longitude", "latitude", F.struct("d2", *right.columns).alias("near"))
    return left.join(found, ["longitude", "latitude"], "left").select(*left.columns, "near")


def point_in_polygon(points: DataFrame, areas: DataFrame, step: float = 1.0) -> DataFrame:
    """points (id, longitude, latitude) with the covering area's columns; a point on several areas takes the one with the nearest centre, then the code.

    areas has code, rings, lon_min, lon_max, lat_min, lat_max, centre_lon, centre_lat. Areas are
    copied to the cells of their boxes and joined by cell; box and ring tests are Column
    expressions.
    """
    cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / step), F.floor(F.col(hi) / step))
    spread = areas.withColumn("_x", F.explode(cells("lon_min", "lon_max"))).withColumn("_y", F.explode(cells("lat_min", "lat_max")))
    placed = points.withColumn("_x", F.floor(F.col("longitude") / step)).withColumn("_y", F.floor(F.col("latitude") / step))
    hit = placed.join(spread, ["_x", "_y"]).filter(
        F.col("longitude").between(F.col("lon_min"), F.col("lon_max")) & F.col("latitude").between(F.col("lat_min"), F.col("lat_max"))
    ).filter(polygon_covers(F.col("rings"), F.col("longitude"), F.col("latitude")))
    dx, dy = F.col("centre_lon") - F.col("longitude"), F.col("centre_lat") - F.col("latitude")
    best = hit.groupBy("id").agg(F.min(F.struct((dx * dx + dy * dy).alias("d2"), "code")).alias("b")).select("id", F.col("b.code").alias("code"))
    return points.join(best, "id", "left")


def dedupe_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """First row of every key, by `order`."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")
